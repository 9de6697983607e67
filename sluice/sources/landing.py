"""Landing zones and containers read as files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from sluice.operators.admission import container_category, extension_allowed
from sluice.sources.scratch import scratch

#: Limits of a container.
MOST_BYTES, MOST_MEMBERS = 500_000_000, 10_000


def _objects(rows: DataFrame, content: bool) -> DataFrame:
    columns = [F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at")]
    return rows.filter(~F.col("path").endswith("/")).select(*columns, *([F.col("content")] if content else []))


def scan(spark: SparkSession, folder: str, *, pattern: str = "*", content: bool = False) -> DataFrame:
    """Objects under a folder: key, size, modified_at and, if asked for, content. Folders themselves are not objects."""
    return _objects(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder), content)


POLLED = "path string, modificationTime timestamp, length long, content binary"


def polled(spark: SparkSession, folder: str, *, pattern: str = "*", content: bool = False, files_per_trigger: int = 10_000) -> DataFrame:
    """The same as a stream: each object once, when it is first seen; the job's checkpoint remembers them."""
    rows = spark.readStream.format("binaryFile").schema(POLLED).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return _objects(rows, content)


@udtf(returnType="position int, name string, size long, content binary, state string")
class Members:
    """The direct members of one container; a broken one gives one row that says so."""

    def eval(self, category: str, content: bytes) -> Iterator[tuple]:
        try:
            if category == "ZIP":
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    total, files = 0, [i for i in z.infolist() if not i.is_dir()]
                    if len(files) > MOST_MEMBERS:
                        yield 0, "", 0, None, "too_many_members"
                        return
                    for n, info in enumerate(files):
                        total += info.file_size
                        if total > MOST_BYTES:
                            yield n, info.filename, info.file_size, None, "too_large"
                            return
                        yield n, info.filename, info.file_size, z.read(info), "ok"
            elif category == "EML":
                message = message_from_bytes(content, policy=policy.default)
                for n, part in enumerate(p for p in message.walk() if not p.is_multipart()):
                    body = part.get_payload(decode=True) or b""
                    yield n, part.get_filename() or f"body_{n}.txt", len(body), body, "ok"
        except Exception as error:  # noqa: BLE001  any way in which a container is broken
            yield 0, "", 0, None, f"error:{type(error).__name__}"


def expand(containers: DataFrame, *, depth: int = 5, most_bytes: int = MOST_BYTES, allowed: str = "") -> DataFrame:
    """All members down to a depth: root, depth, path, position, size, content, state. containers: root, name, content.

    state: ok; unsupported (the extension is not in `allowed`, a list as configs have it; empty allows all; containers are always opened); too_large (what a root holds, added up level by level,
    is over `most_bytes`); too_many_members; too_deep (a container at the last level); error:<code> (it can't be read). Only ok members have content.

    Every level is written out and read again, so that a container is opened once, whatever lies below it. The running sum of sizes reads no content, and only containers are carried on.
    """
    spark = containers.sparkSession
    spark.udtf.register("sluice_members", Members)
    folder = scratch(spark, "containers")
    level = containers.select("root", F.col("name").alias("path"), "content", F.lit(0).cast("long").alias("held"))
    level = level.withColumn("category", container_category(F.col("content"), F.col("path"))).filter("category <> 'FILE'")
    for n in range(1, depth + 1):
        opened = level
        rows = spark.sql(
            f"SELECT c.root, {n} AS depth, concat(c.path, '/', m.name) AS path, m.position, m.size, m.content, m.state, c.held, c.path AS above FROM {{opened}} c, LATERAL sluice_members(c.category, c.content) m", opened=opened
        )
        category = F.when(F.col("state") == "ok", container_category(F.col("content"), F.col("path"))).otherwise("FILE")
        state = F.when((F.col("state") == "ok") & (F.col("category") == "FILE") & ~extension_allowed(F.col("path"), F.lit(allowed)), "unsupported").otherwise(F.col("state"))
        state = F.when((F.col("state") == "ok") & (F.col("category") != "FILE") & F.lit(n == depth), "too_deep").otherwise(state)
        rows.withColumn("category", category).withColumn("state", state).write.parquet(f"{folder}/read={n}")
        found = spark.read.parquet(f"{folder}/read={n}")
        key = ["root", "above", "path", "position"]
        running = Window.partitionBy("root").orderBy("path", "above", "position").rowsBetween(Window.unboundedPreceding, 0)
        total = F.col("held") + F.sum(F.when(F.col("state") == "ok", F.col("size")).otherwise(0)).over(running)
        judged = found.select(*key, "size", "held", "state").withColumn("total", total)
        judged = judged.select(*key, "total", F.when((F.col("state") == "ok") & (F.col("total") > most_bytes), "too_large").otherwise(F.col("state")).alias("verdict"))
        judged.write.parquet(f"{folder}/judged={n}")
        judged = spark.read.parquet(f"{folder}/judged={n}")
        sums = judged.groupBy("root").agg(F.max("total").alias("held"))
        level = found.filter("category <> 'FILE'").drop("held").join(judged.hint("merge"), key).filter("verdict = 'ok'").select("root", "path", "content", "category").join(sums.hint("merge"), "root")
    read, judged = (spark.read.option("basePath", folder).parquet(f"{folder}/{x}=*").withColumnRenamed(x, "level") for x in ("read", "judged"))
    out = read.join(judged.hint("merge"), ["level", "root", "above", "path", "position"])
    return out.select("root", F.col("level").cast("int").alias("depth"), "path", "position", "size", F.when(F.col("verdict") == "ok", F.col("content")).alias("content"), F.col("verdict").alias("state"))
