"""Classification of documents: lexical and vector scores, the cascade, learning, categories."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.operators.beside import MOST_TASKS, ROWS_EACH, if_few, spread
from sluice.sources import versions
from sluice.sources.scratch import kept

WORD = "[a-zàâäéèêëïîôöùûüç0-9]{3,}"
#: Rows of a weights table up to which it is broadcast (a row is a word, a label and a number); a larger one is joined by its key. Bytes of centroids up to which they are, and that a block has beyond.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000


def document_words(documents: DataFrame, *more: str) -> DataFrame:
    """Distinct words of each document, with further columns of it."""
    return documents.select("document_id", *more, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("word"))


def _top_two(scores: DataFrame) -> DataFrame:
    """label, best and delta to the second (0 if there is none) for each document; of equal scores the first label."""
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "label")
    ranked = scores.withColumn("r", F.row_number().over(order)).filter("r <= 2")
    return ranked.groupBy("document_id").agg(F.max(F.when(F.col("r") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("r") == 1, F.col("score"))).alias("best"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("second"))


def lexical(documents: DataFrame, weights: DataFrame) -> DataFrame:
    """label, confidence and delta by the sum of the weights of the words that occur; null, 0 and 0 if none is known. Words are joined where they are, if the weights are few; else those that have none go before the sum."""
    weights = kept(weights, "weights")
    held = F.broadcast(weights) if weights.count() <= BROADCAST_ROWS else weights.hint("shuffle_hash")
    hits = document_words(documents).join(held, "word")
    top = _top_two(hits.groupBy("document_id", "label").agg(F.sum("weight").alias("score")))
    out = documents.select("document_id").join(top.hint("merge"), "document_id", "left")
    return out.select("document_id", "label", F.coalesce(F.least(F.lit(1.0), F.abs("best") / 10), F.lit(0.0)).alias("confidence"), F.coalesce(F.col("best") - F.col("second"), F.lit(0.0)).alias("delta"))


def lexical_statistics(documents: DataFrame) -> DataFrame:
    """Documents for each label, and for each label and word (word null: the label itself). documents: document_id, text, label."""
    by_word = document_words(documents, "label").groupBy("label", "word").agg(F.count("*").alias("n"))
    by_label = documents.groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit(None).cast("string").alias("word"), "n")
    return by_label.unionByName(by_word)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _centroid_blocks(centroids: DataFrame) -> tuple[DataFrame, int]:
    """Centroids as arrays, a label's together: one row, or, beyond BROADCAST_BYTES, as many as blocks of that size."""
    size = centroids.agg(F.coalesce(F.sum(8 * F.size("vector") + 32), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BROADCAST_BYTES))
    held = F.collect_list(F.struct("label", F.col("vector").alias("v"))).alias("cs")
    if blocks == 1:
        return centroids.agg(held), 1
    return centroids.groupBy(F.pmod(F.xxhash64("label"), F.lit(blocks)).alias("block")).agg(held).select("cs"), blocks


def _scored(rows: DataFrame, wanted: Column) -> DataFrame:
    """Adds s: of the wanted rows' vectors, the best label and the best of another label, as (less: minus the score, label)."""
    every = F.transform("cs", lambda c: F.struct((-F.round(dot(F.col("vector"), c["v"]), 9)).alias("less"), c["label"].alias("label")))
    rows = rows.withColumn("s", F.when(wanted, F.array_sort(every))).drop("cs")
    # in order, the first of another label is the second best
    return rows.withColumn("s", F.slice(F.concat(F.slice("s", 1, 1), F.filter("s", lambda x: x["label"] != F.try_element_at("s", F.lit(1))["label"])), 1, 2))


def _score_columns() -> list[Column]:
    best, second = F.try_element_at("s", F.lit(1)), F.try_element_at("s", F.lit(2))
    return [best["label"].alias("label"), F.coalesce(-best["less"], F.lit(0.0)).alias("score"), F.coalesce(second["less"] - best["less"], -best["less"], F.lit(0.0)).alias("delta")]


def vector(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """label, score and delta to the next other label, by the inner product of unit vectors. vectors: document_id, vector, one row a document.

    The centroids are few (the number of labels, not of documents): they are one array beside every vector, so scoring
    shuffles nothing. More than BROADCAST_BYTES are scored block by block, and each document's best of all blocks are put together.
    """
    held, blocks = _centroid_blocks(centroids)
    rows = vectors.select("document_id", "vector").crossJoin(F.broadcast(held) if blocks == 1 else held)
    top = _scored(rows, F.lit(True))
    if blocks > 1:
        top = top.groupBy("document_id").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("s"))
    return top.select("document_id", *_score_columns())


def best_chunk(scored: DataFrame) -> DataFrame:
    """The chunk with the largest score over 0, the first on ties. scored: document_id, chunk_no, label, score, delta."""
    good = scored.filter("score > 0")
    return good.groupBy("document_id").agg(F.max_by(F.struct("chunk_no", "label", "score", "delta"), F.struct("score", -F.col("chunk_no"))).alias("b")).select("document_id", "b.*")


def cascade(
    documents: DataFrame, lexical_scores: DataFrame, vectors: DataFrame, centroids: DataFrame, model_answers: DataFrame,
    *, versions: dict[str, str], lexical_min: tuple[float, float] = (0.6, 0.20), vector_min: tuple[float, float] = (0.75, 0.10),
) -> DataFrame:
    """label, confidence and source of each document: cheap stages first, the rest to the next one.

    A document's lexical verdict, vector and model answer are brought together once; vectors are scored only where the verdict is not good enough.
    """
    one = documents.select("document_id").join(lexical_scores.select("document_id", F.struct("label", "confidence", "delta").alias("lex")).hint("merge"), "document_id", "left")
    rows = one.join(vectors.select("document_id", "vector").hint("merge"), "document_id", "left")
    rows = rows.join(model_answers.select("document_id", F.struct("label", "confidence").alias("llm")).hint("merge"), "document_id", "left")
    by_words = F.coalesce((F.col("lex.confidence") >= lexical_min[0]) & (F.col("lex.delta") >= lexical_min[1]), F.lit(False))
    wanted = ~by_words & F.col("vector").isNotNull()
    held, blocks = _centroid_blocks(centroids)
    if blocks == 1:
        rows = _scored(rows.crossJoin(F.broadcast(held)), wanted).withColumn("emb", F.when(F.size("s") > 0, F.struct(*_score_columns())))
    else:
        rows = rows.join(vector(rows.filter(wanted), centroids).select("document_id", F.struct("label", "score", "delta").alias("emb")).hint("merge"), "document_id", "left")
    by_vector = F.coalesce((F.col("emb.score") >= vector_min[0]) & (F.col("emb.delta") >= vector_min[1]), F.lit(False))
    verdict = lambda c, score, name: F.struct(F.col(f"{c}.label").alias("label"), F.col(f"{c}.{score}").alias("confidence"), F.lit(f"{name}_v{versions[name]}").alias("source"))
    found = F.when(by_words, verdict("lex", "confidence", "lexical")).when(by_vector, verdict("emb", "score", "embedding")).otherwise(verdict("llm", "confidence", "llm"))
    out = rows.select("document_id", found.alias("v"))
    return out.select("document_id", F.coalesce("v.label", F.lit("unknown")).alias("label"), F.round(F.coalesce("v.confidence", F.lit(0.0)), 4).alias("confidence"), "v.source")


def recognition(classified: DataFrame, level: Column, guess: Column) -> DataFrame:
    """UNRECOGNIZED below the level unless guesses are allowed; the type is kept either way."""
    return classified.withColumn("status", F.when((F.col("confidence") < level) & ~guess, "UNRECOGNIZED").otherwise("CLASSIFIED"))


def categories(doctypes: DataFrame, centroids: DataFrame, weights: DataFrame) -> DataFrame:
    """All names that a document can be given, with the types' descriptions."""
    none = F.lit(None).cast("string").alias("description")
    names = doctypes.select(F.col("doctype_name").alias("name"), "description").unionByName(centroids.select(F.col("label").alias("name"), none)).unionByName(weights.select(F.col("label").alias("name"), none))
    return names.filter("coalesce(name, '') <> ''").groupBy("name").agg(F.coalesce(F.max("description"), F.lit("")).alias("description")).orderBy("name")


#: Types of an account that stand in one array beside its configs, and arrays that a portion of configs meets.
TYPES_EACH, ARRAYS_EACH = 10_000, 16


def scope(configs: DataFrame, doctypes: DataFrame, more: tuple[str, ...] = ("doctype_name",)) -> DataFrame:
    """Types of each config: those it expects, else its old list, else its account's. configs: config_id, account_id, expected, old (arrays). more: columns of the types besides their id.

    There is a row for each config and type. An account's types stand in arrays of some TYPES_EACH, some ARRAYS_EACH of which are beside portions of its configs, and a task only lays such an array out, row by row.
    Neither configs nor arrays are sent more often when there are more of both.
    """
    wanted = F.when(F.size("expected") > 0, F.col("expected")).otherwise(F.col("old"))
    rows = configs.select("config_id", "account_id", wanted.alias("w"))
    types = doctypes.select("doctype_id", *more)
    listed = rows.filter(F.size("w") > 0).select("config_id", F.explode("w").alias("doctype_id")).join(types.hint("merge"), "doctype_id")
    mine = doctypes.select("account_id", "doctype_id", *more)
    sizes = if_few(kept(mine.groupBy("account_id").agg(F.ceil(F.count("*") / TYPES_EACH).cast("int").alias("blocks")), "blocks"), other="merge")
    at, shelf = F.pmod(F.xxhash64("doctype_id"), F.col("blocks")).cast("int").alias("block"), lambda block: F.floor(block / ARRAYS_EACH).cast("int")
    blocks = mine.join(sizes, "account_id").groupBy("account_id", at).agg(F.collect_list(F.struct("doctype_id", *more)).alias("types")).select("account_id", shelf(F.col("block")).alias("shelf"), "types")
    asking = rows.filter(F.size("w") == 0).join(sizes, "account_id").select("config_id", "account_id", F.explode(F.sequence(F.lit(0), shelf(F.col("blocks") - 1))).alias("shelf"))
    owned = spread(asking, blocks, ["account_id", "shelf"], "config_id").select("config_id", F.inline("types"))
    return listed.select("config_id", *types.columns).unionByName(owned)


def learning_log(validated: DataFrame) -> DataFrame:
    """One row for each type and text of validated documents: log_key is the text's digest."""
    good = validated.filter("doctype <> 'unknown' and trim(coalesce(text, '')) <> ''").withColumn("log_key", F.sha2("text", 256))
    return good.groupBy("doctype", "log_key").agg(F.min("document_id").alias("document_id"))


def unprocessed(log: DataFrame, processed: DataFrame) -> DataFrame:
    """Log rows that no model has seen; by their keys, so a late key that sorts early is not lost."""
    return log.join(processed.select("doctype", "log_key").distinct(), ["doctype", "log_key"], "left_anti")


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centroids of labels whose vectors arrive in order: the first makes one, later ones move the nearest."""
    label, centres = None, []

    def done() -> pd.DataFrame:
        return pd.DataFrame({"label": [label] * len(centres), "centroid_no": range(len(centres)), "vector": [c.tolist() for c in centres]})

    for batch in batches:
        for name, is_old, values in zip(batch["label"], batch["is_old"], batch["vector"]):
            v = np.asarray(values, np.float32)
            if name != label:
                if label is not None:
                    yield done()
                label, centres = name, []
            if is_old or not centres:
                centres.append(v / max(np.linalg.norm(v), np.float32(1e-12)))
            else:
                k = int(np.argmax([float(c @ v) for c in centres]))
                moved = centres[k] + v
                centres[k] = moved / max(np.linalg.norm(moved), np.float32(1e-12))
    if label is not None:
        yield done()


def centroids(log: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Centroids after the log's vectors, in the order of their keys within each label. log: label, log_key, vector; old: label, centroid_no, vector.

    The rule depends on the order within a label, so a label's vectors stream sorted through one task; only its centroids are held.
    """
    rows = log.select("label", F.lit(False).alias("is_old"), F.col("log_key").cast("string").alias("k"), "vector")
    if old is not None:
        rows = rows.unionByName(old.select("label", F.lit(True).alias("is_old"), F.format_string("%010d", "centroid_no").alias("k"), "vector"))
    label_type = log.schema["label"].dataType.simpleString()
    dealt = rows.repartition("label").sortWithinPartitions("label", F.desc("is_old"), "k").select("label", "is_old", "vector")
    return dealt.mapInPandas(_fold, f"label {label_type}, centroid_no int, vector array<float>")


MODEL, SEEN = "label {t}, centroid_no int, vector array<float>", "label {t}, log_key string"


def model_version(log: DataFrame, root: str, version: str) -> bool:
    """Fold the log rows that no version has seen into the latest centroids, and write them as a new version, whole or not at all; False if the version is there already.

    log: label, log_key, vector. What a version has seen is known by keys, so a late key that sorts early is not lost; only new rows are folded. The manifest's note has the sorted classes.
    """
    spark, kind = log.sparkSession, log.schema["label"].dataType.simpleString()
    known = {r.version for r in versions.manifest(spark, f"{root}/centroids").select("version").collect()}
    if version in known:
        return False
    # rows are marked as seen before the model is written: what a run that died in between has marked belongs to no model, and is not counted
    seen = versions.load_all(spark, f"{root}/seen", SEEN.format(t=kind) + ", version string").filter(F.col("version").isin(*known) if known else F.lit(False))
    new = kept(log.withColumn("log_key", F.col("log_key").cast("string")).join(seen.select("label", "log_key").hint("merge"), ["label", "log_key"], "left_anti"), "log")
    old = versions.load(spark, f"{root}/centroids", MODEL.format(t=kind))
    versions.commit(new.select("label", "log_key", F.lit(version).alias("version")), f"{root}/seen", f"{version}-{uuid.uuid4().hex}")
    centres = kept(centroids(new, old), "centroids")
    classes = centres.agg(F.array_join(F.array_sort(F.collect_set(F.col("label").cast("string"))), ",")).first()[0]
    return versions.commit(centres, f"{root}/centroids", version, note=classes)


def _by_name(types: DataFrame, *key: str) -> DataFrame:
    return types.groupBy(*key, "doctype_name").agg(F.min("doctype_id").alias("doctype_id"))


def resolved(documents: DataFrame, configs: DataFrame, doctypes: DataFrame) -> DataFrame:
    """The type whose definition extraction uses, found by the name that a document was classified with: rank 1 among the config's expected types (else its old list), the first in that order;
    rank 2 among the public ones and those of the config's account, the least id; without an account among all. Documents without a name, or of type unknown, have none.

    documents: document_id, config_id, doctype. configs: config_id, account_id, expected, old (arrays). doctypes: doctype_id, doctype_name, account_id, is_public. Each rank is a table with
    one row for a name in its scope, so equal names in many accounts are never joined with each other.
    """
    wanted = F.when(F.size("expected") > 0, F.col("expected")).otherwise(F.col("old"))
    listed = configs.select("config_id", F.posexplode(wanted).alias("place", "doctype_id")).join(doctypes.select("doctype_id", "doctype_name").hint("merge"), "doctype_id")
    listed = listed.groupBy("config_id", "doctype_name").agg(F.min_by("doctype_id", "place").alias("listed"))
    public = _by_name(doctypes.filter("is_public")).withColumnRenamed("doctype_id", "public")
    own = _by_name(doctypes.filter("account_id IS NOT NULL"), "account_id").withColumnRenamed("doctype_id", "own")
    every = _by_name(doctypes).withColumnRenamed("doctype_id", "every")
    rows = documents.select("document_id", "config_id", F.col("doctype").alias("doctype_name")).filter("coalesce(doctype_name, '') NOT IN ('', 'unknown')")
    rows = rows.join(configs.select("config_id", "account_id").hint("merge"), "config_id")
    for table, key in ((listed, ["config_id", "doctype_name"]), (own, ["account_id", "doctype_name"]), (public, ["doctype_name"]), (every, ["doctype_name"])):
        rows = rows.join(table.hint("merge"), key, "left")
    fallback = F.when(F.col("account_id").isNull(), F.col("every")).otherwise(F.least("own", "public"))
    rank = F.when(F.col("listed").isNotNull(), 1).otherwise(2)
    return rows.select("document_id", F.coalesce("listed", fallback).alias("doctype_id"), rank.alias("rank")).filter("doctype_id IS NOT NULL")


def choices(configs: DataFrame, doctypes: DataFrame, form: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """For each config the types that its documents may be given by hand, by name: the expected ones, else those of its account and the public ones, else (without an account) all.

    configs: config_id, account_id, expected (array). A config's types are one array of (doctype_name, doctype_id), so documents are joined by config and there is no row for each document and type.
    What a config may choose from hangs on its list or its account alone: arrays are put together, sorted and brought into their form once for each of these, and configs meet them afterwards,
    where they are if all arrays take no more than BROADCAST_BYTES, else in bounded portions.
    Public types are one array, and all types another; both are as long as the catalogue of types.
    """
    kind = F.struct("doctype_name", "doctype_id")
    asks = F.coalesce(F.size("expected"), F.lit(0)) > 0
    expected = F.when(asks, F.sort_array(F.array_distinct("expected"))).alias("expected")
    rows = configs.select("config_id", expected, F.when(~asks, F.col("account_id")).alias("account_id")).withColumn("scope", F.to_json(F.struct("expected", "account_id")))
    scopes = rows.groupBy("scope").agg(F.any_value("expected").alias("expected"), F.any_value("account_id").alias("account_id"), F.count("*").alias("n"))
    listed = scopes.select("scope", F.explode("expected").alias("doctype_id")).join(doctypes.select("doctype_id", "doctype_name").hint("merge"), "doctype_id")
    listed = listed.groupBy("scope").agg(F.collect_list(kind).alias("listed"))
    own = doctypes.filter("NOT is_public AND account_id IS NOT NULL").groupBy("account_id").agg(F.collect_list(kind).alias("own"))
    shared = doctypes.agg(F.collect_list(F.when(F.col("is_public"), kind)).alias("public"), F.collect_list(kind).alias("every"))
    scopes = scopes.join(listed.hint("merge"), "scope", "left").join(own.hint("merge"), "account_id", "left").crossJoin(F.broadcast(shared))  # one row
    nothing = F.array().cast(own.schema["own"].dataType)
    found = F.when(F.col("expected").isNotNull(), F.col("listed")).when(F.col("account_id").isNull(), F.col("every")).otherwise(F.concat(F.coalesce("own", nothing), "public"))
    made = kept(scopes.select("scope", form(F.sort_array(F.coalesce(found, nothing))).alias("choices"), "n"), "choices")
    size, n = made.agg(F.sum(F.octet_length(F.to_json(F.struct("choices")))), F.sum("n")).first()
    rows, made = rows.select("config_id", "scope"), made.drop("n")
    if (size or 0) > BROADCAST_BYTES:
        return spread(rows, made, ["scope"], "config_id").select("config_id", "choices")
    # what a hash table gives is written into the same row each time, while a sort merge join copies its rows; configs are dealt, as what they get is much larger than they are
    dealt = rows.repartition(max(1, min(MOST_TASKS, -(-(n or 0) // ROWS_EACH))), "config_id")
    return dealt.join(F.broadcast(made), "scope").select("config_id", "choices")


def reclassified(documents: DataFrame, picks: DataFrame) -> DataFrame:
    """Documents after a choice by hand: its type, and the step before extraction; or, without a type (`guess`), the step before classification. Unrecognised ones are recognised again.

    documents: document_id, doctype, process, status. picks: document_id, doctype_name, guess; the last of a document's picks by `pick_id` counts, unknown documents are ignored.
    """
    last = picks.groupBy("document_id").agg(F.max_by(F.struct(F.coalesce("doctype_name", F.lit("")).alias("name"), "guess"), "pick_id").alias("pick"))
    rows, chosen = documents.join(last, "document_id", "left"), F.col("pick").isNotNull()
    return rows.withColumns({
        "doctype": F.when(chosen & ~F.col("pick.guess"), F.col("pick.name")).otherwise(F.col("doctype")),
        "process": F.when(chosen, F.when(F.col("pick.guess"), "OCR_READER").otherwise("CLASSIFIER")).otherwise(F.col("process")),
        "status": F.when(chosen & (F.col("status") == "UNRECOGNIZED"), "OCR_DONE").otherwise(F.col("status")),
    }).drop("pick")


#: Types and directions that a proposed field may have.
FIELD_TYPES, DIRECTIONS = ("string", "number", "date", "float", "object", "array"), ("right", "left", "below", "above", "block", "any")


def proposed_fields(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Cleaned fields of a proposed type: snake-case names, known types and directions, no rules for fields that the model reads, no direction without anchors.

    The answer may stand in a code fence.
    """
    from sluice.operators.text import snake_case

    schema = "struct<fields:array<struct<field_name:string,field_type:string,field_description:string,anchors:string,direction:string,regexp:string,use_ia:string>>>"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.col(json)), r"^```(?:json)?\s*", ""), r"(?s)```.*$", ""))
    rows = answers.select("document_id", F.posexplode(F.from_json(bare, schema)["fields"]).alias("n", "f")).select("document_id", "n", "f.*")
    by_model = ~F.lower(F.trim(F.coalesce("use_ia", F.lit("")))).isin("", "0", "false", "null")
    plain = lambda c: F.trim(F.coalesce(c, F.lit("")))
    rule = lambda c: F.when(by_model, "").otherwise(c)
    direction = F.lower(plain("direction"))
    return rows.select(
        "document_id", "n", snake_case(F.coalesce("field_name", F.lit(""))).alias("field_name"), F.when(plain("field_type").isin(*FIELD_TYPES), plain("field_type")).otherwise("string").alias("field_type"),
        plain("field_description").alias("field_description"), rule(plain("anchors")).alias("anchors"),
        rule(F.when(direction.isin(*DIRECTIONS) & (plain("anchors") != ""), direction).otherwise("")).alias("direction"), rule(plain("regexp")).alias("regexp"), by_model.alias("use_ia"),
    ).filter("field_name <> ''")
