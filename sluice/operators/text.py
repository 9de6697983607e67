"""Line and page tables of read documents: cleaning, assembly, quality, zones, chunks, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.unicode import normal_form


def flat_lines(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Nested pages of base64 lines as rows: document_id, page, line_no, text, x0, y0, x1, y1. Undecodable and empty lines are left out."""
    rows = documents.select("document_id", F.explode(pages).alias("p")).select("document_id", F.col("p.page").alias("page"), F.posexplode("p.lines").alias("line_no", "l"))
    text = F.trim(F.coalesce(F.try_to_binary("l.text", F.lit("base64")).cast("string"), F.lit("")))
    return rows.select("document_id", "page", "line_no", text.alias("text"), *[F.coalesce(f"l.position.{c}", F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")]).filter("text <> ''")


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines with single spaces and no control characters, if two characters are left."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("text", r"[\x09-\x0D\x20]+", " "), r"[\x00-\x1F\x7F]", ""))
    return lines.withColumn("text", clean).filter(F.length("text") >= 2)


def markdown(lines: DataFrame, own: DataFrame) -> DataFrame:
    """One text for each document: every page under its header, the provider's markdown if there is any, else the lines.

    own: document_id, page, markdown.
    """
    joined = lines.filter("text <> ''").groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    pages = joined.join(own.hint("merge"), ["document_id", "page"], "full_outer")
    body = F.coalesce(F.nullif(F.trim("markdown"), F.lit("")), F.array_join(F.transform("l", lambda x: x["text"]), "\n"), F.lit(""))
    parts = pages.select("document_id", F.struct("page", F.format_string("[PAGE %d]\n%s", F.col("page"), body).alias("t")).alias("part"))
    return parts.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["t"]), "\n\n").alias("markdown"))


def block_lines(answers: DataFrame, json: str = "answer") -> DataFrame:
    """LINE blocks with text and a readable box of a provider's answer, as lines in percent of the page."""
    schema = "struct<Blocks:array<struct<BlockType:string,Text:string,Page:int,Geometry:struct<BoundingBox:struct<Left:double,Top:double,Width:double,Height:double>>>>>"
    rows = answers.select("document_id", F.posexplode(F.from_json(json, schema)["Blocks"]).alias("line_no", "b")).filter("b.BlockType = 'LINE' and coalesce(b.Text, '') <> ''")
    box = "b.Geometry.BoundingBox"
    pct = lambda c: F.round(c * 100, 4)
    out = rows.select(
        "document_id", "line_no", F.coalesce("b.Page", F.lit(1)).alias("page"), F.col("b.Text").alias("text"),
        pct(F.col(f"{box}.Left")).alias("x0"), pct(F.col(f"{box}.Top")).alias("y0"), pct(F.col(f"{box}.Left") + F.col(f"{box}.Width")).alias("x1"), pct(F.col(f"{box}.Top") + F.col(f"{box}.Height")).alias("y1"),
    )
    return out.dropna(subset=["x0", "y0", "x1", "y1"])


def page_markdown(answers: DataFrame, json: str = "answer") -> DataFrame:
    """Markdown of a provider's pages: numbers from 1, image links removed, three and more line ends as two, empty ones left out."""
    rows = answers.select("document_id", F.explode(F.from_json(json, "struct<pages:array<struct<index:int,markdown:string>>>")["pages"]).alias("p"))
    text = F.trim(F.regexp_replace(F.regexp_replace("p.markdown", r"!\[[^\]]*\]\([^)]*\)", ""), r"\n{3,}", "\n\n"))
    return rows.select("document_id", (F.col("p.index") + 1).alias("page"), text.alias("markdown")).filter("markdown <> ''")


def word_lines(words: DataFrame, least: int = 30) -> DataFrame:
    """Words of enough confidence grouped into lines: text in order, and the box around them."""
    good = words.filter((F.col("confidence") >= least) & (F.trim("text") != ""))
    grouped = good.groupBy("document_id", "page", "block", "paragraph", "line").agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("w"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return grouped.withColumn("text", F.array_join(F.transform("w", lambda x: x["text"]), " ")).drop("w")


def choose_engine(lines: DataFrame, enough: int = 500, failed: DataFrame | None = None) -> DataFrame:
    """local or remote for each document: local if its text is long enough, longer than the remote one, or the remote engine failed.

    lines: document_id, engine, text; failed: document_id of failed remote readings. A remote reading without text wins over a local one without.
    """
    size = lambda e: F.coalesce(F.sum(F.when(F.col("engine") == e, F.length("text"))), F.lit(0)).alias(e)
    scores = lines.groupBy("document_id").agg(size("local"), size("remote"))
    ok = F.lit(True)
    if failed is not None:
        scores = scores.join(failed.select("document_id").distinct().withColumn("__failed", F.lit(True)), "document_id", "left")
        ok = F.col("__failed").isNull()
    return scores.select("document_id", "local", "remote", F.when(F.col("local") >= enough, "local").when(ok & (F.col("remote") >= F.col("local")), "remote").otherwise("local").alias("engine"))


def page_kind(n_chars: Column, has_image: Column) -> Column:
    return F.when((n_chars < 20) & has_image, "SCAN").when(n_chars >= 200, "NATIVE").when(has_image, "HYBRID").otherwise("NATIVE")


def empty_bands(boxes: DataFrame, most_covered: float = 0.7) -> DataFrame:
    """Bands (top, bottom) of each page that no text box covers; none where text covers most of the page; all of a page without boxes.

    boxes: document_id, page, y0, y1 (null for a page without text), area (share of the page).
    """
    page = Window.partitionBy("document_id", "page")
    down = page.orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    rows = boxes.withColumn("above", F.coalesce(F.max("y1").over(down), F.lit(0.0))).withColumn("covered", F.coalesce(F.sum("area").over(page), F.lit(0.0)))
    between = rows.filter(F.col("y0") > F.col("above")).select("document_id", "page", F.col("above").alias("top"), F.col("y0").alias("bottom"), "covered")
    ends = rows.groupBy("document_id", "page").agg(F.coalesce(F.max("y1"), F.lit(0.0)).alias("top"), F.max("covered").alias("covered")).filter("top < 100")
    ends = ends.select("document_id", "page", "top", F.lit(100.0).alias("bottom"), "covered")
    return between.unionByName(ends).filter(F.col("covered") <= most_covered).drop("covered")


def barcode_lines(lines: DataFrame, barcodes: DataFrame) -> DataFrame:
    """Lines with the barcodes of their page appended as tagged lines, one for each value. barcodes: document_id, page, n, value, x0, y0, x1, y1."""
    first = F.row_number().over(Window.partitionBy("document_id", "page", "value").orderBy("n"))
    shown = barcodes.filter("coalesce(value, '') <> '' and x0 is not null").withColumn("r", first).filter("r = 1")
    pages = lines.groupBy("document_id", "page").agg(F.max("line_no").alias("last"))
    tagged = shown.join(pages.hint("merge"), ["document_id", "page"]).select("document_id", "page", (F.col("last") + 1 + F.col("n")).alias("line_no"), F.concat(F.lit("[BARCODE] "), "value").alias("text"), "x0", "y0", "x1", "y1")
    return lines.select("document_id", "page", "line_no", "text", "x0", "y0", "x1", "y1").unionByName(tagged)


def barcodes_by_page(barcodes: DataFrame) -> DataFrame:
    return barcodes.groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value", "format"))), lambda x: F.struct(x["value"].alias("value"), x["format"].alias("format"))).alias("barcodes"))


def clean(text: Column) -> Column:
    """Compatibility forms made plain (NFKC), spaces and line ends evened out. Only texts beyond ASCII go to Python."""
    t = F.coalesce(normal_form(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)
    t = F.regexp_replace(F.regexp_replace(t, r"\r\n?", "\n"), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def structural(text: Column) -> Column:
    """Page marks as spaces."""
    return F.regexp_replace(text, r"\[PAGE\s+\d+\]", " ")


def for_vectors(text: Column, most: int) -> Column:
    return smart_cut(structural(clean(text)), most)


def smart_cut(text: Column, most: int, least_share: float = 0.6) -> Column:
    """At most `most` characters, ended before the last full stop or line end, if that is far enough on."""
    cut = F.substring(text, 1, most)
    back = F.reverse(cut)
    at = lambda c: F.when(F.locate(c, back) > 0, F.length(cut) - F.locate(c, back)).otherwise(0)
    last = F.greatest(at("."), at("\n"))
    return F.when(F.length(text) <= most, text).when(last > most * least_share, F.substring(cut, F.lit(1), last)).otherwise(cut)


def token_chunks(documents: DataFrame, size: int = 800, step: int = 680) -> DataFrame:
    """Overlapping windows of whitespace tokens: chunk_no from 0, chunk, chunk_id (its digest)."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = documents.select("document_id", words.alias("w")).filter(F.size("w") > 0)
    rows = rows.select("document_id", "w", F.posexplode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - (size - step), F.lit(0)), F.lit(step))).alias("chunk_no", "at"))
    return _digested(rows.select("document_id", "chunk_no", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ").alias("chunk")))


def plain_chunks(documents: DataFrame, chars: int = 3_200) -> DataFrame:
    """Slices of characters without overlap, for when there is no tokenizer."""
    rows = documents.filter(F.length("text") > 0).select("document_id", "text", F.posexplode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(chars))).alias("chunk_no", "at"))
    return _digested(rows.select("document_id", "chunk_no", F.substring("text", F.col("at") + 1, F.lit(chars)).alias("chunk")))


def _digested(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_id", F.sha2("chunk", 256))


#: Accented Latin letters and what they become.
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def snake_case(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def tolerant_json(text: Column) -> Column:
    """The JSON object in a model's answer as text: the fence removed, else from the first brace to the last, else {}."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    ok = lambda c: F.try_parse_json(c).isNotNull() & c.startswith("{")
    return F.when(ok(bare), bare).when((inner != "") & ok(inner), inner).otherwise("{}")


def word_table_score(words: DataFrame) -> DataFrame:
    """The best preprocessing profile of each page: the largest sum of confidences of words with two characters and 40 of confidence; the first on ties."""
    good = (F.length(F.trim("text")) >= 2) & (F.col("confidence") >= 40)
    scores = words.groupBy("document_id", "page", "profile_no", "profile").agg(F.sum(F.when(good, F.col("confidence")).otherwise(0)).alias("score"))
    return scores.groupBy("document_id", "page").agg(F.max_by("profile", F.struct("score", -F.col("profile_no"))).alias("profile"), F.max("score").alias("score"))
