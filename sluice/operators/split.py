"""Splitting page sequences into logical documents.

pages: document_id, page, and what a strategy looks at. A strategy gives a group number from 1 in page order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Labels of identity documents.
IDENTITY = (
    "passport", "passeport", "id card", "identity card", "carte d'identite", "carte nationale", "cni", "driving", "permis", "carte grise",
    "certificat d'immatriculation", "residence permit", "titre de sejour", "visa", "national id",
)

def _order():
    return Window.partitionBy("document_id").orderBy("page")


def _before():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _until():
    return _order().rowsBetween(Window.unboundedPreceding, 0)


def _grouped(pages: DataFrame, cut: Column) -> DataFrame:
    return pages.withColumn("__cut", cut.cast("int")).withColumn("group_no", (F.sum("__cut").over(_until()) + 1).cast("int")).drop("__cut")


def fixed(pages: DataFrame, n: int | Column) -> DataFrame:
    size = n if isinstance(n, Column) else F.lit(n)
    return pages.withColumn("group_no", (F.floor((F.row_number().over(_order()) - 1) / size) + 1).cast("int"))


def separator_cut() -> Column:
    """A page with a separator value that differs from the last one seen, unless no page comes before it."""
    last = F.last("separator", ignorenulls=True).over(_before())
    return F.col("separator").isNotNull() & (last.isNull() | (F.col("separator") != last)) & (F.row_number().over(_order()) > 1)


def by_separator(pages: DataFrame) -> DataFrame:
    return _grouped(pages, separator_cut())


def barcode_zone(x: Column, y: Column) -> Column:
    vertical = F.when(y < 20, "top").when(y < 70, "middle").otherwise("bottom")
    horizontal = F.when(x < 33, "left").when(x < 66, "center").otherwise("right")
    return F.concat_ws("-", vertical, horizontal)


def physical_cut() -> Column:
    """The first barcode differs in value or signature from that of the last page with one, or page 1 is read after another number.

    barcode: struct of value and signature, null on pages without; the struct is carried whole, since a value may be null.
    """
    last = F.last("barcode", ignorenulls=True).over(_before())
    b = F.col("barcode")
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    changed = (filled(b["value"]) & filled(last["value"]) & (b["value"] != last["value"])) | (filled(b["signature"]) & filled(last["signature"]) & (b["signature"] != last["signature"]))
    number = F.last("number", ignorenulls=True).over(_before())
    reset = (F.col("number") == 1) & number.isNotNull() & (number != 0)
    return (F.coalesce(b.isNotNull() & changed, F.lit(False)) | F.coalesce(reset, F.lit(False))) & (F.row_number().over(_order()) > 1)


def physical(pages: DataFrame) -> DataFrame:
    return _grouped(pages, physical_cut())


def page_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)page\s+(\d+)", 1).try_cast("int")


def by_priority(pages: DataFrame) -> DataFrame:
    """Fixed pages before separators before physical signs, in one pass. pages also has fixed_pages (0: off) and uses_separator."""
    n = F.row_number().over(_order())
    cut = (
        F.when(F.col("fixed_pages") > 0, (n > 1) & ((n - 1) % F.greatest("fixed_pages", F.lit(1)) == 0))
        .when(F.col("uses_separator"), separator_cut())
        .otherwise(physical_cut())
    )
    return _grouped(pages, cut)


def separator_scope(configs: DataFrame, fields: DataFrame) -> DataFrame:
    """Separator fields of the configs that expect exactly one type. configs: config_id, expected (array); fields: doctype_id, field_name, is_separator."""
    one = configs.filter(F.size("expected") == 1).select("config_id", F.element_at("expected", 1).alias("doctype_id"))
    return one.join(fields.filter("is_separator"), "doctype_id").select("config_id", "doctype_id", "field_name")


def children(groups: DataFrame) -> DataFrame:
    """Child pages of documents with more than one group: child id, its page from 1, the parent's page."""
    several = groups.groupBy("document_id").agg(F.max("group_no").alias("n")).filter("n > 1").select("document_id")
    rows = groups.join(several.hint("merge"), "document_id")
    place = F.row_number().over(Window.partitionBy("document_id", "group_no").orderBy("page"))
    return rows.select(F.format_string("%s_split_%05d", F.col("document_id").cast("string"), "group_no").alias("child_id"), F.col("document_id").alias("parent_id"), place.alias("page"), F.col("page").alias("parent_page"))


def split_documents(groups: DataFrame) -> DataFrame:
    """Documents after a split: children as read, their parents replaced, and documents that stay whole."""
    made = children(groups).groupBy("child_id", "parent_id").agg(F.count("*").alias("pages"))
    parents = groups.groupBy("document_id").agg(F.max("group_no").alias("n"), F.count("*").alias("pages"))
    own = parents.select(F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.when(F.col("n") > 1, "DEPRECATED").otherwise("OCR_DONE").alias("status"), "pages")
    return own.unionByName(made.select(F.col("child_id").alias("document_id"), F.col("parent_id").cast("string").alias("parent_id"), F.lit("OCR_DONE").alias("status"), "pages"))


def detected(answers: DataFrame, least: float = 0.4, json: str = "answer") -> DataFrame:
    """Sub-documents that a detector saw: identity labels, a box of some size on the page, enough confidence (1 where none can be read).

    The answer holds documents of type, confidence and bbox (x, y, w, h in percent, as numbers or text).
    """
    schema = "struct<documents:array<struct<type:string,confidence:string,bbox:struct<x:string,y:string,w:string,h:string>>>>"
    rows = answers.select("document_id", F.inline(F.from_json(json, schema)["documents"]))
    label = F.lower(F.trim(F.coalesce("type", F.lit("document"))))
    named = F.exists(F.array(*[F.lit(x) for x in IDENTITY]), lambda x: F.contains(label, x))
    read = {c: F.col(f"bbox.{c}").try_cast("double") for c in "xywh"}
    rows = rows.withColumns({"confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(1.0)), **read})
    box = F.col("x").between(0, 100) & F.col("y").between(0, 100) & (F.col("w") > 0) & (F.col("w") <= 100) & (F.col("h") > 0) & (F.col("h") <= 100)
    kept = rows.filter(named & box & (F.col("confidence") >= least))
    out = kept.select("document_id", F.coalesce("type", F.lit("document")).alias("label"), F.round("confidence", 3).alias("confidence"), *[F.round(c, 1).alias(c) for c in "xywh"])
    return out.withColumn("is_multi", F.count("*").over(Window.partitionBy("document_id")) > 1)


def needs_barcodes(documents: DataFrame, configs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents of configs with a type that has a barcode field. configs: config_id, doctype_id; fields: doctype_id, bcr_type."""
    asking = configs.join(fields.filter("trim(coalesce(bcr_type, '')) <> ''").select("doctype_id").distinct(), "doctype_id", "left_semi")
    return documents.join(asking.select("config_id").distinct(), "config_id", "left_semi")
