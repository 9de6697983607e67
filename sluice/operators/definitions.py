"""Field values by a table of definitions: every type of document has fields of its own, with patterns, anchors and zones.

The definitions of a type are one row, which lines meet by their type; a line goes through them once. Patterns are compiled once for a worker. Before any of a type's
patterns is tried on a line, one search with all of them in one alternation says whether any fits, and anchors are looked for as plain texts.
A pass gives hits for the strategies: the best of each page is chosen by aggregates, pages whose anchor stands apart from its value by `nearby`.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.labels import SEPARATORS, rest_of_line
from sluice.operators.beside import if_few
from sluice.operators.extract import STRATEGIES
from sluice.operators.nearby import BOX, nearest
from sluice.sources.scratch import kept

DEFINITION = ("doctype", "field_name", "regexp", "anchors", "direction", "max_distance", "zone", "bcr_type", "black_words", "default_value")
HIT = "document_id {d}, page {p}, line_no long, field_name string, role string, place array<long>, value string, direction string, max_distance int, x0 double, y0 double, x1 double, y1 double"


def compiled(reg: str | None) -> re.Pattern | None:
    """`/body/i` ignores case; an empty text, or one that is no pattern, is none."""
    if not reg:
        return None
    body, _, flags = reg[1:].rpartition("/") if reg.startswith("/") else (reg, "", "")
    try:
        return re.compile(body, re.I if "i" in flags else 0)
    except re.error:
        return None


def box(zone: str | None) -> tuple[int, ...] | None:
    try:
        parts = tuple(int(x) for x in (zone or "").split(","))
    except ValueError:
        return None
    return parts if len(parts) == 4 else None


class Field:
    """A definition, read once."""

    def __init__(self, d: dict):
        self.name, self.pattern = d["field_name"], compiled(d.get("regexp"))
        self.terms = [a.strip().lower() for a in (d.get("anchors") or "").replace("|", ",").split(",") if a.strip()]
        self.longest = sorted(self.terms, key=len, reverse=True)
        self.direction, self.zone, self.barcode = d.get("direction") or None, box(d.get("zone")), d.get("bcr_type") or ""
        try:
            self.reach = max(0, int(d.get("max_distance") or 0))
        except ValueError:
            self.reach = 0


@lru_cache(maxsize=4_096)
def fields_of(definitions: str) -> tuple[list[Field], re.Pattern | None]:
    """A type's fields, and one pattern that fits a line if any of theirs does (none where they can't stand in one alternation)."""
    fields = [Field(d) for d in json.loads(definitions)]
    patterns = [f.pattern for f in fields if f.pattern]
    if len(patterns) < 2 or any(p.groups or p.flags & ~re.U & ~re.I or re.match(r"\(\?[a-zA-Z]", p.pattern) for p in patterns):
        return fields, None
    return fields, re.compile("|".join(f"(?i:{p.pattern})" if p.flags & re.I else f"(?:{p.pattern})" for p in patterns))


def same_line(field: Field, text: str, low: str, matches: list[tuple[int, str]], line: int) -> tuple[list[int], str] | None:
    """The match nearest to an anchor of its own line: place (term, distance, line, anchor, match) and value. matches: in order of their starts."""
    best, starts = None, [start for start, _ in matches]
    for i, term in enumerate(field.longest):
        at = low.find(term)
        while at >= 0:
            end = at + len(term)
            # of matches in order, only those next to the anchor can be nearest
            if field.direction == "left":
                near = range((n := bisect_left(starts, at)) - 1, n)
            else:
                near = range((n := bisect_left(starts, end)) - (field.direction not in (None, "right")), n + 1)
            for start, value in (matches[k] for k in near if 0 <= k < len(matches)):
                far = abs(start - end)
                if not field.reach or far <= 3 * field.reach:
                    place = [i, far, line, at, start]
                    best = min(best, (place, value)) if best else (place, value)
            at = low.find(term, end)
        if best:
            return best
    return best


#: Lines that are plain Python values at a time; every line brings the definitions of its type.
LINES_EACH = 1_000


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(at, LINES_EACH) for whole in batches for at in range(0, whole.num_rows, LINES_EACH)):
        rows: list[tuple] = []
        columns = [batch[n].to_pylist() for n in ("line_no", "text", "definitions", *BOX)]
        for i, (line, text, definitions, *place) in enumerate(zip(*columns)):
            text = (text or "").strip()
            if not text:
                continue
            fields, any_ = fields_of(definitions)
            low, fits = text.lower(), any_ is None or any_.search(text) is not None
            for f in fields:
                more = (f.direction, f.reach, *place)
                anchored = any(t in low for t in f.terms)
                if anchored:
                    rows.append((i, line, f.name, "mark", None, None, *more))
                if f.pattern and fits and (m := f.pattern.search(text)) and m.group():
                    rows.append((i, line, f.name, "regex", [line], m.group(), *more))
                    if f.zone and f.zone[0] <= place[2] <= f.zone[2] and f.zone[1] <= place[1] <= f.zone[3]:
                        rows.append((i, line, f.name, "zone", [line], m.group(), *more))
                    if anchored and (own := same_line(f, text, low, [(m.start(), m.group()) for m in f.pattern.finditer(text) if m.group()], line)):
                        rows.append((i, line, f.name, "own", *own, *more))
                elif f.terms and not f.pattern:
                    for n, term in enumerate(f.longest):
                        if (at := low.find(term)) >= 0 and (value := rest_of_line(text[at + len(term) :])):
                            rows.append((i, line, f.name, "own", [n, line], value, *more))
                    if value := text.lstrip(SEPARATORS):
                        rows.append((i, line, f.name, "item", None, value, *more))
        at = pa.array([r[0] for r in rows], pa.int64())
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int32(), *[pa.float64()] * 4]
        made = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch["document_id"].take(at), batch["page"].take(at), *made], names=["document_id", "page", "line_no", "field_name", "role", "place", "value", "direction", "max_distance", *BOX])


def grouped(definitions: DataFrame) -> DataFrame:
    """doctype and all its definitions as one text."""
    one = F.struct(*(F.col(c).cast("string").alias(c) for c in DEFINITION[1:]))
    return definitions.filter("coalesce(field_name, '') <> ''").groupBy("doctype").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("definitions"))


def page_values(lines: DataFrame, documents: DataFrame, definitions: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """The value of every field on every page that has one: document_id, page, field_name, value, by the first strategy that finds one (barcode, anchor, zone, pattern); black-listed ones give the default.

    lines: document_id, page, line_no, text, box. documents: document_id, doctype. barcodes: document_id, page, n, value, format. An anchor's value stands on its own line, else on
    the nearest other line; without a pattern it is the rest of the line, else the nearest line. A document whose type has no definitions has no values.
    """
    held = kept(grouped(definitions), "definitions")
    typed = documents.select("document_id", "doctype").join(if_few(held), "doctype")
    rows = lines.select("document_id", "page", F.col("line_no").cast("long").alias("line_no"), "text", *(F.col(c).cast("double").alias(c) for c in BOX)).join(typed.select("document_id", "definitions").hint("merge"), "document_id")
    schema = HIT.format(d=lines.schema["document_id"].dataType.simpleString(), p=lines.schema["page"].dataType.simpleString())
    hits = kept(rows.mapInArrow(_hits, schema), "hits")
    key = ["document_id", "page", "field_name"]
    own = hits.filter("role IN ('own', 'zone', 'regex')").groupBy(*key, "role").agg(F.min_by("value", "place").alias("value"))
    own = kept(own, "values")
    have = own.filter("role = 'own'").select(*key)
    marks = hits.filter("role = 'mark'").join(have.hint("merge"), key, "left_anti").select(*key, F.col("line_no").alias("a_no"), *(F.col(c).alias(f"a{c}") for c in BOX), "direction", "max_distance")
    # fields without a pattern have items, the others' items are their pattern's hits
    items = hits.filter("role IN ('item', 'regex')")
    near = nearest(marks, items, key)
    named = F.when(F.col("role") == "own", "anchor").otherwise(F.col("role"))
    found = own.select(*key, named.alias("strategy"), "value").unionByName(near.select(*key, F.lit("anchor").alias("strategy"), "value"))
    if barcodes is not None:
        found = found.unionByName(_barcodes(barcodes, documents, definitions).select(*key, F.lit("barcode").alias("strategy"), "value"))
    order = F.array_position(F.array(*(F.lit(s) for s in STRATEGIES)), F.col("strategy"))
    best = found.filter("value <> ''").groupBy(*key).agg(F.min_by("value", order).alias("value"))
    rules = definitions.select("doctype", "field_name", F.coalesce("black_words", F.lit("")).alias("black_words"), F.coalesce("default_value", F.lit("")).alias("default_value"))
    best = best.join(documents.select("document_id", "doctype").hint("merge"), "document_id").join(if_few(rules), ["doctype", "field_name"])
    bad = F.exists(F.filter(F.split(F.lower("black_words"), r"\|"), lambda w: w != ""), lambda w: F.contains(F.lower("value"), w))
    return best.select(*key, F.when(bad, F.col("default_value")).otherwise(F.col("value")).alias("value"))


def _barcodes(barcodes: DataFrame, documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """For fields with a kind of barcode: of those with a value that fits the pattern the first of that kind, else the first of any."""
    wanted = definitions.filter("coalesce(bcr_type, '') <> ''").select("doctype", "field_name", "bcr_type", F.coalesce("regexp", F.lit("")).alias("regexp"))
    rows = barcodes.filter("coalesce(value, '') <> ''").join(documents.select("document_id", "doctype").hint("merge"), "document_id").join(if_few(wanted), "doctype")

    @F.pandas_udf("boolean")
    def fits(values, patterns):
        found = {p: compiled(p) for p in patterns.unique()}
        return values.combine(patterns, lambda v, p: found[p] is None or found[p].search(v) is not None)

    plain = lambda c: F.lower(F.translate(F.coalesce(c, F.lit("")), " _", ""))
    other = plain(F.col("format")) != plain(F.col("bcr_type"))
    return rows.filter(fits("value", "regexp")).groupBy("document_id", "page", "field_name").agg(F.min_by("value", F.struct(other, "n")).alias("value"))


def document_values(values: DataFrame, documents: DataFrame, definitions: DataFrame) -> DataFrame:
    """For every document and field of its type the value of the first page that has one other than the default, else the default."""
    default = F.coalesce("default_value", F.lit("")).alias("d")
    every = documents.select("document_id", "doctype").join(if_few(definitions.select("doctype", "field_name", default)), "doctype")
    # a value that is the default counts as none
    rows = every.join(values.select("document_id", "field_name", "page", F.col("value").alias("v")).hint("merge"), ["document_id", "field_name"], "left")
    good = F.when((F.col("v") != "") & (F.col("v") != F.col("d")), F.col("page"))
    return rows.groupBy("document_id", "field_name").agg(F.coalesce(F.min_by("v", good), F.any_value("d")).alias("value"))
