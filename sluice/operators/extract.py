"""Field extraction on the line table.

lines: document_id, page, line_no, text, x0, y0, x1, y1. fields: doctype, field_name and their rules. Values are one row
for each document (or page) and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions.labels import SEPARATORS, following
from sluice.operators.beside import beside, if_few
from sluice.operators.nearby import BOX, nearest
from sluice.sources.scratch import kept


def route(fields: DataFrame) -> DataFrame:
    """model, rules or skipped, by what a field defines."""
    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    rules = filled("regexp") | filled("anchors") | filled("bcr_type") | filled("zone") | filled("page_zone")
    return fields.withColumn("strategy", F.when(F.coalesce(F.col("use_ia"), F.lit(False)), "model").when(rules, "rules").otherwise("skipped"))


def pattern(reg: str) -> str:
    """A pattern in Java's form: `/body/i` becomes a pattern that ignores case."""
    if not reg.startswith("/"):
        return reg
    body, _, flags = reg[1:].rpartition("/")
    return f"(?iu){body}" if "i" in flags else body


def first_match(lines: DataFrame, reg: str, name: str) -> DataFrame:
    """The first line's match of a pattern, in page and line order. The pattern is a constant, so that lines are filtered where they are read."""
    reg = pattern(reg)
    hits = lines.filter(F.col("text").rlike(reg)).withColumn("value", F.regexp_extract("text", reg, 0)).filter("value <> ''")
    return hits.groupBy("document_id").agg(F.min_by("value", F.struct("page", "line_no")).alias("value")).withColumn("field_name", F.lit(name))


def regex_fields(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Values of several fields, in one pass over the lines: each line is matched against all patterns and only hits are kept."""
    fields = {n: pattern(r) for n, r in fields.items()}
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("field_name"), F.regexp_extract("text", r, 0).alias("value")) for n, r in fields.items()]), lambda x: x["value"] != "")
    rows = lines.filter(" or ".join(f"text rlike {_literal(r)}" for r in fields.values())).select("document_id", "page", "line_no", F.inline(hits))
    return rows.groupBy("document_id", "field_name").agg(F.min_by("value", F.struct("page", "line_no")).alias("value"))


def _literal(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def zone(text: Column) -> Column:
    """x1, y1, x2, y2 of a zone of four whole numbers, else null."""
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda x: x.isNull()), parts)


def zone_match(lines: DataFrame, reg: str, box: tuple[int, int, int, int]) -> DataFrame:
    """As first_match, on lines whose right and top edges lie in the zone."""
    x1, y1, x2, y2 = box
    return first_match(lines.filter(F.col("x1").between(x1, x2) & F.col("y0").between(y1, y2)), reg, "zone").drop("field_name")


def anchor_terms(anchors: str) -> list[str]:
    return [a.strip().lower() for a in anchors.replace("|", ",").split(",") if a.strip()]


#: Numbers that are summed up in one fold: each of its steps copies all that it holds.
SUMS_EACH = 32


def _bound(value: Column, use) -> Column:
    """use(value), where the value is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _running(numbers: Column) -> Column:
    """The sums of the first number, the first two and so on, by portions, so that the work grows with their number."""
    sums = lambda v, start: F.aggregate(v, F.array(start), lambda held, x: F.concat(held, F.array(F.element_at(held, -1) + x)))
    portions = lambda v: F.transform(F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(SUMS_EACH)), lambda at: F.slice(v, at + 1, F.lit(SUMS_EACH)))
    starts = lambda p: F.slice(sums(F.transform(p, lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)), F.lit(0)), F.lit(1), F.size(p))
    return _bound(_bound(numbers, portions), lambda p: F.flatten(F.zip_with(p, starts(p), lambda v, start: F.slice(sums(v, start), F.lit(2), F.size(v)))))


def _places(found: Column, parts: Column) -> Column:
    """Start (from 0) and text of each match, from the matches and the parts of the text between them."""
    ends = lambda hits: _running(F.zip_with(F.slice(parts, F.lit(1), F.size(hits)), hits, lambda gap, hit: F.length(gap) + F.length(hit)))
    return _bound(found, lambda hits: F.zip_with(ends(hits), hits, lambda end, hit: F.struct((end - F.length(hit)).alias("at"), hit.alias("hit"))))


def same_line(lines: DataFrame, reg: str, anchors: str, direction: str = "right", max_distance: int = 0) -> DataFrame:
    """The match nearest to an anchor on its own line, for the longest anchor that has one on the page.

    All occurrences of the anchor on all lines of the page are looked at. A match's distance is from the anchor's end to its own start, at most
    3 * max_distance characters (0: any); right asks for matches after the anchor, left for those before it. Of equal ones the first on the page counts.

    Marks and matches of a line are put in one order. Of the pairs of a mark and a match the nearest are neighbours in it, since what lay
    between the two would be nearer to one of them, so that a line's work grows with their number and not with that of their pairs.
    """
    reg = pattern(reg)
    terms = sorted(anchor_terms(anchors), key=lambda a: -len(a))
    low, budget = F.lower("text"), 3 * max_distance
    found = F.filter(_places(F.regexp_extract_all("text", F.lit(reg), F.lit(0)), F.split("text", reg, -1)), lambda x: (x["hit"] != "") & x["at"].isNotNull())
    event = lambda place, kind, at, hit: F.struct(place.alias("place"), F.lit(kind).alias("kind"), at.alias("at"), hit.alias("hit"))

    def nearest(i: int, term: str, matches: Column) -> Column:
        marks = _bound(F.split(low, rf"\Q{term}\E", -1), lambda parts: _places(F.array_repeat(F.lit(term), F.size(parts) - 1), parts))
        # a mark stands at the character that matches are held against, before a match that begins there
        marks = F.transform(marks, lambda x: event(x["at"] + (0 if direction == "left" else len(term)), 0, x["at"], F.lit("")))
        events = F.sort_array(F.concat(marks, F.transform(matches, lambda m: event(m["at"], 1, m["at"], m["hit"]))))

        def pair(mark: Column, match: Column) -> Column:
            far = F.abs(match["at"] - mark["at"] - len(term))
            made = F.struct(F.lit(i).alias("term"), far.alias("far"), F.col("line_no"), mark["at"].alias("mark"), match["at"].alias("at"), match["hit"].alias("value"))
            ok = (mark["kind"] == 0) & (match["kind"] == 1)
            return F.when(ok & (far <= budget) if budget else ok, made)

        after, before = (lambda x, y: pair(x, y)), (lambda x, y: pair(y, x))
        of = {"right": after, "left": before}.get(direction, lambda x, y: F.coalesce(after(x, y), before(x, y)))
        return _bound(events, lambda e: F.array_min(F.zip_with(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), F.slice(e, F.lit(2), F.greatest(F.size(e) - 1, F.lit(0))), of)))

    held = lines.filter(F.col("text").rlike(reg)).filter(" or ".join(["false", *(f"contains(lower(text), {_literal(t)})" for t in terms)]))
    best = _bound(found, lambda m: F.array_min(F.array(*[nearest(i, t, m) for i, t in enumerate(terms)])))
    rows = held.select("document_id", "page", best.alias("best"))
    # a filter on `best` of lines would have it worked out twice
    return rows.groupBy("document_id", "page").agg(F.min("best").alias("b")).filter("b is not null").select("document_id", "page", "b.value")


def nearest_line(lines: DataFrame, reg: str, anchors: str, direction: str | None = None, max_distance: int = 0) -> DataFrame:
    """The match on the line nearest to an anchor's line: distance, 1000 for the wrong side, five times the vertical gap.

    Both sides are filtered first, and the join has the page as its key, so pages are compared within themselves only.
    """
    reg = pattern(reg)
    return _neighbours(lines, lines.filter(F.col("text").rlike(reg)).withColumn("value", F.regexp_extract("text", reg, 0)), anchors, direction, max_distance)


def _neighbours(lines: DataFrame, items: DataFrame, anchors: str, direction: str | None, max_distance: int) -> DataFrame:
    """The value of the item nearest to a line with an anchor, on each page. items: lines with a value."""
    low = F.lower("text")
    hit = F.lit(False)
    for t in anchor_terms(anchors):
        hit = hit | low.contains(t)
    marks = lines.filter(hit).select("document_id", "page", F.col("line_no").alias("a_no"), *[F.col(c).alias(f"a{c}") for c in BOX], F.lit(direction).cast("string").alias("direction"), F.lit(max_distance).alias("max_distance"))
    return nearest(marks, items, ["document_id", "page"])


def _without_separators(text: Column) -> Column:
    return F.regexp_replace(F.ltrim(text, F.lit(SEPARATORS)), r"^\s+|\s+$", "")


#: Pages whose anchors stand alone, up to which their numbers (two to a page) are sent to where all lines are.
FEW_PAGES = 200_000


def after_anchor(lines: DataFrame, anchors: str, direction: str = "right", max_distance: int = 0) -> DataFrame:
    """The rest of the line after the longest anchor, without separators, up to the next `Label :`; else the nearest line on the wanted side.

    The second way is for pages whose anchors stand alone on their lines; distances are as in nearest_line.
    """
    terms = sorted(anchor_terms(anchors), key=lambda a: -len(a))
    low = F.lower("text")
    tried = F.array(*[F.struct(F.lit(i).alias("term"), (F.locate(t, low) + len(t)).alias("from"), (F.locate(t, low) > 0).alias("ok")) for i, t in enumerate(terms)])
    # lines with an anchor are written once; what follows needs all lines of a page only where anchors stand alone
    held = lines.filter(" or ".join(["false", *(f"contains(lower(text), {_literal(t)})" for t in terms)]))
    rows = held.select("document_id", "page", "line_no", *BOX, "text", F.posexplode(F.filter(tried, lambda x: x["ok"])).alias("nth", "x"))
    rest = following(F.substring("text", F.col("x.from"), F.length("text")))
    rows = kept(rows.select("document_id", "page", "line_no", *BOX, "nth", F.col("x.term").alias("term"), rest.alias("value")), "anchored")
    page = ["document_id", "page"]
    own = rows.filter("value <> ''").groupBy(*page).agg(F.min_by("value", F.struct("term", "line_no")).alias("value"))
    alone = kept(rows.select(*page).distinct().join(own.hint("merge"), page, "left_anti"), "alone")
    marks = rows.filter("nth = 0").join(alone.hint("merge"), page, "left_semi")
    marks = marks.select(*page, F.col("line_no").alias("a_no"), *[F.col(c).alias(f"a{c}") for c in BOX], F.lit(direction).cast("string").alias("direction"), F.lit(max_distance).alias("max_distance"))
    there = lines.join(if_few(alone, most=FEW_PAGES, other="merge"), page, "left_semi")
    items = kept(there.select(*page, "line_no", *BOX, _without_separators(F.col("text")).alias("value")).filter("value <> ''"), "beside-anchors")
    return own.unionByName(nearest(marks, items, page))


def barcode_value(barcodes: DataFrame, wanted: str, reg: str | None = None) -> DataFrame:
    """The first barcode of the wanted format (case, spaces and _ do not matter), else any; a pattern and a value are asked for."""
    plain = lambda c: F.lower(F.translate(F.coalesce(c, F.lit("")), " _", ""))
    good = barcodes.filter(F.coalesce(F.col("value"), F.lit("")) != "")
    if reg:
        good = good.filter(F.col("value").rlike(reg))
    exact = plain(F.col("format")) == wanted.lower().replace(" ", "").replace("_", "")
    return good.groupBy("document_id", "page").agg(F.min_by("value", F.struct((~exact).alias("other"), "n")).alias("value"))


STRATEGIES = ("barcode", "anchor", "zone", "regex")


def winners(candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """For each document, page and field the value of the first strategy that has one; a black-listed word in it gives the default.

    candidates: document_id, page, field_name, strategy, value. fields: field_name, black_words, default_value.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    best = candidates.filter("coalesce(value, '') <> ''").groupBy("document_id", "page", "field_name").agg(F.min_by("value", order).alias("value"))
    out = best.join(if_few(fields.select("field_name", "black_words", "default_value")), "field_name")
    words = F.filter(F.split(F.lower(F.coalesce("black_words", F.lit(""))), r"\|"), lambda w: w != "")
    bad = F.exists(words, lambda w: F.contains(F.lower("value"), w))
    return out.select("document_id", "page", "field_name", F.when(bad, F.coalesce("default_value", F.lit(""))).otherwise(F.col("value")).alias("value"))


def across_pages(values: DataFrame, fields: DataFrame, documents: DataFrame) -> DataFrame:
    """The value of the first page that has one other than the default, else the default, for every document and field."""
    default = F.coalesce("default_value", F.lit(""))
    known = values.join(if_few(fields.select("field_name", default.alias("d"))), "field_name").filter("value <> '' and value <> d")
    first = known.groupBy("document_id", "field_name").agg(F.min_by("value", "page").alias("value"))
    every = beside(documents.select("document_id").distinct(), fields.select("field_name", default.alias("d")))
    return every.join(first.hint("merge"), ["document_id", "field_name"], "left").select("document_id", "field_name", F.coalesce("value", "d").alias("value"))


def _digit(c: Column) -> Column:
    return F.when(c == "<", 0).when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)


def check_digit(text: Column) -> Column:
    """Check digit of machine-readable zones: weights 7, 3, 1 over the characters' values, modulo 10."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    weighed = F.transform(chars, lambda c, i: _digit(c) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + x) % 10


#: Formats of machine-readable zones, in the order in which they are looked for: length and number of lines, then line, first
#: character (from 1) and length of each field, fields with a check digit after them, and the parts of the digit over all.
ZONES = {
    "TD3": (44, 2, {"document_type": (1, 1, 2), "country": (1, 3, 3), "names": (1, 6, 39), "number": (2, 1, 9), "nationality": (2, 11, 3), "born": (2, 14, 6), "sex": (2, 21, 1), "expires": (2, 22, 6), "optional": (2, 29, 14)},
            ("number", "born", "expires"), ((2, 1, 10), (2, 14, 7), (2, 22, 22)), (2, 44)),
    "TD1": (30, 3, {"document_type": (1, 1, 2), "country": (1, 3, 3), "names": (3, 1, 30), "number": (1, 6, 9), "nationality": (2, 16, 3), "born": (2, 1, 6), "sex": (2, 8, 1), "expires": (2, 9, 6), "optional": (1, 16, 15)},
            ("number", "born", "expires"), ((1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)), (2, 30)),
    "TD2": (36, 2, {"document_type": (1, 1, 2), "country": (1, 3, 3), "names": (1, 6, 31), "number": (2, 1, 9), "nationality": (2, 11, 3), "born": (2, 14, 6), "sex": (2, 21, 1), "expires": (2, 22, 6), "optional": (2, 29, 7)},
            ("number", "born", "expires"), ((2, 1, 10), (2, 14, 7), (2, 22, 14)), (2, 36)),
}
#: Lengths may be off by so much, and a line is looked at from so many characters.
OFF, LEAST_ZONE_CHARS = 3, 26


def mrz(lines: DataFrame) -> DataFrame:
    """The machine-readable zone of each document: the last lines of the first format of which there are enough, cut or filled to its length.

    valid says whether all check digits hold, that over all included; the values are given either way, so that callers decide.
    """
    text = F.regexp_replace(F.upper(F.trim("text")), "[ «»“”\"'`]", "<")
    rows = lines.withColumn("t", text).filter(F.col("t").rlike(f"^[A-Z0-9<]{{{LEAST_ZONE_CHARS},}}$"))
    # lines of a document that look like a zone: few
    docs = rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_no", "t"))), lambda x: x["t"]).alias("all"))
    found = None
    for name, (size, n, fields, digits, over, last) in ZONES.items():
        fit = F.filter("all", lambda t: F.abs(F.length(t) - size) <= OFF)
        zone_ = F.transform(F.slice(fit, -n, n), lambda t: F.rpad(F.substring(t, 1, size), size, "<"))
        part = lambda line, first, length: F.substring(F.col("z")[line - 1], first, length)
        clean = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
        of = {f: part(*place) for f, place in fields.items()}
        names = F.split(of.pop("names"), "<<", 2)
        holds = lambda c, digit: check_digit(c).cast("string") == F.translate(digit, "<", "0")
        valid = holds(F.concat(*[part(*x) for x in over]), part(*last, 1))
        for f in digits:
            line, first, length = fields[f]
            valid = valid & holds(part(line, first, length), part(line, first + length, 1))
        if name == "TD3":
            valid = valid & holds(of["optional"], part(2, 43, 1))
        made = F.struct(F.lit(name).alias("format"), *[clean(c).alias(f) for f, c in of.items()], clean(names[0]).alias("surname"), clean(F.coalesce(F.try_element_at(names, F.lit(2)), F.lit(""))).alias("given"), valid.alias("valid"))
        one = docs.filter(F.size(fit) >= n).select("document_id", zone_.alias("z")).select("document_id", F.lit(len(found or ())).alias("order"), made.alias("m"))
        found = [*(found or []), one]
    every = found[0].unionByName(found[1]).unionByName(found[2])
    return every.groupBy("document_id").agg(F.min_by("m", "order").alias("m")).select("document_id", "m.*")


def model_answers(documents: DataFrame, fields: DataFrame, json: str = "answer") -> DataFrame:
    """Value and score of every field: objects as they are, bare texts with 0.5 (empty 0.0), missing ones empty with 0.0."""
    parsed = documents.select("document_id", F.from_json(json, "map<string,string>").alias("m"))
    rows = beside(parsed, fields.select("field_name"))
    raw = F.col("m")[F.col("field_name")]
    inner = F.get_json_object(raw, "$.value")
    is_object = raw.startswith("{")
    value = F.coalesce(F.when(is_object, inner).otherwise(raw), F.lit(""))
    score = F.when(is_object, F.coalesce(F.get_json_object(raw, "$.score").try_cast("double"), F.lit(0.0))).when(F.coalesce(raw, F.lit("")) == "", 0.0).otherwise(0.5)
    return rows.select("document_id", "field_name", value.alias("value"), score.alias("score"))


def merged(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Rule and model values; the model's wins for the same field, and of repeats the last."""
    both = rules.withColumn("rank", F.lit(0)).unionByName(model.withColumn("rank", F.lit(1)))
    return both.groupBy("document_id", "field_name").agg(F.max_by(F.struct("value", "score"), F.struct("rank", "position")).alias("v")).select("document_id", "field_name", "v.*")


def summary(values: DataFrame, fields: DataFrame, documents: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Totals, required fields that are missing, least and mean score, and whether the extraction is good. values: document_id, field_name, value, score (text)."""
    filled = values.filter(F.trim(F.coalesce("value", F.lit(""))) != "").withColumn("s", F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)))
    per = filled.groupBy("document_id").agg(F.count("*").alias("extracted"), F.min("s").alias("least"), F.avg("s").alias("mean"), F.collect_set("field_name").alias("have"))
    needed = fields.agg(F.count("*").alias("total"), F.collect_set(F.when(F.col("required") & (F.col("field_name") != ""), F.col("field_name"))).alias("need"))
    out = documents.select("document_id").distinct().join(per.hint("merge"), "document_id", "left").crossJoin(F.broadcast(needed))  # one row
    missing = F.array_sort(F.array_except("need", F.coalesce("have", F.array().cast("array<string>"))))
    least = F.coalesce("least", F.lit(0.0))
    return out.select(
        "document_id", F.col("total").alias("total_fields"), F.size("need").alias("required_fields"), F.coalesce("extracted", F.lit(0)).alias("extracted_fields"), F.array_join(missing, ",").alias("missing_required"),
        F.round(least, 3).alias("min_score"), F.round(F.coalesce("mean", F.lit(0.0)), 3).alias("avg_score"), ((F.size(missing) == 0) & F.col("extracted").isNotNull() & (least >= threshold)).alias("extraction_ok"),
    )


def validation_status(documents: DataFrame, scores: DataFrame) -> DataFrame:
    """PENDING_VALIDATION or VALIDATED. documents: document_id, need_validation, threshold; scores: document_id, score (text; blank is no score, unreadable is 1)."""
    read = scores.filter(F.coalesce("score", F.lit("")) != "").withColumn("s", F.coalesce(F.col("score").try_cast("double"), F.lit(1.0)))
    least = read.groupBy("document_id").agg(F.min("s").alias("least"))
    out = documents.join(least, "document_id", "left")
    threshold = F.coalesce(F.col("threshold").try_cast("double"), F.lit(0.0))
    doubt = (threshold > 0) & (F.col("least") < threshold)
    return out.select("document_id", F.when(F.coalesce("need_validation", F.lit(True)) | F.coalesce(doubt, F.lit(False)), "PENDING_VALIDATION").otherwise("VALIDATED").alias("status"))


def replace_indexes(indexes: DataFrame, news: DataFrame) -> DataFrame:
    """Extracted rows of documents that were read again give way to the new rows that have a value."""
    again = news.select("document_id").distinct().withColumn("again", F.lit(True))
    kept = indexes.join(again.hint("merge"), "document_id", "left").filter((F.col("index_type") != "extracted") | F.col("again").isNull()).drop("again")
    fresh = news.filter("trim(coalesce(index_value, '')) <> ''").withColumn("index_type", F.lit("extracted"))
    return kept.unionByName(fresh.select(*kept.columns))


#: What a service may answer for yes and no.
YES, NO = ("true", "1", "ok", "found", "valid", "yes"), ("false", "0", "not_found", "invalid", "no")


def _asked(indexes: DataFrame, definitions: DataFrame, replies: DataFrame) -> DataFrame:
    # a reply is read once, for all keys that definitions of its name ask for, and not for each row that it answers
    keys = definitions.select("name", F.explode(F.concat(F.array("status_key"), F.coalesce(F.map_values("mapping"), F.array().cast("array<string>")))).alias("key"))
    keys = keys.groupBy("name").agg(F.collect_set("key").alias("keys"))
    read = F.transform("keys", lambda k: F.struct(k.alias("k"), F.call_function("get_json_object", F.col("reply"), F.concat(F.lit("$."), k)).alias("v")))
    answers = replies.join(if_few(keys, other="merge"), "name").select("name", "value", "reply", F.map_from_entries(read).alias("told"))
    # a few types and values may hold all rows: they are joined where they are, as long as there are few definitions and replies
    asked = indexes.join(if_few(definitions, other="merge"), ["doctype", "field_name"]).join(if_few(answers, other="merge"), ["name", "value"], "left")
    read = asked.withColumn("word", F.lower(F.trim(F.col("told")[F.col("status_key")])))
    by_key = F.when(F.coalesce("word", F.lit("")) == "", "INVALID").when(F.col("word").isin(*NO), "INVALID").otherwise("VALID")
    bare = F.trim("reply")
    some = F.when(bare.isin("", "null", "{}", "[]", "false", "0", '""'), "UNKNOWN").otherwise("VALID")
    keyed = (F.coalesce("status_key", F.lit("")) != "") & bare.startswith("{")
    return read.withColumn("state", F.when(F.col("reply").isNull(), "ERROR").when(keyed, by_key).otherwise(some)).drop("word")


def enrich(indexes: DataFrame, definitions: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows that enrichment adds: a status row `<field>__consolidation_status` and a row for each mapped entry of a reply.

    indexes: document_id, doctype, field_name, value. definitions: name, doctype, field_name, status_key, mapping (name -> key), on_failure (skip or
    error). replies: name, value, reply (JSON); a missing reply is an error. With a status key the reply's value there decides, else whether there is
    a reply at all. A document for which a definition of mode `error` fails gets no rows: see `enrichment_failures`.
    """
    rows = _asked(indexes, definitions, replies)
    stops = F.col("document_id").isNotNull() & (F.col("state") == "ERROR") & F.coalesce(F.lower("on_failure") == "error", F.lit(False))
    flag = F.struct(F.concat("field_name", F.lit("__consolidation_status")).alias("index_name"), F.col("state").alias("index_value"))
    told = F.transform(F.map_entries("mapping"), lambda e: F.struct(e["key"].alias("index_name"), F.col("told")[e["value"]].alias("index_value")))
    told = F.filter(told, lambda e: (F.trim(e["index_name"]) != "") & e["index_value"].isNotNull())
    none = F.array().cast("array<struct<index_name:string,index_value:string>>")
    made = F.concat(F.array(flag), F.coalesce(F.when(F.col("state") != "ERROR", told), none))
    # a document's rows meet once; whether it stops and what it adds are both known then
    rows = rows.select("document_id", made.alias("made"), stops.alias("stops")).withColumn("stopped", F.max("stops").over(Window.partitionBy("document_id")))
    return rows.filter("not stopped").select("document_id", F.inline("made"))


def enrichment_failures(indexes: DataFrame, definitions: DataFrame, replies: DataFrame) -> DataFrame:
    """document_id, message and whether the failure stops the document, for every failed call."""
    failed = _asked(indexes, definitions, replies).filter("state = 'ERROR'")
    return failed.select("document_id", F.format_string("WS '%s' pour '%s'", "name", "field_name").alias("message"), F.coalesce(F.lower("on_failure") == "error", F.lit(False)).alias("stops"))


def propagated(transactions: DataFrame, fields: DataFrame, now: Column, zone_name: str = "Europe/Paris") -> DataFrame:
    """Values of propagated fields: of type computed a token, of type context the context's value (exact key, then any case), else the default.

    transactions: transaction_id, config_name, context (map). fields: field_name, source_type, source, default_value.
    """
    local = F.from_utc_timestamp(now, zone_name)
    rows = beside(transactions, fields)
    kind, s = F.lower(F.trim("source_type")), F.lower(F.trim("source"))
    blank = lambda c: F.when(F.trim(c) != "", c)
    tokens = (
        F.when(s == "@today", F.date_format(local, "yyyy_MM_dd")).when(s.isin("@now", "@datetime"), F.date_format(local, "dd/MM/yyyy HH:mm:ss"))
        .when(s == "@year_month", F.date_format(local, "yyyy-MM")).when(s == "@transaction_id", blank(F.col("transaction_id").cast("string"))).when(s == "@config_name", blank(F.col("config_name")))
    )
    loose = F.try_element_at(F.map_values(F.map_filter("context", lambda k, v: (F.lower(k) == s) & (F.trim(v) != ""))), F.lit(1))
    found = F.when(kind == "computed", tokens).when(kind == "context", F.coalesce(blank(F.col("context")[F.trim("source")]), loose))
    return rows.select("transaction_id", "field_name", F.coalesce(found, "default_value", F.lit("")).alias("value"))


def metadata_upsert(metadata: DataFrame, news: DataFrame) -> DataFrame:
    """One row for each document and name with a value; the last one wins. news also has position."""
    good = news.filter("coalesce(index_name, '') <> '' and coalesce(index_value, '') <> ''").groupBy("document_id", "index_name").agg(F.max_by("index_value", "position").alias("index_value"))
    return metadata.join(good.select("document_id", "index_name").hint("merge"), ["document_id", "index_name"], "left_anti").select("document_id", "index_name", "index_value").unionByName(good)


def inherited(children: DataFrame, parents: DataFrame, own: DataFrame) -> DataFrame:
    """A child's rows: its parent's with score 1, and its own, of which two naming styles are one. children: document_id, parent_id."""
    got = children.join(parents.withColumnRenamed("document_id", "parent_id").hint("merge"), "parent_id").select("document_id", "index_type", "index_name", "index_value", F.lit("1").alias("index_score"))
    name, value = F.coalesce(F.nullif("index_name", F.lit("")), "name"), F.coalesce(F.nullif("index_value", F.lit("")), "value")
    mine = own.select("document_id", "index_type", name.alias("index_name"), value.alias("index_value"), "index_score").filter("coalesce(index_name, '') <> ''")
    return got.unionByName(mine)


def deprecated_parents(news: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that new ones replace: of equal id, or of their id without a four or five digit suffix; the first that is there and not new."""
    stem = F.regexp_replace("document_id", r"_\d{4,5}$", "")
    tried = news.select(F.posexplode(F.array(F.col("document_id"), stem)).alias("n", "candidate"), F.col("document_id").alias("new_id"))
    known = documents.filter("not is_new").select(F.col("document_id").alias("candidate"))
    found = tried.join(known.hint("merge"), "candidate").groupBy("new_id").agg(F.min_by("candidate", "n").alias("document_id"))
    return found.select("document_id").distinct()


def corrected(documents: DataFrame, indexes: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents validated by hand, and the rows after it: corrections replace extracted ones with score 1.0; nameless ones are dropped."""
    named = corrections.filter("trim(coalesce(index_name, '')) <> ''").withColumn("index_score", F.lit("1.0"))
    again = corrections.select("document_id").distinct().withColumn("again", F.lit(True))
    kept = indexes.join(again.hint("merge"), "document_id", "left").filter((F.col("index_type") != "extracted") | F.col("again").isNull()).drop("again")
    rows = kept.unionByName(named.withColumn("index_type", F.lit("extracted")).select(*kept.columns))
    docs = documents.join(again.hint("merge"), "document_id", "left").withColumn("status", F.when(F.col("again"), F.lit("VALIDATED")).otherwise(F.col("status"))).drop("again")
    return docs, rows


def sheet(fields: DataFrame, indexes: DataFrame) -> DataFrame:
    """Every defined field once, in order, filled if extracted; other extracted fields after them. fields: document_id, field_name, position."""
    last = F.lit(1_000_000)
    joined = fields.join(indexes.select("document_id", F.col("index_name").alias("field_name"), "index_value").hint("merge"), ["document_id", "field_name"], "full_outer")
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.coalesce("position", last), "field_name"))
    return joined.select("document_id", "field_name", F.coalesce("index_value", F.lit("")).alias("value"), F.col("position").isNotNull().alias("defined"), place.alias("place"))


def extracted_only(indexes: DataFrame) -> DataFrame:
    return indexes.filter("index_type = 'extracted'").orderBy("document_id", "index_name")
