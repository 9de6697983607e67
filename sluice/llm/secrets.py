"""Secret scans: pattern spans, and a randomness test battery for other tokens.

Patterns find assignments, access keys and long hex strings. Every other run of 20 or more of the letters, digits
and signs that encodings use is a candidate. Its encoding (hex, base32, base64) is inferred from the characters
in it, and three tests ask whether it could be random text of that encoding: chi-squared uniformity over all letters of the
alphabet, a runs test on the halves of the alphabet, and the serial correlation of neighbouring
characters. The tests' p-values are combined (the least of three, times three).

"Not random" is what a test can prove, so the discoveries are the tokens to dismiss. Their false discoveries,
secrets thrown away, are controlled by the Benjamini-Hochberg step-up rule within length classes, since the power
of the tests grows with length. Tokens that are not dismissed and hold at least two kinds of characters become spans of
kind `random`. The step-up rule works on a histogram of p-values (a fixed number of bins for each class), so no ranking
of all tokens is needed.

Only built-in column functions are used. Starts of matches come from the lengths of the parts between them.

Edge cases: a null or empty text has no spans (the digest of the empty string); spans of equal start keep the
order of kinds; repeated doc_ids are ordinary rows; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.common import free_name, stored

# The base patterns.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

LEVEL = 0.05
#: Lower ends of the length classes, and bins of -log10 p (tenths, up to BINS / 10).
LENGTHS, BINS = (20, 24, 32, 48, 64), 400


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs of start, end (exclusive), kind and the matched text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("n"), hit.alias("hit")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,hit:string>>")

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        span = F.struct(start.alias("start"), (start + step["n"]).alias("end"), F.lit(kind).alias("kind"), step["hit"].alias("hit"))
        return F.struct((start + step["n"]).alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), empty.alias("spans")), add)["spans"]
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _value(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN, 2)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal (rational approximation 26.2.17 of Abramowitz and Stegun)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def _chi_tail(x: Column, df: int) -> Column:
    """P(chi-squared with df > x), by the cube-root normal approximation."""
    spread = 2 / (9 * df)
    return _upper_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - spread)) / spread**0.5)


def _count(token: Column, pattern: str) -> Column:
    return F.regexp_count(token, F.lit(pattern)).cast("double")


def battery(token: Column) -> dict[str, Column]:
    """The inferred encoding and the p-values of the three tests."""
    n = F.length(token).cast("double")
    is_hex = token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$")
    is_b32 = token.rlike(r"^[A-Z2-7]+=*$")
    encoding = F.when(is_hex, "hex").when(is_b32, "base32").otherwise("base64")

    # over k letters the statistic is k / n times the sum of squared counts, less n; counts are runs in the sorted letters
    letters = F.filter(F.split(F.regexp_replace(F.when(is_hex, F.lower(token)).otherwise(token), "=+$", ""), ""), lambda c: c != "")
    counts = F.regexp_extract_all(F.array_join(F.array_sort(letters), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + F.length(c) * F.length(c))
    size = F.size(letters).cast("double")
    chi = lambda k: _chi_tail(F.lit(float(k)) / size * squares - size, k - 1)
    uniform = F.when(size < 1, 1.0).when(is_hex, chi(16)).when(is_b32, chi(32)).otherwise(chi(64))
    low = F.when(is_hex, F.regexp_replace(token, "[0-7]", "0")).when(is_b32, F.regexp_replace(token, "[A-P]", "0")).otherwise(F.regexp_replace(token, "[A-Za-f]", "0"))
    halves = F.regexp_replace(low, "[^0]", "1")
    ones = _count(halves, "1")
    zeros = n - ones
    runs = _count(halves, "0+") + _count(halves, "1+")
    expected = 2 * ones * zeros / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs_p = F.when(variance > 0, 2 * _upper_tail(F.abs(runs - expected) / F.sqrt(F.greatest(variance, F.lit(1e-9))))).otherwise(F.lit(0.0))
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))
    mean = F.aggregate(codes, F.lit(0.0), lambda s, c: s + c) / n
    spread = F.aggregate(codes, F.lit(0.0), lambda s, c: s + (c - mean) * (c - mean))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: (a - mean) * (b - mean))
    serial = F.aggregate(pairs, F.lit(0.0), lambda s, c: s + c)
    serial_p = F.when(spread > 0, 2 * _upper_tail(F.abs(serial / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
    return {"encoding": encoding, "uniform_p": uniform, "runs_p": runs_p, "serial_p": serial_p}


def _length_class(n: Column) -> Column:
    return reduce(lambda c, k: c.when(n >= LENGTHS[k], k), reversed(range(1, len(LENGTHS))), F.when(F.lit(False), 0)).otherwise(0)


def tested(tokens: DataFrame) -> DataFrame:
    """Adds the battery's results, their combination and the class and bin for the step-up rule, from `hit`."""
    out = tokens.withColumns(battery(F.col("hit")))
    p = F.least(F.lit(1.0), 3 * F.least("uniform_p", "runs_p", "serial_p"))
    out = out.withColumn("p", F.greatest(p, F.lit(1e-300)))
    # three places before the floor, so that the last bits of a logarithm do not move a token to another bin
    bin_ = F.least(F.lit(BINS), F.floor(F.round(-10 * F.log10("p"), 3))).cast("int")
    return out.withColumn("length_class", _length_class(F.length("hit"))).withColumn("bin", bin_)


def thresholds(scored: DataFrame, level: float = LEVEL) -> DataFrame:
    """For each length class the least bin whose tokens are dismissed (BINS + 1: none).

    A bin stands for its largest p-value, which makes the rule a little stricter than on the exact values.
    """
    counts = scored.groupBy("length_class", "bin").agg(F.count("*").alias("n"))
    same = Window.partitionBy("length_class")
    ranked = counts.withColumn("at_most", F.sum("n").over(same.orderBy(F.desc("bin")))).withColumn("all", F.sum("n").over(same))
    passed = F.pow(F.lit(10.0), -F.col("bin") / 10) <= F.lit(level) * F.col("at_most") / F.col("all")
    return ranked.groupBy("length_class").agg(F.coalesce(F.min(F.when(passed, F.col("bin"))), F.lit(BINS + 1)).alias("dismiss_from"))


def scan(documents: DataFrame, *, level: float = LEVEL, into: str = "secrets") -> DataFrame:
    """Adds an array column of all spans: start, end, kind."""
    text, base, extra = (free_name(documents, n) for n in ("__text", "__base", "__extra"))
    out = documents.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    assign = F.filter(_spans(F.col(text), ASSIGN, 0), lambda s: F.length(_value(s["hit"])) >= 6)
    out = out.withColumn(base, F.concat(assign, _spans(F.col(text), ACCESS, 1), _spans(F.col(text), HEX, 2)))
    candidates = F.filter(
        _spans(F.col(text), CANDIDATE, 3),
        lambda s: ((s["hit"].rlike("[0-9]").cast("int") + s["hit"].rlike("[A-Z]").cast("int") + s["hit"].rlike("[a-z]").cast("int")) >= 2)
        & ~F.exists(F.col(base), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    out = out.withColumn(extra, F.transform(candidates, lambda s: s)).drop(text)
    scored = stored(tested(out.select(F.explode(extra).alias("s")).select("s.hit")).select("length_class", "bin"), "tokens")
    limits = {r.length_class: r.dismiss_from for r in thresholds(scored, level).collect()}  # one row for each length class

    def survives(s: Column) -> Column:
        b = battery(s["hit"])
        p = F.greatest(F.least(F.lit(1.0), 3 * F.least(b["uniform_p"], b["runs_p"], b["serial_p"])), F.lit(1e-300))
        at = F.least(F.lit(BINS), F.floor(F.round(-10 * F.log10(p), 3)))
        limit = F.element_at(F.create_map(*[F.lit(x) for k in range(len(LENGTHS)) for x in (k, limits.get(k, BINS + 1))]), _length_class(F.length(s["hit"])))
        return at < limit

    spans = F.array_sort(F.transform(F.concat(F.col(base), F.filter(F.col(extra), survives)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return out.withColumn(into, spans).drop(base, extra)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(documents: DataFrame, **options) -> DataFrame:
    """Counts by kind, the digest of the pattern spans, and all spans, for every document."""
    found = scan(documents.select("doc_id", "text"), **options)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(_listed(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), _listed(F.col("secrets")).alias("spans"),
    )
