"""Operators that give one row for each document (packing: its first piece)."""

from sluice.llm import align, katz, linededup, mixing, ngramjoin, packing, pii, quality, secrets, unitdedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words in sentences, made from a seed."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = WORDS[x >> 8 & 15] + WORDS[x >> 14 & 15][: 2 + (x >> 20) % 4]
        out.append(w + ("." if x % 9 == 0 else ""))
    return " ".join(out)


def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (8, 1, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


CASES = {
    "align": lambda spark, d: align.report(d),
    "quality": lambda spark, d: quality.report(d, labels(spark)),
    "linededup": lambda spark, d: linededup.report(d),
    "ngramjoin": lambda spark, d: ngramjoin.report(d),
    "katz": lambda spark, d: katz.score(d),
    "secrets": lambda spark, d: secrets.report(d),
    "unitdedup": lambda spark, d: unitdedup.report(d),
    "pii": lambda spark, d: pii.report(d),
    "packing": lambda spark, d: packing.pack(d).filter("piece = 0"),
    "mixing": lambda spark, d: mixing.report(d),
}
