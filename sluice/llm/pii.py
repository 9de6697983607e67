"""Personal data: pattern spans, and further spans from weak supervision.

Base patterns find mail addresses, IP addresses, card and phone numbers; what passes their checks is always a span. Wider
patterns find candidates of other kinds (card and phone numbers that ran together with other digits and so failed, spelled-out mail addresses, IPv6 addresses, phone numbers without country code, national
ids, IBANs, persons). Three labelers look at every candidate, those of the base patterns included, and say yes, no or nothing:

* format: checks of the value itself (check digits, group sizes, ranges);
* gazetteer: lists of known parts (issuers, calling codes, IBAN countries, top-level domains, given names);
* context: cue words in front.

Their accuracies are not known. Expectation-maximisation over the histogram of (kind, votes), a few hundred numbers whatever the size of the corpus, finds
how often each labeler is right in each class and how frequent the class is in each kind (Dawid and Skene, without a model of silence). The probabilities it gives to
the votes are soft labels of a naive Bayes classifier over hashed features of the span and its surroundings; its sums are taken over
all candidates. Candidates of the wider patterns that it holds for personal become spans; matches of a base pattern that failed its checks
only train.

Texts are looked at once. Patterns are written so that their work is linear in the text: they start at the beginning of a run only, or have bounded parts.

Edge cases: a null or empty text has no spans (the digest of the empty string); null and repeated doc_ids are ordinary rows; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import stored

BASE = ("email", "ip", "card", "phone")
WIDER = ("joined_card", "joined_phone", "spelled_email", "ipv6", "local_phone", "national_id", "iban", "person")
KINDS = BASE + WIDER
LABELERS = ("format", "gazetteer", "context")
#: Votes: no, yes, nothing.
NO, YES, NOTHING = 0, 1, 2
BUCKETS, THRESHOLD, ROUNDS = 1 << 14, 0.9, 500

# --- base patterns (linear forms of those in the contract) ----------------------------------------------------

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: No match starts inside a run of digits: it would start at the run's beginning too.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain: for each @, the run of local letters before it, not before the last match's end."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at > done and (found := DOMAIN.match(text, at)):
            start = at
            while start > done and LOCAL.fullmatch(text, start - 1, start):
                start -= 1
            if start < at:
                out.append((start, found.end()))
                done = found.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    own = sum(map(int, digits[-1::-2]))
    return (own + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def small(number: str) -> bool:
    return len(n := number.lstrip("0")) <= 3 and int(n or "0") <= 255


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it passes its checks) of all matches, by kind and start."""
    for start, end in emails(text):
        yield 0, start, end, True
    if DIGIT.search(text) is None:
        return
    for m in IP.finditer(text):
        yield 1, *m.span(), all(map(small, m.group().split(".")))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        yield 2, *m.span(), len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text) if "+" in text else ():
        yield 3, *m.span(), 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15


# --- wider patterns -------------------------------------------------------------------------------------------

JOINED_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])")
JOINED_PHONE = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?(?:[\x20.-]?[0-9]{2,4}){2,3}(?![0-9])")
AT = re.compile(r"[\[(]\x20?at\x20?[\])]", re.I)
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63}){1,5}", re.I)
GROUPS = re.compile(r"(?<![0-9A-Za-z+.:/-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){2,4}(?![0-9A-Za-z:/-])")
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}::?){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: A title is not part of a name.
PERSON = re.compile(r"(?<!\w)(?!(?:Mr|Mrs|Ms|Dr|Prof|Dear|Herr|Frau|Monsieur|Madame)\x20)[A-Z][a-z\u00df-\u00ff]{1,20}(?:\x20[A-Z][a-z\u00df-\u00ff]{1,20}){1,2}(?!\w)")


def wider_matches(text: str, failed: list[tuple[int, int]] = ()) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of candidates; failed: base matches that failed their checks, in which whole numbers may stand."""
    for start, end in failed:
        for name, pattern in (("joined_card", JOINED_CARD), ("joined_phone", JOINED_PHONE)):
            for m in pattern.finditer(text, start, end):
                yield KINDS.index(name), *m.span()
    if AT.search(text):
        for m in SPELLED.finditer(text):
            yield KINDS.index("spelled_email"), *m.span()
    if DIGIT.search(text):
        for m in IPV6.finditer(text) if ":" in text else ():
            yield KINDS.index("ipv6"), *m.span()
        for m in GROUPS.finditer(text):
            sizes = tuple(len(x) for x in re.findall("[0-9]+", m.group()))
            yield KINDS.index("national_id" if sizes == (3, 2, 4) else "local_phone"), *m.span()
        for m in IBAN.finditer(text):
            yield KINDS.index("iban"), *m.span()
    for m in PERSON.finditer(text):
        yield KINDS.index("person"), *m.span()


# --- labelers -------------------------------------------------------------------------------------------------

# issuers' first digits, calling codes, IBAN lengths, domains, given names and cue words.
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35")
CALLING = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|35[1-9]|37[0-9]|38[0-79]|42[013]|85[2356]|88[06]|96[0-8]|97[1-7]")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
DOMAINS = set("com org net edu gov info io de fr es it uk eu ch at nl be pl se no dk fi pt us ca".split())
GIVEN = set("Alice Anna Ben Carlos Charles Clara David Elena Emma Eric Eva Frank George Hans Helen Ines Jack James Jane Jean John Jose Julia Karl Laura Leo Louis Lucas Luis Maria Marie Mark Martin Mary Max Michael Nina Oliver Pablo Paul Pedro Peter Pierre Robert Sara Sophie Thomas Tom Ursula Victor William".split())
NOT_NAMES = set("January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday North South East West New United States License Version Street University Public General".split())
CUES = {
    "email": "mail email e-mail contact write courriel correo", "ip": "ip address host client addr adresse", "card": "card visa mastercard credit karte carte tarjeta", "phone": "phone tel telephone call mobile fax telefon teléfono téléphone cell",
    "national_id": "ssn social security national identity id", "iban": "iban account konto compte cuenta bank", "person": "mr mrs ms dr prof name dear herr frau monsieur madame señor señora signed",
}
CUE_OF = {"joined_card": "card", "joined_phone": "phone", "spelled_email": "email", "ipv6": "ip", "local_phone": "phone"}
AGAINST = set("version isbn issn order invoice ref reference figure fig table section chapter page release build ticket article no number sku serial date on".split())
WORD = re.compile(r"[\w-]+")


def _format(kind: str, value: str, passed: bool) -> int:
    if kind in BASE:
        return YES if passed else NO
    if kind == "spelled_email":
        return YES if re.search(r"[A-Za-z]{2,10}$", value) else NO
    if kind == "joined_card":
        return YES if luhn(re.sub("[^0-9]", "", value)) else NO
    if kind == "joined_phone":
        return YES if 9 <= len(re.sub("[^0-9]", "", value)) <= 15 else NO
    if kind == "person":
        return NO if len(set(value.split(" "))) == 1 else NOTHING
    if kind == "ipv6":
        return YES if "::" in value and value.count("::") == 1 or value.count(":") == 7 else NO
    if kind == "iban":
        x = value.replace(" ", "")
        return YES if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else NO
    groups = re.findall("[0-9]+", value)
    if kind == "national_id":
        return YES if groups[0] not in ("000", "666") and groups[0] < "900" and groups[1] != "00" and groups[2] != "0000" and "." not in value else NO
    if kind == "local_phone":
        if tuple(map(len, groups)) in ((4, 2, 2), (2, 2, 4)) or not 9 <= sum(map(len, groups)) <= 11:
            return NO
        return YES if "." not in value and (tuple(map(len, groups)) == (3, 3, 4) or value[0] == "(") else NOTHING
    return NOTHING


def _gazetteer(kind: str, value: str) -> int:
    digits = re.sub("[^0-9]", "", value) if kind != "person" else ""
    if kind in ("email", "spelled_email"):
        return YES if re.split(r"[^A-Za-z0-9-]+", value.rstrip(")] "))[-1].lower() in DOMAINS else NOTHING
    if kind == "ip":
        return NO if re.match(r"(?:0|127|255)\.", value) else NOTHING
    if kind in ("card", "joined_card"):
        return YES if ISSUERS.match(digits) else NO
    if kind in ("phone", "joined_phone"):
        return YES if CALLING.match(digits) else NO
    if kind == "local_phone":
        return NOTHING if digits[0] in "0" else YES if len(digits) == 10 and digits[0] > "1" and digits[3] > "1" else NO
    if kind == "iban":
        return YES if IBAN_LENGTHS.get(value[:2]) == len(value.replace(" ", "")) else NO
    if kind == "person":
        words = value.split(" ")
        return NO if any(w in NOT_NAMES for w in words) else YES if words[0] in GIVEN else NOTHING
    return NOTHING


def _context(kind: str, words: list[str]) -> int:
    cues = CUES.get(CUE_OF.get(kind, kind), "").split()
    found = [w for w in words if w in cues]
    return YES if found else NO if kind != "person" and any(w in AGAINST for w in words[-2:]) else NOTHING


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def looked_at(text: str, kind: int, start: int, end: int, passed: bool) -> tuple[int, list[int]]:
    """The votes of the labelers as one number, and the features' buckets, of a candidate."""
    name, value = KINDS[kind], text[start:end]
    words = [w.lower() for w in WORD.findall(text[max(0, start - 48) : start])][-4:]
    votes = _format(name, value, passed) * 9 + _gazetteer(name, value) * 3 + _context(name, words)
    shape = re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 20)}", re.sub("[a-z\u00df-\u00ff]+", "a", value))[:60]
    after = WORD.match(text[end : end + 24].lstrip(" ,"))
    features = [f"{name} shape {shape}", f"{name} first {value[:2]}", f"{name} word {value.split(' ')[0][:24]}", *(f"{name} before {w[:24]}" for w in words), f"{name} after {after.group().lower()[:24] if after else ''}"]
    return votes, sorted({_bucket(f) for f in features})


CANDIDATE = "kinds array<int>, starts array<long>, ends array<long>, votes array<int>, features array<array<int>>"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document the base spans, and all candidates with votes and features."""
    for batch in batches:
        rows = []
        for value in batch["text"]:
            text = value.as_py() or ""
            base = list(base_matches(text))
            taken = sorted((s, e) for _, s, e, ok in base if ok)
            wider, i = [], 0
            for kind, s, e in sorted(set(wider_matches(text, [(s, e) for _, s, e, ok in base if not ok])), key=lambda x: (x[1], x[0])):
                while i < len(taken) and taken[i][1] <= s:
                    i += 1
                if i == len(taken) or taken[i][0] >= e:
                    wider.append((kind, s, e, True))
            seen = [(k, s, e, *looked_at(text, k, s, e, ok)) for k, s, e, ok in base + wider]
            rows.append(([(k, s, e) for k, s, e, ok in base if ok], seen))
        base_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
        columns = [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in b] for b, _ in rows], base_type)]
        for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()))):
            columns.append(pa.array([[x[i] for x in seen] for _, seen in rows], pa.list_(kind)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], names=["doc_id", "base", "kinds", "starts", "ends", "votes", "features"])


# --- what the votes are worth -----------------------------------------------------------------------------------


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, int], float], np.ndarray, dict[int, float]]:
    """From how often each (kind, votes) occurs: the probability that such a candidate is personal (votes of nothing only: 0), each labeler's P(yes | class), and each kind's share.

    Pseudo-counts make labelers a little better than chance at first, so that the classes can't change places.
    """
    keys = sorted(k for k in counts if k[1] != 26)
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys], int)
    votes = np.array([[v // 9, v // 3 % 3, v % 3] for _, v in keys], int).reshape(-1, len(LABELERS))
    says_yes, says = votes == YES, votes != NOTHING
    p = np.clip((says_yes.sum(1) + 0.3) / (says.sum(1) + 0.6), 0.05, 0.95)
    right, share = np.full((2, len(LABELERS)), 0.5), np.full(len(KINDS), 0.5)
    for _ in range(rounds if keys else 0):
        weights = np.stack([n * (1 - p), n * p])
        for c in (0, 1):
            right[c] = (weights[c] @ says_yes + (4 if c else 1)) / (weights[c] @ says + 5)
        for k in range(len(KINDS)):
            share[k] = (weights[1][kind == k].sum() + 1) / (n[kind == k].sum() + 2)
        odds = np.log(share / (1 - share))[kind]
        for j in range(len(LABELERS)):
            yes, no = np.log(right[1, j] / right[0, j]), np.log((1 - right[1, j]) / (1 - right[0, j]))
            odds = odds + np.where(says[:, j], np.where(says_yes[:, j], yes, no), 0)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - p).max() < 1e-10:
            break
        p = new
    return {k: float(x) for k, x in zip(keys, p)}, right, {k: float(share[k]) for k in range(len(KINDS))}


def trained(candidates: DataFrame, chance: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray]:
    """Naive Bayes over all candidates with votes: a weight for each kind and for each feature's bucket, of at most BUCKETS rows at the driver."""
    table = np.full(len(KINDS) * 27, -1.0)
    for (k, v), p in chance.items():
        table[k * 27 + v] = p
    p = F.element_at(F.array(*(F.lit(float(x)) for x in table)), F.col("kinds") * 27 + F.col("votes") + 1)
    rows = candidates.select("kinds", "features", p.alias("p")).filter("p >= 0")
    by_kind = {r.kinds: (r.yes, r.n) for r in rows.groupBy("kinds").agg(F.sum(F.round("p", 9).cast("decimal(38,9)")).cast("double").alias("yes"), F.count("*").alias("n")).collect()}
    sums = rows.select(F.explode("features").alias("bucket"), "p").groupBy("bucket").agg(F.sum(F.round("p", 9).cast("decimal(38,9)")).cast("double").alias("yes"), F.count("*").alias("n")).collect()
    kinds = np.array([math.log((by_kind.get(k, (0, 0))[0] + 1) / (by_kind.get(k, (0, 0))[1] - by_kind.get(k, (0, 0))[0] + 4)) for k in range(len(KINDS))])
    all_yes, all_no = sum(y for y, _ in by_kind.values()), sum(n - y for y, n in by_kind.values())
    weights = np.zeros(BUCKETS)
    for bucket, yes, n in sums:
        weights[bucket] = math.log((yes + 1) / (all_yes + 2)) - math.log((n - yes + 1) / (all_no + 2))
    return kinds, weights


def _judged(kinds: np.ndarray, weights: np.ndarray, threshold: float):
    least = math.log(threshold / (1 - threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, ks, starts, ends, features in zip(*(batch[n].to_pylist() for n in ("base", "kinds", "starts", "ends", "features"))):
                found = [(b["kind"], b["start"], b["end"]) for b in base]
                listed = [":".join((KINDS[k], str(s), str(e))) for k, s, e in sorted(found)]
                more, last = [], -1
                for k, s, e, f in sorted(zip(ks, starts, ends, features), key=lambda x: (x[1], x[0])):
                    if k >= len(BASE) and s >= last and kinds[k] + weights[f].sum() >= least:
                        more.append((k, s, e))
                        last = e
                counts = [sum(k == i for k, _, _ in found) for i in range(len(BASE))]
                spans = ",".join(listed + [":".join((KINDS[k], str(s), str(e))) for k, s, e in sorted(more)])
                rows.append((*counts, len(more), hashlib.sha256(",".join(listed).encode()).hexdigest(), spans))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [pa.array(c, pa.string() if i > 4 else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *arrays], names=["doc_id", *(f"n_{k}" for k in BASE), "n_more", "base_sha256", "spans"])

    return run


def report(documents: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Counts of base spans by kind and of further spans, the digest of the base spans, and all spans, for every document."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    found = stored(documents.select("doc_id", "text").mapInArrow(_candidates, f"doc_id {id_type}, base array<struct<kind:int,start:bigint,end:bigint>>, {CANDIDATE}"), "candidates")
    rows = found.select(F.inline(F.arrays_zip("kinds", "votes", "features")))
    counts = {(r.kinds, r.votes): r["count"] for r in rows.groupBy("kinds", "votes").count().collect()}  # at most 270
    chance, _, _ = reliabilities(counts)
    kinds, weights = trained(rows, chance)
    return found.mapInArrow(_judged(kinds, weights, threshold), f"doc_id {id_type}, " + ", ".join(f"n_{k} long" for k in BASE) + ", n_more long, base_sha256 string, spans string")
