"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Fixed patterns find assignments, access keys and long hexadecimal runs. Beyond them, every run of key characters
is a candidate. Its encoding is inferred, and three tests look at it: chi-squared uniformity over the encoding's
alphabet, runs of character kinds, and serial correlation. Each test gives two chances. One is that an evenly drawn
string looks so uneven: if it is below REJECT for any test, the candidate is no secret. The other is that ordinary
text of that encoding and length looks so even. Fisher's method combines these over the battery, and
Benjamini-Hochberg thresholds over all candidates, rejected ones included, bound the share of false finds, within
classes of length. The counts behind the thresholds are a bounded histogram, computed over all texts.

Small letters alone, or digits alone, carry little evidence: such a string counts only if it is long.

Cases: a null or empty text has no spans; spans may overlap, as each kind is found on its own; repeated rows are
scanned each on its own; an empty table gives an empty result; other columns pass through `scan_secrets`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, free_name, table

#: The base patterns, and the shortest value that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
#: Candidates: runs of at least so many key characters, with padding; NAME=value is two runs.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
#: Longer tokens aren't kept in memory.
CACHED = 512
#: A test of randomness rejects below this; a candidate counts at this rate of false finds.
REJECT, RATE = 0.001, 0.001
#: How often neighbouring characters of ordinary text differ in kind (capital, small letter, digit, other).
TEXT_CHANGES = 0.2
#: The correlation of neighbouring letters of ordinary text in being a vowel.
TEXT_VOWELS = -0.35
#: Classes of length, by their least length, and the steps of the histogram of -log10(p).
LENGTHS, STEPS = (16, 20, 24, 32, 48, 64, 128), 400

#: Encodings, from the narrowest: their alphabets' sizes, and how likely two and three characters of ordinary text are the same.
ALPHABETS = [
    ("decimal", re.compile(r"\d+"), 10, 0.12, 0.016),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16, 0.09, 0.010),
    ("one case", re.compile(r"[a-z]+|[A-Z]+"), 26, 0.066, 0.0053),
    ("one case and digits", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36, 0.06, 0.0045),
    ("alphanumeric", re.compile(r"[A-Za-z0-9]+"), 62, 0.06, 0.0045),
    ("base64", re.compile(r"[A-Za-z0-9+/_-]+={0,2}"), 64, 0.06, 0.0045),
]
VOWELS = np.isin(np.arange(128), np.frombuffer(b"aeiouyAEIOUY", np.uint8))
LETTERS = np.isin(np.arange(128), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi_squared_p(counts: np.ndarray, n: int, size: int) -> float:
    """The chance of counts this uneven, by Wilson and Hilferty's cube root; one-sided."""
    x = float((counts.astype(float) ** 2).sum()) * size / n - n
    k = size - 1
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)) if x > 0 else -9.0
    return normal_tail(z)


def text_even_p(counts: np.ndarray, n: int, two: float, three: float) -> float:
    """The chance that n characters of ordinary text are as evenly spread: few pairs of equal ones (chi-squared counts just these)."""
    pairs = float((counts * (counts - 1)).sum()) / 2
    all_pairs = n * (n - 1) / 2
    sd = math.sqrt(all_pairs * two * (1 - two) + n * (n - 1) * (n - 2) * (three - two * two))
    return 1 - normal_tail((pairs + 0.5 - all_pairs * two) / sd)


def kinds_of(token: str) -> np.ndarray:
    c = np.frombuffer(token.encode("ascii"), np.uint8)
    digit, upper, lower = (c >= 48) & (c <= 57), (c >= 65) & (c <= 90), (c >= 97) & (c <= 122)
    return np.where(digit, 0, np.where(upper, 1, np.where(lower, 2, 3)))


def runs_p(kinds: np.ndarray) -> float:
    """The chance of as few changes of kind, given how many of each kind there are."""
    n = len(kinds)
    share = np.bincount(kinds, minlength=4) / n
    p = 1 - float((share**2).sum())
    if p <= 0:
        return 1.0
    changes = int((kinds[1:] != kinds[:-1]).sum())
    sd = math.sqrt((n - 1) * p * (1 - p)) or 1.0
    return normal_tail(((n - 1) * p - changes - 0.5) / sd)


def serial_p(token: str) -> float:
    """Two-sided, for the correlation of neighbouring character codes."""
    c = np.frombuffer(token.encode("ascii"), np.uint8).astype(float)
    c -= c.mean()
    var = float((c * c).sum())
    r = float((c[1:] * c[:-1]).sum()) / var if var else 1.0
    return 2 * normal_tail(abs(r) * math.sqrt(len(c)))


def text_vowels_p(codes: np.ndarray) -> float:
    """The chance that vowels and consonants of ordinary text alternate as little."""
    letter = LETTERS[codes[1:]] & LETTERS[codes[:-1]]
    n = int(letter.sum())
    if n < 8:
        return 1.0
    a, b = VOWELS[codes[:-1]][letter].astype(float), VOWELS[codes[1:]][letter].astype(float)
    a, b = a - a.mean(), b - b.mean()
    var = math.sqrt(float((a * a).sum()) * float((b * b).sum()))
    r = float((a * b).sum()) / var if var else 0.0
    return normal_tail((r - TEXT_VOWELS) * math.sqrt(n))


@lru_cache(4096)
def text_p(n: int, changes: int) -> float:
    """The chance that ordinary text of n characters changes its kind at least that often."""
    if changes <= 0:
        return 1.0
    logs, top = [], -math.inf
    for k in range(changes, n):
        logs.append(math.lgamma(n) - math.lgamma(k + 1) - math.lgamma(n - k) + k * math.log(TEXT_CHANGES) + (n - 1 - k) * math.log(1 - TEXT_CHANGES))
        top = max(top, logs[-1])
        if logs[-1] < top - 60:  # past the peak, and too small for the sum
            break
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def fisher(ps: tuple[float, ...]) -> float:
    """The chance of so small a product of independent chances."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    term = total = 1.0
    for k in range(1, len(ps)):
        term *= x / k
        total += term
    return min(1.0, math.exp(-x) * total)


@lru_cache(65536)
def randomness(token: str) -> tuple[str, float, float]:
    """The inferred encoding, the battery's least chance under even draws, and its combined chance under ordinary text."""
    body = token.rstrip("=")
    name, _, size, two, three = next(a for a in ALPHABETS if a[1].fullmatch(token))
    n, kinds, codes = len(body), kinds_of(body), np.frombuffer(body.encode("ascii"), np.uint8)
    counts = np.bincount(codes, minlength=128)
    even = min(chi_squared_p(counts, n, size), runs_p(kinds), serial_p(body))
    text = fisher((text_even_p(counts, n, two, three), text_p(n, int((kinds[1:] != kinds[:-1]).sum())), text_vowels_p(codes)))
    return name, even, text


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def candidates(text: str) -> list[tuple[int, int, float]]:
    """start, end and -log10(p) of all candidates; of those that the battery rejects, p is 1."""
    out = []
    for m in CANDIDATE.finditer(text):
        token = m.group()
        _, even, p = (randomness if len(token) <= CACHED else randomness.__wrapped__)(token)
        out.append((m.start(), m.end(), -math.log10(max(p, 1e-300)) if even >= REJECT else 0.0))
    return out


def scanner():
    @F.pandas_udf("base array<struct<start:int,kind:int,end:int>>, more array<struct<start:int,end:int,score:double>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                text = text or ""
                base = [{"start": a, "kind": k, "end": b} for a, k, b in sorted(base_spans(text))]
                rows.append((base, [{"start": a, "end": b, "score": s} for a, b, s in candidates(text)]))
            yield pd.DataFrame(rows, columns=["base", "more"])

    return scan.asNondeterministic()


def length_class(n: Column) -> Column:
    return sum((F.when(n >= x, 1).otherwise(0) for x in LENGTHS[1:]), F.lit(0))


def score_bin(score: Column) -> Column:
    """Twentieths of a decade; the last bin holds all beyond."""
    return F.least(F.floor(score * 20), F.lit(STEPS - 1)).cast("int")


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> list[float]:
    """The least -log10(p) that counts, for each class of length (Benjamini-Hochberg on the histogram)."""
    out = []
    for k in range(len(LENGTHS)):
        bins = sorted(((b, n) for c, b, n in counts if c == k), reverse=True)
        total, above, least = sum(n for _, n in bins), 0, math.inf
        for b, n in bins:
            above += n
            if 10 ** (-b / 20) * total <= rate * above:
                least = b / 20
        out.append(least)
    return out


def limits(counts: DataFrame) -> list[float]:
    return thresholds([(r["c"], r["b"], r["n"]) for r in counts.collect()])


def digest(spans: Column) -> Column:
    """kind:start:end, by start and then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def spans_of(found: Column, counts: DataFrame) -> Column:
    """All spans of a row: the base ones, and candidates beyond the thresholds that no base span covers."""
    least = F.array(*(F.lit(float(x)) for x in limits(counts)))
    passed = F.filter(found["more"], lambda m: F.floor(m["score"] * 20) / 20 >= F.get(least, length_class(m["end"] - m["start"])))
    fresh = F.filter(passed, lambda m: ~F.exists(found["base"], lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    as_span = F.transform(fresh, lambda m: F.struct(m["start"].alias("start"), F.lit(3).alias("kind"), m["end"].alias("end")))
    return F.concat(found["base"], as_span)


def histogram(found: DataFrame, column: str) -> DataFrame:
    """Counts by class of length and bin: at most len(LENGTHS) * STEPS rows."""
    one = found.select(F.explode(F.col(column)["more"]).alias("m"))
    return one.groupBy(length_class(F.col("m.end") - F.col("m.start")).alias("c"), score_bin(F.col("m.score")).alias("b")).agg(F.count("*").alias("n"))


def scan_secrets(docs: DataFrame, scratch: Scratch, *, text: str = "text", found: str = "secrets") -> DataFrame:
    """docs, without their text, with an array of spans (start, kind, end) in code points."""
    raw = docs.withColumn(found, scanner()(F.col(text))).drop(text)
    kept = scratch.save(raw, "found")
    return kept.withColumn(found, spans_of(F.col(found), histogram(kept, found)))


def all_spans(text: str, least: list[float]) -> list[tuple[int, int, int]]:
    """What spans_of gives, for one text: (start, kind, end)."""
    base = base_spans(text)
    fits = lambda a, b, p: math.floor(p * 20) / 20 >= least[sum(b - a >= x for x in LENGTHS[1:])]
    return sorted(base + [(a, 3, b) for a, b, p in candidates(text) if fits(a, b, p) and not any(x < b and a < y for x, _, y in base)])


def redactor(least: list[float]):
    """An Arrow-batched function from a text to the text with a mark in place of each secret."""

    @F.pandas_udf("string")
    def redacted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else redact(t, all_spans(t, least)) for t in texts], dtype=object)

    return redacted.asNondeterministic()


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<SECRET>") -> str:
    """Overlapping spans give way to one mark."""
    out, last = [], 0
    for start, _, end in sorted(spans):
        if start >= last:
            out += [text[last:start], mark]
        last = max(last, end)
    return "".join(out) + text[last:]


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with a mark in place of each secret in `text`, and `n_chars`, where it is a column, counted anew.

    The texts are scanned twice, for the thresholds and for the marks, so they are never shuffled.
    """
    found = free_name(docs, "secrets")
    counts = histogram(docs.select(scanner()(F.col("text")).alias(found)), found)
    out = docs.withColumn("text", redactor(limits(counts))(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs, Scratch(spark, "secret-scan"))
    x = F.col("secrets")
    number = lambda k: F.size(F.filter(x, lambda s: s["kind"] == k)).cast("long")
    base = F.filter(x, lambda s: s["kind"] < 3)
    return found.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(x).alias("spans"))


def base_secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10 that SQL can express: how many base spans of each kind a text has."""
    return op10_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key"))

BASE_SQL = rf"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
"""
