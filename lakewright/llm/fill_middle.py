"""Fill-in-the-middle: texts are cut into prefix, middle and suffix, and put together in another order.

A unit is a run of other characters with the white space before it, or white space at the end. One pass of
`finditer` collects the units' end offsets in a compact array; two lookups give where the text is cut. All draws come
from SHA-256 of the seed and the id, so a text is cut alike in every run, on every executor. Everything is row by row
in Arrow batches, without a shuffle.

Forms: `plain`, the text itself; `psm`, prefix, suffix, middle; `spm`, suffix, prefix, middle. A text that is empty or
holds one of the marks stays plain, so an output is always turned back without doubt: no mark begins or ends inside
another, hence the first of each kind is the one that was put there.

Cases: a null text is an empty one (0 units, plain, empty output); a null id draws like an empty id; repeated ids draw
alike; texts of one unit may have two empty parts; an empty table gives an empty result; a clashing column of docs is
replaced; other columns stay.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bound_batches, free_name, table

#: The pattern of a unit and the marks.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_PERCENT, SPM_PERCENT = 42, 50, 80
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def unit_ends(text: str) -> array:
    """Where each unit ends; 4 bytes a unit."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def rearranged(text: str | None, key: object, *, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple:
    """n, form, prefix_chars, middle_chars, output of one text."""
    text = text or ""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= fim_percent or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    outer, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(outer).partition(inner)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def transformer(seed: int, fim_percent: int, spm_percent: int):
    @F.pandas_udf(COLUMNS)
    def transform(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, keys in batches:
            rows = [rearranged(t, k, seed=seed, fim_percent=fim_percent, spm_percent=spm_percent) for t, k in zip(texts, keys, strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return transform.asNondeterministic()


def digester():
    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def digests(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
        for outputs, forms in batches:
            yield pd.DataFrame([(sha(x), sha(restored(x, form))) for x, form in zip(outputs, forms, strict=True)], columns=["output_sha256", "restored_sha256"])

    return digests.asNondeterministic()


def fill_in_middle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """docs without their text, with n, form, prefix_chars, middle_chars and output."""
    made = free_name(docs, "made")
    new = ["n", "form", "prefix_chars", "middle_chars", "output"]
    # As text, so that ids of every type are read as written, and nulls turn no integer into a float.
    cut = docs.withColumn(made, transformer(seed, fim_percent, spm_percent)(F.col(text), F.col(key).cast("string")))
    kept = [c for c in docs.columns if c != text and c.lower() not in new]
    return cut.select(*kept, *(F.col(made)[c].alias(c) for c in new))


def unmade(made: DataFrame, *, text: str = "text") -> DataFrame:
    """The inverse of fill_in_middle: the text again, from output and form."""

    @F.pandas_udf("string")
    def back(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for outputs, forms in batches:
            yield pd.Series([restored(x, form) for x, form in zip(outputs, forms, strict=True)], dtype=object)

    return made.withColumn(text, back(F.col("output"), F.col("form"))).drop("n", "form", "prefix_chars", "middle_chars", "output")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = made.withColumn("told", digester()(F.col("output"), F.col("form")))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "told.output_sha256", "told.restored_sha256")


OP12_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 AS plain,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 AS spm
  FROM cut
), parts AS (
  SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(units[1:least(x, y)], '') AS p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(units[greatest(x, y) + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
