"""Language identification by compression.

Each language has raw-content dictionaries made of sample texts. A text is reduced to its small letters and spaces
and cut into chunks; each chunk is encoded with every language's first dictionary, and the language with the fewest
bytes in all wins. The relative gap to the runner-up is the margin. Where it is narrow, the other dictionaries are
asked too and the bytes are added up, a language with few dictionaries answering with its own in turn; where it stays
narrow, the prediction is marked as rejected.

Every language is learnt. The dictionaries are bounded (DICTS x DICT_BYTES a language, TOTAL_BYTES for all, in equal
shares) and come from a sample of about MAX_SAMPLE texts a language, chosen by the hash of their ids, of which the first
MAX_SAMPLE_CHARS characters teach; no more of it than the dictionaries hold goes to the driver. Scoring is one pass over whole
texts without a shuffle.

Cases: a null text, or one without a letter, is "und" with score 0 and rejected; a tie goes to the language whose
name sorts first; without any labelled text everything is "und"; repeated rows are judged each on its own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import table
from .quality_model import held_out

DICT_BYTES, DICTS, CHUNK = 65_536, 6, 4096
#: Matches of four bytes on: words of a language share short pieces.
PARAMETERS = zstandard.ZstdCompressionParameters.from_level(5, source_size=CHUNK, dict_size=DICT_BYTES, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_checksum=0, write_content_size=0, write_dict_id=0)
MAX_SAMPLE, MAX_SAMPLE_CHARS, TOTAL_BYTES = 250, 20_000, 128 << 20
#: A margin, as a share of the runner-up's bytes, below which a prediction is rejected.
NARROW = 0.02
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return OTHER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def samples(docs: DataFrame, *, max_sample: int = MAX_SAMPLE, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """Sample text of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & (F.length("text") > 0))
    known = known.select("doc_id", "lang", F.substring("text", 1, MAX_SAMPLE_CHARS).alias("text"))
    # A language has as many texts as ids, so a row that is repeated can't crowd out the others.
    counts = known.groupBy("lang").agg(F.count_distinct("doc_id").alias("n"))
    # One row a language, as the dictionaries have.
    shares = counts.collect()
    if not shares:
        return {}
    most = min(DICTS * DICT_BYTES, total_bytes // len(shares))
    at = F.xxhash64("doc_id")
    drawn = known.join(F.broadcast(docs.sparkSession.createDataFrame(shares, counts.schema)), "lang").where(F.pmod(at, F.lit(1_000_000)) * F.col("n") < max_sample * 1_000_000)
    # Rows of one id count once, so a repeated row can't swell the sample; then each language's first texts, as many as its dictionaries hold.
    one = drawn.groupBy("lang", at.alias("h")).agg(F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    # Twice as many characters, as not all are letters.
    rows = one.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < 2 * most).select("lang", "h", "text").collect()
    texts: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        held = texts.setdefault(r["lang"], b"")
        if len(held) < most:
            texts[r["lang"]] = (held + letters(r["text"]) + b" ")[:most]
    return {k: v for k, v in texts.items() if v.strip()}


class Compressors:
    def __init__(self, texts: dict[str, bytes]):
        self.by_language = []
        for lang in sorted(texts):
            own = []
            for i in range(0, min(len(texts[lang]), DICTS * DICT_BYTES), DICT_BYTES):
                d = zstandard.ZstdCompressionDict(texts[lang][i : i + DICT_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=PARAMETERS)
                own.append(zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMETERS))
            self.by_language.append((lang, own))
        self.dicts = max((len(own) for _, own in self.by_language), default=0)

    def sizes(self, chunks: list[bytes], k: int) -> list[int]:
        """Bytes by language, with the k-th dictionaries, counted around where there are fewer."""
        return [sum(len(own[k % len(own)].compress(x)) for x in chunks) for _, own in self.by_language]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The language, a score from 0 to 1 that grows with the margin, and whether the margin is narrow."""
        if not self.dicts or not text or not LETTER.search(text):
            return "und", 0.0, True
        data = letters(text)
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        total = self.sizes(chunks, 0)
        for k in range(1, self.dicts):
            if self.margin(total, k * len(data)) >= 2 * NARROW:
                break
            total = [a + b for a, b in zip(total, self.sizes(chunks, k), strict=True)]
        margin = self.margin(total, len(data))
        return self.by_language[total.index(min(total))][0], min(1.0, 0.5 + 2 * margin), margin < NARROW

    @staticmethod
    def margin(sizes: list[int], alone: int) -> float:
        first, second = sorted([*sizes, alone + 16] if len(sizes) < 2 else sizes)[:2]
        return (second - first) / max(second, 1)


def predictor(shared):
    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = Compressors(shared.value)
        for texts in batches:
            yield pd.DataFrame([compressors.predict(t) for t in texts], columns=["lang", "score", "rejected"])

    return predict.asNondeterministic()


def identify_language(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    out = docs.select("doc_id", predictor(shared)(F.col("text")).alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"), F.col("p.rejected").alias("rejected"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, samples(docs))
