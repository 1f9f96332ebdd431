"""What the operators of this subpackage share: tables, scratch tables, words, spans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of ASCII letters or digits and of anything beyond ASCII.
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(WORD_PATTERN)
#: Only A-Z are lower-cased, so that every engine agrees on every script.
LOWER = {c: c + 32 for c in range(65, 91)}
SHINGLE = 5
SIMILARITY = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: str) -> str:
    """A-Z in lower case; faster than a translation where a text isn't ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words(text: str | None) -> list[str]:
    return WORD.findall(lowered(text)) if text else []


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a machine-local one only in a session of one process that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lakewright-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named


def bound_batches(spark: SparkSession, rows: int = 4000, size: int = 4 << 20) -> dict[str, str]:
    """Bounds the session's Arrow batches, in rows and in bytes, as rows with texts or sets in them may be large; what they were before.

    For results that are only computed later, when whoever asked for them reads or writes them.
    """
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, most in wanted.items():
        held = int(re.match(r"-?\d+", before[name])[0]) if re.fullmatch(r"-?\d+b?", before[name]) else -1
        spark.conf.set(name, str(min(most, held) if held > 0 else most))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = 4000, size: int = 4 << 20):
    """Bounds Arrow batches for what runs inside."""
    before = bound_batches(spark, rows, size)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class Scratch:
    """Tables that cut lineage, written to the shared folder; lost executors don't take them along."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{name}"
        self.paths.append(path)
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Removes the files of a saved table that nothing reads any more."""
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(folder)

    def only(self, *names: str) -> None:
        """Removes all saved tables but those of these names, which the result still reads."""
        for path in [p for p in self.paths if p.rsplit("/", 1)[1].split("-", 1)[1] not in names]:
            self._delete(path)
            self.paths.remove(path)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark's cleaner find the exchanges that nothing refers to any more, and remove their files."""
        self.spark.sparkContext._jvm.System.gc()


class WordHashes(dict):
    """64-bit hashes of words. Emptied when full, so a worker's memory stays bounded."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products become evenly spread hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Which bytes of UTF-8 belong to words, as in WORD_PATTERN; capital letters have the values of small ones.
WORD_BYTE = np.array([b >= 128 or (chr(b).isalnum() and b < 128) for b in range(256)])
BYTE_VALUES = np.random.default_rng(2).integers(1, 2**64, 256, dtype=np.uint64)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
#: Odd, so that its powers have inverses modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
BLOCK = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd number modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 4096), base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 2 * BLOCK:
            _powers[base] = held
    return held[:n]


def text_slices(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow array of texts that hold about `size` bytes each; a longer text is a range of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, "right")))
        yield begin, end
        begin = end


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's words begin and the last one's end.

    No words are made: a hash is the sum of its bytes' values times powers.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    inside = WORD_BYTE[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:-1]
    ends[:-1] &= ~inside[1:] | border[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    out = [np.empty(0, np.uint64)]
    # Long texts in blocks that end between words, so the sums stay small.
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), BLOCK)), len(starts)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        low, high = starts[a], ends[b - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[low:high]] * powers(BASE, high - low), out=sums[1:])
        at = starts[a:b] - low
        out.append(mix((sums[ends[a:b] - low] - sums[at]) * powers(INVERSE, high - low)[at]))
    return np.concatenate(out), np.searchsorted(starts, offsets)


def word_hashes(text: str | None) -> np.ndarray:
    """The hashes of one text's words."""
    return hashed_words(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()).view(pa.large_string()))[0]


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each n consecutive of some hashes, from each place on that has so many."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    factor = 1
    for k in range(n if len(out) else 0):
        out += h[k : len(h) - n + 1 + k] * np.uint64(factor)
        factor = factor * 0xC2B2AE3D27D4EB4F % 2**64
    return mix(out)


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash for each n consecutive words, from the words' hashes; for fewer words, but not none, one for all."""
    return run_hashes(h, min(n, len(h))) if len(h) else np.empty(0, np.uint64)


def shingled(h: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of many texts' words, and where each text's begin and the last one's end."""
    size = np.diff(offsets)
    whole = np.append(run_hashes(h, n), np.zeros(min(len(h), n - 1), np.uint64))
    fits = np.ones(len(h), bool)
    for k in range(1, n):
        fits[offsets[1:][size >= k] - k] = False
    for a, b in zip(offsets[:-1][(size > 0) & (size < n)], offsets[1:][(size > 0) & (size < n)], strict=True):
        whole[a], fits[a] = shingles(h[a:b], n)[0], True
    return whole[fits], np.append(0, np.cumsum(fits))[offsets]


def spans_sha256(col):
    return F.sha2(col.cast("binary"), 256)
