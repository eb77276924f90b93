"""Shared helpers of the training-data operators: words, hashes, work tables, skew-safe group minima."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Byte by byte: A-Z to lower case; every ASCII byte that is no letter or digit separates words;
#: bytes of 0x80 and over (all of a non-ASCII character) belong to words.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LOWER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Rows of an Arrow batch that are turned to Python objects at once.
SLICE = 256

#: Salts over which the rows of one key are spread before they meet.
SALTS = 64


def encode(text: str | None) -> bytes:
    """UTF-8; null is empty, lone surrogates are kept."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words (UTF-8) of a whole text: runs of ASCII letters, digits and non-ASCII characters."""
    return encode(text).translate(_WORD_BYTES).split() if text else []


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_LOWER_BYTES)


class WordHashes(dict):
    """word -> 64-bit hash, computed on first sight; emptied when it holds too many words."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, unless a word is longer.
_PIECE = 1 << 18
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of _BASE and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 2 * len(_powers[0])), x, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of bytes that begin and end with a space."""
    c = np.frombuffer(data, np.uint8)
    inside = (c != 32).view(np.int8)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    power, inverse = _grown(len(c))
    sums = np.cumsum(c * power[: len(c)])  # of all bytes up to a place, each times its power
    return start, mix((sums[end - 1] - sums[start - 1]) * inverse[start])


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text, in text order; words as in words_of."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        start, h = _hashed(b" " + b" ".join(held) + b" ")
        ends = np.cumsum([len(x) + 1 for x in held]) + 1
        out.extend(np.split(h, np.searchsorted(start, ends[:-1])))
        held.clear()

    for t in texts:
        data = encode(t).translate(_WORD_BYTES)
        if len(data) > _PIECE:  # cut at spaces
            if held:
                flush()
            parts, at = [], 0
            while at < len(data):
                to = data.find(b" ", at + _PIECE) if at + _PIECE < len(data) else -1
                to = len(data) if to < 0 else to
                parts.append(_hashed(b" " + data[at:to] + b" ")[1])
                at = to
            out.append(np.concatenate(parts))
            size = 0
            continue
        held.append(data)
        size += len(data) + 1
        if size > _PIECE:
            flush()
            size = 0
    if held:
        flush()
    return out


def shingles_of(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n words, given the words' hashes; a shorter text that has words is one run."""
    if not len(h):
        return np.empty(0, np.uint64)
    n = min(n, len(h))
    acc = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        acc *= np.uint64(_BASE)
        acc += h[i : len(h) - n + 1 + i]
    return mix(acc)


def counted(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each is there."""
    s = np.sort(s)
    if not len(s):
        return s, np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[first], np.diff(first, append=len(s))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_memory: dict[str, object] = {}


def remembered(name: str, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task under a name. It keeps one thing: that of another operator goes first."""
    if name not in _memory:
        forget()
        _memory[name] = make()
    return _memory[name]


def forget() -> None:
    """Drop what a worker remembers, for operators that remember nothing: workers live on from task to task."""
    if _memory:
        _memory.clear()
        release()


def release() -> None:
    """Give the memory that a task has freed back to the system: what idle workers hold, the executor lacks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="rillstone-")


def work_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the session names in spark.checkpoint.dir.

    Where none is set, a temporary one, under a local master only: executors elsewhere couldn't read each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = root or _own_dir()
    return f"{root.rstrip('/')}/rillstone-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a table that is written go when it is there, not when the driver happens to collect its
    garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, at: str, name: str, **options: str) -> DataFrame:
    """Write df as a table under the shared folder `at` and read it back: lineage ends there."""
    df.write.mode("overwrite").options(**options).parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def map_rows(
    df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict]], schema: str, arrow: pa.Schema, rows: int = 10_000
) -> DataFrame:
    """mapInArrow over whole partitions: fn takes the columns of `rows` rows and yields columns of result batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                for out in fn({n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names)}):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def with_group_min(df: DataFrame, keys: list[str], value: str, salt_by: str, least: int = 1) -> DataFrame:
    """df's rows with `group_min` and `group_max`, the least and greatest `value` among rows with equal keys, and
    `group_rows`, their number.

    Only groups of at least `least` rows come back. A key may hold any share of the rows: rows first meet
    by key and salt, only one row per salt goes to the key's task, and its answer returns by key and salt.
    Rows with a null key or value are left out.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*keys, "_salt").agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(value).alias("_n"))
    whole = (
        part.groupBy(*keys)
        .agg(F.min("_min").alias("group_min"), F.max("_max").alias("group_max"), F.sum("_n").alias("group_rows"))
        .filter(F.col("group_rows") >= least)
    )
    answers = part.select(*keys, "_salt").join(whole, keys)
    return salted.join(answers, [*keys, "_salt"]).drop("_salt")


def joined_salted(df: DataFrame, key: str, answers: DataFrame, salt_by: str) -> DataFrame:
    """df's rows with the columns of answers, which has a row for each key at most; rows without an answer have nulls.

    A key may hold any share of df's rows: an answer goes once to each of the key's salts, and rows meet it there."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    spread = salted.select(key, "_salt").distinct().join(answers, key)
    return salted.join(spread, [key, "_salt"], "left").drop("_salt")
