"""What the operators share: bounded chunks of text and word hashes, and tables settled in the shared folder.

Words are found on the UTF-8 bytes of a whole Arrow chunk at once. Every byte of a
character outside ASCII is a word byte, so words never split inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import settled
from lodestone.sources.settled import forget, release

__all__ = ["forget", "release", "settle"]

#: Bytes of text that one step of a Python worker looks at (a single longer text is one step of its own).
CHUNK_BYTES = 1_000_000

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, what: str) -> DataFrame:
    """settled.settle, after which the driver keeps no memory that the step has freed: the operators take many steps."""
    out = settled.settle(df, what)
    settled.trim(df.sparkSession)
    return out


def hot(counted: DataFrame, total: int) -> DataFrame:
    """The keys of counted, each with its n rows of total, that hold too many for one task: 10,000 at most, so they can be broadcast."""
    return F.broadcast(counted.where(F.col("n") > max(100, total // 10_000)))


def hot_join(rows: DataFrame, told: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined with told, which has each key once with its n, the key's rows of total; a key of very many rows is not shuffled."""
    most = max(100, total // 10_000)
    some = told.where(F.col("n") <= most)
    here = rows.join(hot(told, total), keys)
    apart = rows.join(hot(told.select(*keys, "n"), total).select(*keys), keys, "left_anti").join(some, keys)
    return here.drop("n").unionByName(apart.drop("n"))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about limit bytes together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = _offsets(batch.column(column))[1:]
        at = 0
        base = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            base = int(ends[to - 1])
            at = to


def _offsets(array: pa.Array) -> np.ndarray:
    """Bytes before each text of the array, and all; null texts have none."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(array), 0)
    return np.concatenate([[0], np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))])


def slices(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of an array of texts, each of about limit bytes, and where they begin."""
    at = 0
    for batch in chunks(iter([pa.RecordBatch.from_arrays([array], names=["text"])]), limit=limit):
        yield at, batch.column("text")
        at += batch.num_rows


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and where each begins (one more entry than texts). Null is as empty."""
    array = array.cast(pa.large_string())
    if array.null_count:
        array = pa.compute.fill_null(array, "")
    if not len(array):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def byte_table(word: str) -> np.ndarray:
    """Which bytes belong to words: the ASCII characters of word, and all bytes from 0x80."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in word]] = True
    out[128:] = True
    return out


#: All but white space.
SPACED = byte_table("".join(chr(c) for c in range(128) if c != 32 and not 9 <= c <= 13))
#: Letters and digits, and all that is not ASCII.
ALNUM = byte_table("".join(chr(c) for c in range(128) if chr(c).isalnum()))

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def find_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the index of its text."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    inside = word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][np.diff(offsets) > 0]
    first[begin] = inside[begin]
    end = offsets[1:][np.diff(offsets) > 0] - 1
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as any chunk has needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = (np.full(size, p, np.uint64) for p in (_PRIME, pow(int(_PRIME), -1, 1 << 64)))
            cls.up[0] = cls.down[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(cls.up, out=cls.up)
                np.cumprod(cls.down, out=cls.down)
        return cls.up, cls.down


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash takes the hash of any span, A-Z lower-cased."""
    up, _ = _Powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_LOWER[data] * up[: len(data)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the bytes from starts to ends."""
    _, down = _Powers.reach(len(sums))
    with np.errstate(over="ignore"):
        out = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    out[out == 0] = 1
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_sums(data), starts, ends)
