"""Helpers shared by the operators of this subpackage: words, durable tables, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a Java and Python character class. ``bytes.split()`` splits at the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that a broadcast side may have; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000

U64 = np.uint64


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; null text gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words as long, without building more than the split array."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(t, rf"^{SPACE}|{SPACE}\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI; a local one is made only where none is named and Spark is local."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="factloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named if "://" in named or named.startswith("file:") else "file://" + os.path.abspath(named)


def over_cores(df: DataFrame, key: str) -> DataFrame:
    """A table of fewer splits than there are cores (one small file, say) spread by its key; any other as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, key)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a durable table of at most ``limit`` rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= limit else df


def part(n: int, of: list[Column]) -> Column:
    """Bucket 0 to n - 1 by hash."""
    return F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches, so that a kernel holds the words of few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, most: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into slices of at most ``most`` bytes of a text column (one row at least) and ``rows`` rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(at, stop - at)
            at = stop


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_ONES = np.array([0] + [(1 << 8 * i) - 1 for i in range(1, 9)], U64)
#: Words of more bytes are hashed one by one.
_LONG = 256


class Words:
    """The words of several texts in one buffer: where each starts, its bytes, and how many end before each text's end (from 0)."""

    def __init__(self, texts: list[bytes | None]):
        self.buf = b" ".join([*(t or b"" for t in texts), b" " * 16])
        raw = np.frombuffer(self.buf, np.uint8)
        inside = ~((raw == 32) | (raw - np.uint8(9) <= 4))
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edge = np.concatenate([[0], edge]) if inside[0] else edge
        self.start, self.size = edge[::2], edge[1::2] - edge[::2]
        self.ends = np.concatenate([[0], np.searchsorted(self.start, np.cumsum([len(t or b"") + 1 for t in texts]))]).astype(np.int64)
        self.zeros = np.flatnonzero(raw == 0)
        self._eight = np.ndarray((len(raw) - 7,), "<u8", self.buf, 0, (1,))

    def lane(self, i: int, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bytes 8 i to 8 i + 7 of the words, zero past their ends (which are not before byte 8 i)."""
        return self._eight[self.start[of] + 8 * i] & _ONES[np.minimum(self.size[of] - 8 * i, 8)]

    def take(self, of: np.ndarray) -> list[bytes]:
        return [self.buf[i:j] for i, j in zip(self.start[of].tolist(), (self.start[of] + self.size[of]).tolist())]


def hash_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the offset of each text (one more than texts)."""
    w = Words(texts)
    out = mix(w.lane(0) ^ w.size.astype(U64) * U64(0xD1342543DE82EF95))
    most = int(w.size.max()) if len(w.size) else 0
    for i in range(1, -(-min(most, _LONG) // 8)):
        of = np.flatnonzero(w.size > 8 * i)
        out[of] = mix(out[of] * U64(0x9E3779B97F4A7C15) + w.lane(i, of))
    if most > _LONG:
        of = np.flatnonzero(w.size > _LONG)
        out[of] = [xxhash.xxh3_64_intdigest(x) for x in w.take(of)]
    return out, w.ends


class WordTable:
    """Numbers distinct words, from 0, as they come; what they are numbered for is kept by the owner.

    Words of up to 16 bytes are two 64-bit keys in an open-addressing table, looked up all at once; longer ones, and those
    with a zero byte, are in a dictionary. A table that is full starts anew, so it only saves work."""

    def __init__(self, bits: int = 20):
        self.bits, self.limit = bits, 1 << bits - 1
        self.clear()

    def clear(self) -> None:
        self.keys, self.number = np.zeros((2, 1 << self.bits), U64), np.zeros(1 << self.bits, np.int32)
        self.long: dict[bytes, int] = {}
        self.held = 0

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(a ^ b * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_, slot = np.full(len(a), -1, np.int64), np.arange(len(a)), self._slots(a, b)
        while len(open_):
            x, y = self.keys[0][slot], self.keys[1][slot]
            hit = (x == a[open_]) & (y == b[open_])
            out[open_[hit]] = self.number[slot[hit]]
            go = ~hit & (x != 0)
            open_, slot = open_[go], slot[go] + 1 & (1 << self.bits) - 1
        return out

    def _put(self, a: np.ndarray, b: np.ndarray, number: np.ndarray) -> None:
        """Holds distinct keys that aren't held."""
        open_, slot = np.arange(len(a)), self._slots(a, b)
        while len(open_):
            free = np.flatnonzero(self.keys[0][slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            won = open_[free[first]]
            self.keys[0][at], self.keys[1][at], self.number[at] = a[won], b[won], number[won]
            rest = np.ones(len(open_), bool)
            rest[free[first]] = False
            open_, slot = open_[rest], slot[rest]
            slot = np.where(self.keys[0][slot] == 0, slot, slot + 1 & (1 << self.bits) - 1)

    def numbers(self, texts: list[bytes | None], learn: Callable[[list[bytes]], None], forget: Callable[[], None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and the offset of each text. ``learn`` gets new words in the order of their numbers;
        ``forget`` is called where the table starts anew. Texts of so many distinct words that the table can't hold must be cut."""
        w = Words(texts)
        a, b = w.lane(0), np.zeros(len(w.start), U64)
        over = np.flatnonzero(w.size > 8)
        b[over] = w.lane(1, over)
        slow = w.size > 16
        slow[np.searchsorted(w.start, w.zeros, "right") - 1] = True
        out = np.full(len(w.start), -1, np.int64)
        fast, rest = np.flatnonzero(~slow), np.flatnonzero(slow)
        a, b = a[fast], b[fast]
        found, words = self._find(a, b), w.take(rest)
        new = np.flatnonzero(found < 0)
        if self.held and self.held + len(new) + len(words) > self.limit:
            self.clear()
            forget()
            found, new = np.full(len(a), -1, np.int64), np.arange(len(a))
        if len(new):
            order = new[np.lexsort((b[new], a[new]))]
            once = np.ones(len(order), bool)
            once[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
            order = order[once]
            self._put(a[order], b[order], self.held + np.arange(len(order)))
            self.held += len(order)
            learn(w.take(fast[order]))
            found[new] = self._find(a[new], b[new])
        fresh = list(set(words).difference(self.long))
        if fresh:
            self.long.update(zip(fresh, range(self.held, self.held + len(fresh))))
            self.held += len(fresh)
            learn(fresh)
        out[fast], out[rest] = found, [self.long[x] for x in words]
        return out, w.ends


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; the result is k - 1 shorter than h (empty if h is)."""
    n = max(0, len(h) - k + 1)
    out = mix(h[:n] + U64(k))
    for j in range(1, k):
        out = mix(out * U64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def roll_at(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the runs of k words that begin at the given places."""
    n = len(at)
    a, b = np.full(n, U64(k)), np.zeros(n, U64)
    for j in range(k):
        x = h[at + j]
        a = mix(a * U64(0x9E3779B97F4A7C15) + x)
        b = b * U64(0xD6E8FEB86659FD93) + x
    return a, mix(b)
