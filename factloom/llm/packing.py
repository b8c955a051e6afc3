"""Packing tokenised documents into sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

Documents are spread over partitions by a seeded hash and stand in its order there; a task reads them one after the other and
packs a group whenever its texts reach a number of bytes. So a task holds one group, however many rows a partition has.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.bpe import WordMerges
from factloom.llm.common import WordTable, byte_slices, durable, small, utf8

#: Bytes of text of a group: what a task holds, one document at least.
GROUP_BYTES = 8 << 20
#: Bytes of text of a partition, about, as long as there are no more partitions than this.
PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 20_000
#: Rows of one id and text beyond which their copies are spread over partitions.
HOT_ROWS = 1000


class Tournament:
    """Bins in a row with the greatest room of each subtree; the leftmost bin with enough room is found in log steps."""

    def __init__(self, bins: int, room: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.tree = [room] * (2 * self.size)

    def first_fit(self, need: int) -> int:
        tree, i = self.tree, 1
        if tree[1] < need:
            raise ValueError("no bin has room")
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        tree[i] -= need
        at, i = i - self.size, i // 2
        while i:
            top = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == top:
                break
            tree[i] = top
            i //= 2
        return at


def pack(lengths: list[int], room: int) -> list[list[tuple[int, int, int]]]:
    """Bins of (item, start, length). Items are cut to full bins and a rest; the rests go first-fit decreasing.

    Then the emptiest bins are taken apart to fill the gaps of the others, cutting only those pieces, and what is left at
    the end is cut at powers of two, which need no padding."""
    out, rests = [], []
    for i, n in enumerate(lengths):
        full = n - n % room
        out += [[(i, a, room)] for a in range(0, full, room)]
        if n > full:
            rests.append((i, full, n - full))
    rests.sort(key=lambda x: (-x[2], x[0]))
    bins: list[list[tuple[int, int, int]]] = [[] for _ in rests]
    tree = Tournament(len(rests), room)
    for x in rests:
        bins[tree.first_fit(x[2])].append(x)
    bins = [b for b in bins if b]
    bins.sort(key=lambda b: -sum(x[2] for x in b))
    gaps = [room - sum(x[2] for x in b) for b in bins]
    lo, hi = 0, len(bins) - 1
    while lo < hi:
        if not gaps[lo]:
            lo += 1
            continue
        if not bins[hi]:
            hi -= 1
            continue
        i, a, n = bins[hi].pop()
        take = min(n, gaps[lo])
        bins[lo].append((i, a + n - take, take))
        gaps[lo] -= take
        gaps[hi] += take
        if take < n:
            bins[hi].append((i, a, n - take))
    for b in bins:
        used = sum(x[2] for x in b)
        if not used or used == room:
            out += [b] if used else []
            continue
        for size in (1 << k for k in reversed(range(used.bit_length())) if used >> k & 1):
            seq: list[tuple[int, int, int]] = []
            while size:
                i, a, n = b.pop(0)
                take = min(n, size)
                seq.append((i, a, take))
                size -= take
                if take < n:
                    b.insert(0, (i, a + take, n - take))
            out.append(seq)
    return out


class Vocabulary:
    """Ids of whole texts by a tokenizer that never joins across white space: a table of words, each with its ids in a pool."""

    CHUNK = 2 << 20

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.merges, self.end, self.table = WordMerges(path), end, WordTable()
        self.forget()

    def forget(self) -> None:
        self.pool, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Puts the ids of new words in the pool."""
        ids = self.merges.encode(words)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(list(map(len, ids))) // 4])

    def ids(self, segments: list[bytes]) -> list[np.ndarray]:
        """The ids of each segment, without an end."""
        number, of = self.table.numbers(segments, self.learn, self.forget)
        place = self.ends[number]
        count = self.ends[number + 1] - place
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = self.pool[np.repeat(place - ends[:-1], count) + np.arange(ends[-1])]
        cuts = ends[of].tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    def tokenise(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text and the end, as little-endian unsigned 32-bit integers; texts are read in segments that end at white space."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []
        room, last = self.CHUNK, np.array([self.end], "<u4")

        def flush() -> None:
            for (i, _), ids in zip(held, self.ids([s for _, s in held])):
                parts[i].append(ids)
            held.clear()

        for i, t in enumerate(texts):
            t, at = t or b"", 0
            while at < len(t):
                gap = _GAP.search(t, at + self.CHUNK) if len(t) - at > self.CHUNK else None
                to = gap.start() if gap else len(t)
                if to - at > room:
                    flush()
                    room = self.CHUNK
                held.append((i, t[at:to]))
                room, at = room - (to - at), to
        flush()
        return [np.concatenate([*p, last]).astype("<u4", copy=False).tobytes() for p in parts]


_GAP = re.compile(rb"[\x20\x09-\x0D]")


@cache
def vocabulary(path: str, end: int) -> Vocabulary:
    """One per worker: a function of the module is sent by name, so its cache outlives a task."""
    return Vocabulary(path, end)


def word_ids(path: str, end: int) -> Callable[[list[bytes | None]], list[bytes]]:
    """The ids of whole texts, each followed by the id ``end``."""
    return lambda texts: vocabulary(path, end).tokenise(texts)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))


def _spread(rows: DataFrame, counts: DataFrame, hot: int) -> DataFrame:
    """doc_id, text, h and copy of every row. Rows that repeat more than ``hot`` times (n in counts) are made again with numbers."""
    often = counts.filter(F.col("n") > hot).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h"))
    one = F.lit(0).cast("long").alias("copy")
    if often.isEmpty():
        return rows.select("doc_id", "text", "h", one)
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h"))
    rest = rows.join(small(often), same, "left_anti").select("doc_id", "text", "h", one)
    many = rows.join(small(often), same, "left_semi").groupBy("doc_id", "text", "h").agg(F.count("*").alias("n"))
    blocks = many.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(hot).cast("long"))).alias("at")).repartition("h", "at")
    return rest.unionByName(blocks.select("doc_id", "text", "h", F.explode(F.sequence("at", F.least(F.col("at") + hot, "n") - 1)).alias("copy")))


def pack_documents(docs: DataFrame, tokenise: Callable[[list[bytes | None]], list[bytes]], room: int = 2048, group_bytes: int = GROUP_BYTES, seed: int = 5, with_ids: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """A row per piece of a document; with_ids adds the piece's ids (binary, little-endian unsigned 32-bit).

    Groups are drawn by a seeded hash of id and text, so they mix sources and lengths. A group ends when its texts reach
    ``group_bytes``; a longer text is a group of its own. Null and empty texts have only the final id. Repeated rows are packed
    each, and spread if they are more than ``hot``. Null ids are packed too; ties are rows of one id and text, and alike. Other
    columns are ignored; an empty table gives none. A sequence is named by its partition and its place there, so a lost task
    gives the same pieces again."""
    keyed = _keyed(docs, seed)
    counts = durable(keyed.groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")))
    size = counts.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    parts = min(max(1, -(-size // PARTITION_BYTES)), MOST_PARTITIONS)

    def packed(bucket: int, at: int, ids: list[int | None], texts: list[bytes | None]) -> tuple[pa.RecordBatch, int]:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or b""))
        tokens = tokenise([texts[i] for i in order])
        cols: list[list] = [[] for _ in range(8)]
        made = pack([len(t) // 4 for t in tokens], room)
        for s, seq in enumerate(made, at):
            offset = 0
            for i, a, n in seq:
                cut = tokens[i][4 * a : 4 * (a + n)]
                for c, v in zip(cols, (ids[order[i]], a, n, zlib.crc32(cut), len(tokens[i]) // 4, (bucket << 32) + s, offset, cut)):
                    c.append(v)
                offset += n
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols)], names), at + len(made)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at, held, ids, texts = None, 0, 0, [], []
        for b in byte_slices(batches, 2, group_bytes):
            for g, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if ids and (g != bucket or held + len(t or b"") > group_bytes):
                    out, at = packed(bucket, at, ids, texts)
                    yield out
                    held, ids, texts = 0, [], []
                if g != bucket:
                    bucket, at = g, 0
                held += len(t or b"") + 64  # a row's own cost
                ids.append(i)
                texts.append(t)
        if ids:
            yield packed(bucket, at, ids, texts)[0]

    # the bucket is the partition that Spark itself chooses, as a column
    rows = _spread(keyed, counts, hot).repartition(parts, "h", "copy").sortWithinPartitions("h", "copy", "doc_id", "text")
    rows = rows.select(F.pmod(F.hash("h", "copy"), F.lit(parts)).cast("long").alias("bucket"), "doc_id", "text")
    return rows.mapInArrow(kernel, PIECES + ", ids binary" * with_ids)
