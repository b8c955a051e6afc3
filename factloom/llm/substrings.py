"""Substring dedup by relative Lempel-Ziv factors: each text against all documents of smaller ids.

The reference is the collection itself, indexed by its phrases (windows of ``width`` consecutive words) in blocks, one per
shuffle partition. A text is looked up in every block: each of its phrases gets the least earlier document and place that has
it. The parse then goes from left to right: a factor starts at the first phrase with a source and is extended word by word
while the next phrase continues that source; at a factor's boundary the next phrase is looked at anew, so that a phrase that
straddles two factors counts too. Factors have at least ``width`` words; those that overlap or touch merge into spans.
A factor follows its earliest source, not its longest: that decides how many factors a span has, never its words.

Only phrases that may repeat reach the index. Each phrase has an anchor, the least hash of its 5-word runs; equal phrases
have equal anchors. Anchors (about one in five words) are shuffled first; phrases follow only for anchors of two or more
documents. Phrases are compared by 96 bits of two independent hashes of their words, so that of 10^14 phrases less than one
pair of different ones is expected to agree. Equal texts are one document here: but for the first, all their words are spans.

Skew: within a slice of documents (``SLICE_BYTES`` of text) only the least document of a key asks the index; the others have
their source there already, and travel under keys of their own. So a key, even one that every document has, is one row of a
few longs per slice in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import U64, byte_slices, durable, hash_texts, mix, roll, roll_at, small, utf8

GRAM = 5
#: Text that a kernel looks at together (one document at least).
SLICE_BYTES = 4 << 20


def _anchors_of(texts: list[bytes | None], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and of all phrases of the texts: index of the text, first word there and in all, anchor (48 bits)."""
    flat, ends = hash_texts(texts)
    size = np.maximum(np.diff(ends) - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), size)
    pos = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    at = ends[:-1][text] + pos
    gram = min(GRAM, width)
    least, span, want = roll(flat, gram), 1, width - gram + 1
    while span < want:
        step = min(span, want - span)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        span += step
    return flat, text, pos.astype(np.int32), at, least[at] >> U64(16)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, in arrays sorted by them."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _anchors(width: int):
    """Rows (x, document) where x is an anchor and two bits: 0 asks the index, 1 is known to repeat, 2 asks and is known."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, SLICE_BYTES):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            _, text, _, _, anchor = _anchors_of(utf8(b.column(1)), width)
            keep = _runs(anchor, text)
            anchor, doc = anchor[keep], ids[text[keep]]
            order = np.lexsort((doc, anchor))
            a, d = anchor[order], doc[order]
            once = _runs(a, d)
            a, d = a[once], d[once]
            starts = _runs(a)
            known = np.ones(len(a), U64)
            known[starts] = 2 * (np.diff(np.append(starts, len(a))) > 1)
            yield pa.RecordBatch.from_arrays([pa.array((a << U64(2) | known).view(np.int64)), pa.array(d, pa.int64())], ["x", "doc_id"])

    return kernel


#: w: a hash; vp: 32 bits of another, then the position; source and at: null for phrases that ask the index.
_PHRASES = "w long, vp long, doc_id long, alt long, source long, at int"


def _phrases(width: int):
    """Rows of phrases: those of the least document of a slice ask the index, the others have that document as their source."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 2, SLICE_BYTES):
            b = b.filter(b.column(0).is_valid())
            ids, alts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            flat, text, pos, at, anchor = _anchors_of(utf8(b.column(2)), width)
            shared = b.column(3)
            hit = np.zeros(len(text), bool)
            bounds = np.searchsorted(text, np.arange(len(ids) + 1))
            for i in range(len(ids)):
                hit[bounds[i] : bounds[i + 1]] = np.isin(anchor[bounds[i] : bounds[i + 1]], np.asarray(shared[i].values).view(U64))
            w, v = roll_at(flat, at[hit], width)
            v, d, x, p = v >> U64(32), ids[text[hit]], alts[text[hit]], pos[hit]
            order = np.lexsort((p, x, d, v, w))
            w, v, d, x, p = w[order], v[order], d[order], x[order], p[order]
            starts = _runs(w, v)
            first = np.repeat(starts, np.diff(np.append(starts, len(w))))
            asks = d == d[first]
            w = np.where(asks, w, mix(w ^ mix(d.view(U64))))
            vp = (v << U64(32) | p.astype(U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(vp), pa.array(d, pa.int64()), pa.array(x, pa.int64()), pa.array(d[first], pa.int64(), mask=asks), pa.array(p[first], pa.int32(), mask=asks)], [c.split()[0] for c in _PHRASES.split(", ")])

    return kernel


def parse(pos: np.ndarray, source: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Factors (first word, end, source, first word there) of a text from its phrases with their sources, in any order."""
    pos, once = np.unique(pos, return_index=True)
    source, at = source[once], at[once]
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos) != 1) | (source[1:] != source[:-1]) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pos)) - 1
    return pos[first], pos[last] + width, source[first], at[first]


_FACTORS = "doc_id long, alt long, starts array<int>, ends array<int>, sources array<long>, source_starts array<int>"


def _factors(width: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for row in b.column(2):
                f = row.values
                found.append(parse(*(f.field(i).to_numpy(zero_copy_only=False) for i in range(3)), width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array([f[i] for f in found], pa.list_(k)) for i, k in enumerate(kinds)]], [c.split()[0] for c in _FACTORS.split(", ")])

    return kernel


class Texts:
    """The rows of docs as doc_id, alt, text and row (a struct of the other columns): ``read`` as they lie, ``spread`` by id.

    ``alt`` tells the texts of one id apart (0: the id has one). Copies are the texts of which a smaller id has an equal."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        t = F.col(f"`{text}`")
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("alt"), t.alias("text"), rest.alias("row"))
        ids = durable(rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "alt", F.md5("text").alias("digest")))
        several = durable(ids.groupBy("doc_id").agg(F.min("alt").alias("a"), F.max("alt").alias("b")).filter("a < b").select("doc_id", F.lit(True).alias("several")))
        self.plain = several.isEmpty()

        def keyed(rows: DataFrame) -> DataFrame:
            if self.plain:
                return rows.withColumn("alt", F.lit(0).cast("long"))
            return rows.join(small(several), "doc_id", "left").withColumn("alt", F.when(F.col("several"), F.col("alt")).otherwise(0).cast("long")).drop("several")

        self.read = keyed(rows).select("doc_id", "alt", "text", "row")
        # rows without an id meet nothing; a hash spreads them
        self.spread = self.read.select(F.coalesce("doc_id", F.xxhash64("text", "row")).alias("k"), "doc_id", "alt", "text", "row").repartition("k")
        groups = ids.groupBy("digest").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).filter("n > 1").select("digest", "head")
        equal = durable(keyed(ids).join(groups, "digest"))
        self.copies = durable(equal.filter("doc_id > head").select("doc_id", "alt", "head").distinct())
        self.again = durable(equal.filter("doc_id = head").groupBy("doc_id", "alt").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "alt"))

    def distinct(self, rows: DataFrame) -> DataFrame:
        """Without the copies, and once where rows repeat as a whole."""
        rows = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").join(small(self.copies.select("doc_id", "alt")), ["doc_id", "alt"], "left_anti")
        if self.again.isEmpty():
            return rows
        rest = [c for c in rows.columns if c not in ("doc_id", "alt")]
        one = rows.join(small(self.again), ["doc_id", "alt"], "left_semi").groupBy("doc_id", "alt").agg(*[F.first(c).alias(c) for c in rest])
        return rows.join(small(self.again), ["doc_id", "alt"], "left_anti").select("doc_id", "alt", *rest).unionByName(one)


def repeated_factors(texts: Texts, width: int = 13) -> DataFrame:
    """doc_id, alt, copy_of (all words of the text go: the first document of an equal text), starts, ends, sources and source_starts.

    The factors of documents that lose words, in order of their first word; ``ends`` are exclusive."""
    rows = texts.distinct(texts.read).select("doc_id", "text").mapInArrow(_anchors(width), "x long, doc_id long")
    known, h = F.col("x").bitwiseAND(3), F.shiftright("x", 2)
    key = F.when(known != 1, h).otherwise(F.xxhash64("x", "doc_id"))
    # keys of windows are made after the shuffle, not sent
    rows = rows.repartition(key)
    shared = rows.select("x", "doc_id", F.count("*").over(Window.partitionBy(key, known == 1)).alias("n")).filter((F.col("n") > 1) | (known > 0))
    shared = durable(shared.groupBy(F.col("doc_id").alias("k")).agg(F.collect_set(h).alias("anchors")))

    # ids of copies have no anchor but where an id has several texts; row goes along unread, so that one shuffle of the texts serves here and in ``marked``
    rows = texts.spread.join(shared, "k")
    rows = rows if texts.plain and texts.again.isEmpty() else texts.distinct(rows)
    rows = rows.select("doc_id", "alt", "text", "anchors", "row").mapInArrow(_phrases(width), _PHRASES)
    rows = (rows.drop("alt") if texts.plain else rows).repartition("w")
    pos = F.col("vp").bitwiseAND(0x7FFFFFFF).cast("int")
    least = F.min(F.struct("doc_id", pos.alias("pos"))).over(Window.partitionBy("w", F.shiftright("vp", 32), F.col("source").isNull()))
    found = rows.select("*", least.alias("least")).filter("source IS NOT NULL OR doc_id > least.doc_id")
    found = found.select("doc_id", *([] if texts.plain else ["alt"]), F.struct(pos.alias("pos"), F.coalesce("source", "least.doc_id").alias("source"), F.coalesce("at", "least.pos").alias("at")).alias("x"))
    found = found.withColumn("alt", F.lit(0).cast("long")) if texts.plain else found
    # bounded by the phrases of one text
    parsed = found.groupBy("doc_id", "alt").agg(F.collect_list("x").alias("x")).mapInArrow(_factors(width), _FACTORS)
    none = [F.array().cast(t).alias(c) for c, t in (("starts", "array<int>"), ("ends", "array<int>"), ("sources", "array<long>"), ("source_starts", "array<int>"))]
    return parsed.withColumn("copy_of", F.lit(None).cast("long")).unionByName(texts.copies.select("doc_id", "alt", *none, F.col("head").alias("copy_of")))


def factor_table(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, start, length, source_id and source_start of every factor; a copy of a whole text has a null length.

    Null, empty and short texts and null ids have no factor. Ids of several texts have the factors of each. Repeated rows
    have theirs once. An empty table gives none."""
    f = repeated_factors(Texts(docs.select("doc_id", "text")), width)
    pieces = f.select("doc_id", F.inline(F.arrays_zip("starts", "ends", "sources", "source_starts"))).select("doc_id", F.col("starts").alias("start"), (F.col("ends") - F.col("starts")).alias("length"), F.col("sources").alias("source_id"), F.col("source_starts").alias("source_start"))
    return pieces.unionByName(f.filter("copy_of IS NOT NULL").select("doc_id", F.lit(0).alias("start"), F.lit(None).cast("int").alias("length"), F.col("copy_of").alias("source_id"), F.lit(0).alias("source_start")))


def marked(docs: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """Every row of docs as text, row (a struct of its other columns), copy, starts and ends (null where nothing goes)."""
    texts = Texts(docs, text)
    found = repeated_factors(texts, width).select(F.col("doc_id").alias("k"), F.col("alt").alias("of"), F.col("copy_of").isNotNull().alias("copy"), "starts", "ends")
    rows = texts.spread.alias("r").join(found.alias("f"), (F.col("r.k") == F.col("f.k")) & (F.col("r.alt").bitwiseXOR(F.col("f.of")) == 0) & F.col("r.doc_id").isNotNull(), "left")
    return rows.select("text", "row", "copy", "starts", "ends")


def cut(text: bytes | None, copy: bool, starts, ends, width: int) -> tuple[list[bytes], int]:
    """The words that stay, and how many go. A copy that has a phrase loses all; it has no factor otherwise."""
    words = (text or b"").split()
    if copy:
        return ([], len(words)) if len(words) >= width else (words, 0)
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept += words[at:a]
        at = max(at, b)
    kept += words[at:]
    return kept, len(words) - len(kept)


def removal_report(docs: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs (doc_id, text).

    A word goes if a phrase that covers it also starts in a document of a smaller id. Null and empty texts have no word, and
    texts shorter than a phrase lose none. Rows without an id lose nothing and take nothing. Repeated rows are one document,
    so none loses words to another; rows that share an id but not a text are judged by their own words, and not against each
    other. Ties of sources go to the least id. Other columns are ignored; an empty table gives none."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, SLICE_BYTES):
            texts, n, gone, sha = utf8(b.column(1)), [], [], []
            for t, c, s, e in zip(texts, *(b.column(i).to_pylist() for i in (2, 3, 4))):
                kept, out = cut(t, bool(c), s or (), e or (), width)
                n.append(len(kept) + out)
                gone.append(out)
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0).field(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    cols = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width).select("row", "text", "copy", "starts", "ends")
    return cols.mapInArrow(kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """All rows and columns of docs with repeated words cut from the text, and n_removed (a column of that name is replaced).

    See ``removal_report`` for which words go. A text that loses nothing is unchanged; of others the rest is joined by single
    spaces. Null texts stay null. Any other column passes through, whatever its name."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 0, SLICE_BYTES):
            out, gone = [], []
            for t, c, s, e in zip(utf8(b.column(0)), *(b.column(i).to_pylist() for i in (1, 2, 3))):
                kept, n = cut(t, bool(c), s or (), e or (), width)
                out.append(None if t is None else b" ".join(kept).decode() if n else t.decode())
                gone.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(gone, pa.int64()), b.column(4)], ["text", "gone", "row"])

    rest = [c for c in docs.columns if c != "n_removed"]
    found = marked(docs.select(*[F.col(f"`{c}`") for c in rest]), width, text)
    done = found.select("text", "copy", "starts", "ends", "row").mapInArrow(kernel, f"text string, gone long, row {dict(found.dtypes)['row']}")
    return done.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in rest], F.col("gone").alias("n_removed"))
