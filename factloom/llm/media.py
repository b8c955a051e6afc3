"""Texts stored as GIF samples and read back, with features of the pictures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import gif
from factloom.llm.common import byte_slices, new_folder, slices, utf8


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a GIF) of every row of docs (doc_id, text); null texts are empty.

    An empty text is one row of 64 zero bytes; long ones have many frames. Repeated rows give repeated media, and equal texts
    equal bytes. Null ids stay null; other columns are ignored; an empty table gives none."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, 1, 1 << 20):
            texts = utf8(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([gif.encode(gif.padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(kernel, "doc_id long, n_bytes long, media binary")


def feature(picture: gif.Gif) -> str:
    """Frames, shown time, and the share (per mille) of visible pixels of all composited frames in 8 bins of red, green and blue."""
    bins = np.zeros(24, np.int64)
    for canvas in gif.composite(picture):
        bins += gif.histogram(canvas)
    return f"{len(picture.frames)};{sum(f.delay for f in picture.frames)};" + ",".join(map(str, (1000 * bins // max(1, int(bins[:8].sum()))).tolist()))


OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _row(media: bytes) -> tuple:
    picture = gif.decode(media)
    payload = b"".join(f.samples for f in picture.frames)
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(picture)


def read_back(stored: DataFrame) -> DataFrame:
    """The payload of stored media (doc_id, n_bytes, media), its digests and the features of its pictures."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in slices(batches, 64):
            made = list(zip(*map(_row, b.column(2).to_pylist()))) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(made, kinds)]], [x.split()[0] for x in OUT.split(", ")])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(kernel, OUT)


def digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes what ``store`` makes of every row as Parquet in a new shared folder (or the one named), and reads the stored bytes back."""
    spark, folder = docs.sparkSession, folder or new_folder(docs.sparkSession, "media")
    store(docs).write.parquet(folder)
    return read_back(spark.read.parquet(folder))
