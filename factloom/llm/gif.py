"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import slices

#: Columns of a stored payload, and rows of one of its frames at most.
WIDTH, FRAME_ROWS = 64, 256
#: Three bits of red and green and two of blue.
PALETTE = bytes(v for i in range(256) for v in (i & 0xE0, i << 3 & 0xE0, i << 6 & 0xC0))
GREY = bytes(v for i in range(256) for v in (i, i, i))
#: Pixels that one image or canvas may claim (memory of a task); one that claims more is broken.
MOST_PIXELS = 1 << 26


def _widths(least: int, codes: int) -> np.ndarray:
    """Bits of each code after a clear code, by its ordinal: every code but the first adds an entry to the reader's table."""
    entries = (1 << least) + 2 + np.maximum(np.arange(codes) - 1, 0)
    return np.minimum(np.floor(np.log2(entries)).astype(np.int64) + 1, 12)


_CODES = 4200
_WIDTHS = {k: _widths(k, _CODES) for k in range(2, 9)}
_ENDS = {k: np.concatenate([[0], np.cumsum(w)]) for k, w in _WIDTHS.items()}


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """The LZW code stream of samples below 2 ** least, from a first clear code to the end code, bits from the lowest."""
    clear, end = 1 << least, (1 << least) + 1
    widths, width, bits, bit = _WIDTHS[least], least + 1, [], np.arange(12)
    source, last = iter(data), False
    w = next(source, None)
    while not last:
        codes, table, free = [clear], {}, clear + 2
        get, put = table.get, codes.append
        for c in source:
            k = w << 8 | c
            v = get(k)
            if v is not None:
                w = v
            else:
                put(w)
                table[k] = free
                free += 1
                w = c
                if free == 4095:
                    break
        else:
            last = True
            if w is not None:
                put(w)
            put(end)
        # a clear code has the width reached before it, the first of the stream the least one
        size = np.concatenate([[width], widths[: len(codes) - 1]])
        width = widths[len(codes) - 1]
        value = (np.array(codes, np.int64)[:, None] >> bit & 1).astype(np.uint8)
        bits.append(value[bit < size[:, None]])
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int, pixels: int) -> bytes:
    """The samples of a code stream: at most ``pixels``, fewer if the stream ends first or breaks."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8)
    total, at = 8 * len(stream), 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, done = [], 0
    ends = _ENDS[least]

    def unpack(first: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        p = first + start
        i = p >> 3
        word = raw[i].astype(np.int64) | raw[i + 1].astype(np.int64) << 8 | raw[i + 2].astype(np.int64) << 16
        return word >> (p & 7) & ((1 << size) - 1)

    sizes = _WIDTHS[least]
    while at < total and done < pixels:
        room = int(np.searchsorted(ends, total - at, "right")) - 1
        if room <= 0:
            break
        codes = unpack(at, ends[:room], sizes[:room])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else -1
        use = (codes[:stop] if stop >= 0 else codes).tolist()
        table, prev = list(roots), None
        push = table.append
        pieces = []
        for c in use:
            if prev is None:
                if c >= clear:
                    break
                prev = table[c]
            else:
                if c < len(table):
                    entry = table[c]
                elif c == len(table):
                    entry = prev + prev[:1]
                else:
                    break
                if len(table) < 4096:
                    push(prev + entry[:1])
                prev = entry
            pieces.append(prev)
        out.append(b"".join(pieces))
        done += len(out[-1])
        if stop < 0:
            at = _unclear(raw, total, at + int(ends[room]), table, prev, clear, end, out) if room == _CODES and len(pieces) == room else total
            done = sum(map(len, out))
        elif codes[stop] == end or len(pieces) < stop:
            break
        else:
            at += int(ends[stop + 1])
    return b"".join(out)[:pixels]


def _unclear(raw: np.ndarray, total: int, at: int, table: list[bytes], prev: bytes, clear: int, end: int, out: list[bytes]) -> int:
    """Codes of 12 bits with a full table, up to a clear code; returns the bit after it, or the end of the stream."""
    while at + 12 <= total:
        i = at >> 3
        c = (int(raw[i]) | int(raw[i + 1]) << 8 | int(raw[i + 2]) << 16) >> (at & 7) & 4095
        at += 12
        if c == clear:
            return at
        if c == end or c >= len(table):
            return total
        out.append(table[c])
    return total


def encode(payload: bytes, delay: int = 10, rows: int = FRAME_ROWS) -> bytes:
    """A GIF of 64 columns whose samples are the payload's bytes (a positive multiple of 64), in timed frames of so many rows at most.

    Zero bytes are transparent, and each frame is cleared before the next (disposal to background), so a frame shows its own bytes only."""
    lines = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(lines, rows), 0xF7, 0, 0), PALETTE]
    for at in range(0, lines, rows):
        n = min(rows, lines - at)
        data = lzw_encode(payload[at * WIDTH : (at + n) * WIDTH])
        out += [b"\x21\xf9\x04\x09", struct.pack("<H", delay), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08"]
        out += [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)] + [b"\0"]
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """One image of a file: where it stands, its samples (rows in order), its palette, and how it is shown."""

    left: int
    top: int
    width: int
    height: int
    samples: bytes
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int | None


@dataclass
class Gif:
    width: int
    height: int
    frames: list[Frame]
    loops: int | None
    broken: bool


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << (flags & 7) + 1
    found = np.frombuffer(data[at : at + n].ljust(n, b"\0"), np.uint8).reshape(-1, 3)
    return found, at + n


def decode(data: bytes | None) -> Gif | None:
    """Reads a file; null where there is no GIF header. What follows a break in the stream is missing and ``broken`` is set."""
    if data is None or data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return None
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    shared, at = _palette(data, 13, flags) if flags & 0x80 else (np.frombuffer(GREY, np.uint8).reshape(-1, 3), 13)
    gif, control = Gif(width, height, [], None, width * height > MOST_PIXELS), (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            block, after = _blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(block) >= 4:
                control = (block[0] >> 2 & 7, block[1] | block[2] << 8, block[3] if block[0] & 1 else None)
            elif data[at + 1] == 0xFF and block[:11] == b"NETSCAPE2.0" and len(block) >= 14:
                gif.loops = block[12] | block[13] << 8
            at = after
        elif kind == 0x2C and at + 11 <= len(data):
            left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
            palette, at = _palette(data, at + 10, f) if f & 0x80 else (shared, at + 10)
            least = data[at] if at < len(data) else 0
            if not 2 <= least <= 8 or w * h > MOST_PIXELS:
                gif.broken = True
                break
            stream, at = _blocks(data, at + 1)
            samples = lzw_decode(stream, least, w * h)
            gif.broken |= len(samples) < w * h
            if f & 0x40:
                samples = samples.ljust(w * h, b"\0")
                lines = [samples[i * w : (i + 1) * w] for i in range(h)]
                order = [y for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(a, h, b)]
                samples = b"".join(x for _, x in sorted(zip(order, lines)))
            gif.frames.append(Frame(left, top, w, h, samples, palette, control[1], control[0], control[2]))
            control = (0, 0, None)
        else:
            gif.broken = True
            break
    gif.broken |= at >= len(data)
    return gif


def composite(gif: Gif) -> Iterator[np.ndarray]:
    """The canvas (height, width, RGBA; one array, changed from frame to frame) as each frame shows it, by the rules of disposal and transparency; none if it claims too much."""
    if gif.width * gif.height > MOST_PIXELS:
        return
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for f in gif.frames:
        before = canvas.copy() if f.disposal == 3 else None
        x = np.frombuffer(f.samples.ljust(f.width * f.height, b"\0"), np.uint8).reshape(f.height, f.width)
        box = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        x = x[: box.shape[0], : box.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        shown = colours[x]
        box[...] = shown if f.transparent is None else np.where((x == f.transparent)[..., None], box, shown)
        yield canvas
        if f.disposal == 2:
            box[...] = 0
        elif before is not None:
            canvas = before


def histogram(pixels: np.ndarray) -> list[int]:
    """Counts of visible pixels in 8 bins of each of red, green and blue."""
    seen = pixels.reshape(-1, 4)
    seen = seen[seen[:, 3] > 0]
    return [int(n) for c in range(3) for n in np.bincount(seen[:, c] >> 5, minlength=8)]


FRAMES = "frame int, start_cs long, delay_cs int, width int, height int, disposal int, rgb_histogram array<long>, broken boolean"


def frame_columns(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row per composited frame: key, place, start and delay in hundredths of a second, size and colour histogram.

    Null, empty or foreign bytes give no row; a broken stream gives its whole frames and ``broken``, and a canvas of more than
    MOST_PIXELS one row without place and histogram that is ``broken``. Repeated rows give repeated frames; other columns are
    ignored; an empty table gives none."""

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            rows = []
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                gif, start = decode(data), 0
                if gif and gif.width * gif.height > MOST_PIXELS:
                    rows.append({key: k, "width": gif.width, "height": gif.height, "broken": True})
                for i, (f, pixels) in enumerate(zip(gif.frames, composite(gif)) if gif else ()):
                    rows.append({key: k, "frame": i, "start_cs": start, "delay_cs": f.delay, "width": gif.width, "height": gif.height, "disposal": f.disposal, "rgb_histogram": histogram(pixels), "broken": gif.broken})
                    start += f.delay
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(key, b.schema.field(0).type), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("rgb_histogram", pa.list_(pa.int64())), ("broken", pa.bool_())]))

    rows = media.select(F.col(key), F.col(column))
    return rows.mapInArrow(kernel, f"{key} {rows.dtypes[0][1]}, {FRAMES}")


def padded(text: bytes | None) -> bytes:
    """The text with zero bytes up to a positive multiple of 64."""
    t = text or b""
    return t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
