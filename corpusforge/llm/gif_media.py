"""GIF as a media column: lossless storage of bytes, and decoding into timed frames with colour histograms.

``read_gif`` takes any GIF89a or GIF87a: global and local palettes, interlacing, transparency, the disposal
methods 0 to 3, LZW streams of any minimum code size, with deferred clear codes. ``shown`` lays the frames on the
canvas as a viewer would. ``write_gif`` stores frames of 8-bit samples. ``payload_media`` uses all of them: a text's
bytes, padded, become rows of 64 samples under a palette of 256 colours, are stored as a GIF, and everything returned
comes from the stored bytes read back: digests from the samples, timed frames and features from the canvas.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusforge.llm.common import map_texts, only

#: Samples in a row of a stored payload.
WIDTH = 64
#: Rows of one frame; a longer payload goes on in the next frame.
FRAME_ROWS = 4096
#: Hundredths of a second that a payload's frame stands.
DELAY = 10
#: Pixels of a canvas or a frame at most: four bytes each on show. Larger media are reported as unreadable.
MOST_PIXELS = 1 << 24
MAX_CODES = 4096


class GifError(ValueError):
    """The bytes are no readable GIF."""


@dataclass
class Frame:
    """One frame as stored: its place, timing and samples, and its palette as an (n, 3) array."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None


# LZW -----------------------------------------------------------------------------


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of each of the first n codes after a clear code; it depends on a code's index alone."""
    key = (size, 1 << max(n - 1, 0).bit_length())
    if key not in _width_tables:
        following = (1 << size) + 1 + np.arange(key[1], dtype=np.int64)
        bits = np.floor(np.log2(following)).astype(np.int64) + 1
        bits[0] = size + 1
        _width_tables[key] = np.clip(bits, size + 1, 12)
    return _width_tables[key][:n]


_width_tables: dict[tuple[int, int], np.ndarray] = {}


def lzw_encode(data: bytes, size: int = 8) -> bytes:
    """The code stream of samples under 2**size, with a clear code at its start and wherever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    segments: list[list[int]] = []
    codes = [clear]
    put = codes.append
    table: dict[int, int] = {}
    get, following = table.get, end + 1
    head = [] if not data else [data[0]]
    if head:
        now = head[0]
        for sample in memoryview(data)[1:]:
            key = now << 8 | sample
            found = get(key)
            if found is None:
                put(now)
                table[key] = following
                following += 1
                if following == MAX_CODES:
                    put(clear)
                    segments.append(codes)
                    codes = []
                    put = codes.append
                    table.clear()
                    following = end + 1
                now = sample
            else:
                now = found
        put(now)
    put(end)
    segments.append(codes)
    widths = []
    for k, segment in enumerate(segments):  # the first clear code stands before the first segment's index 0
        widths += [np.array([size + 1]), _widths(len(segment) - 1, size)] if k == 0 else [_widths(len(segment), size)]
    return _pack(np.array([c for s in segments for c in s], np.uint16), np.concatenate(widths))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of given widths, low bits first."""
    parts = []
    for i in range(0, len(codes), 1 << 16):  # bounded memory; whole bytes are carried over as bits
        bits = (codes[i : i + (1 << 16), None] >> np.arange(12, dtype=np.uint16)) & 1
        parts.append(bits.astype(np.uint8)[np.arange(12) < widths[i : i + (1 << 16), None]])
    return np.packbits(np.concatenate(parts), bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, limit: int) -> bytes:
    """The first ``limit`` samples of a code stream; GifError if a code can't be."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.uint32)
    total, at, got = 8 * len(stream), 0, 0
    out: list[bytes] = []
    segment: list[np.ndarray] = []
    index = 0
    while got < limit and at < total:  # the codes up to the next clear code, as many at a time as a table has
        widths = _widths(index + MAX_CODES, size)[index:]
        starts = at + np.concatenate([[0], np.cumsum(widths)])
        usable = int(np.searchsorted(starts[1:], total, side="right"))
        begin = starts[:usable]
        byte = begin >> 3
        words = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
        codes = (words >> (begin & 7).astype(np.uint32)).astype(np.int64) & ((1 << widths[:usable]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else usable
        segment.append(codes[:n])
        index += n
        over = not usable or (len(stop) > 0 and codes[n] == end)
        if over or len(stop):
            out.append(_strings(np.concatenate(segment), size))
            got += len(out[-1])
            segment, index = [], 0
        if over:
            break
        at = int(starts[n + bool(len(stop))])
    if segment:
        out.append(_strings(np.concatenate(segment), size))
    return b"".join(out)[:limit]


def _strings(codes: np.ndarray, size: int) -> bytes:
    """What the codes between two clear codes stand for.

    The entry that code i makes is what code i itself wrote and one sample more, so every code points to earlier
    output. Pointers are followed by doubling, first for the codes' lengths, then for the samples.
    """
    if not len(codes):
        return b""
    literals = 1 << size
    parent = codes - literals - 2
    if (parent >= np.arange(len(codes))).any():
        raise GifError("a code is not in the table")
    at_root = parent < 0
    steps = np.where(at_root, 0, 1)
    up = np.where(at_root, np.arange(len(codes)), parent)
    while True:
        following = up[up]
        if np.array_equal(following, up):
            break
        steps, up = steps + steps[up], following
    lengths = steps + 1
    starts = np.cumsum(lengths) - lengths
    source = np.arange(int(lengths.sum()))
    shift = np.where(at_root, 0, starts - starts[np.maximum(parent, 0)])
    source -= np.repeat(shift, lengths)
    while True:
        following = source[source]
        if np.array_equal(following, source):
            break
        source = following
    samples = np.zeros(len(source), np.uint8)
    samples[starts[at_root]] = codes[at_root]
    return samples[source].tobytes()


# The container -------------------------------------------------------------------


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    return bytes(out) + b"\0"


def write_gif(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a whose global palette is the first frame's; the other frames carry their own where it differs."""
    shared = frames[0].palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | (_bits(shared) - 1), 0, 0), _padded(shared)]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0")
        rows, cols = f.samples.shape
        local = not np.array_equal(f.palette, shared)
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, cols, rows, 0x80 | (_bits(f.palette) - 1) if local else 0))
        if local:
            out.append(_padded(f.palette))
        size = max(2, _bits(f.palette))
        out += [bytes([size]), _blocks(lzw_encode(f.samples.tobytes(), size))]
    return b"".join(out) + b"\x3b"


def _bits(palette: np.ndarray) -> int:
    return max(1, (len(palette) - 1).bit_length())


def _padded(palette: np.ndarray) -> bytes:
    return palette.astype(np.uint8).tobytes().ljust(3 << _bits(palette), b"\0")


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width and height of the canvas, and the frames as stored. GifError for what is no GIF or breaks off."""
    try:
        return _read(data)
    except (struct.error, IndexError) as e:
        raise GifError("the data break off") from e


def _read(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("no GIF header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise GifError(f"a canvas of {width} x {height}")
    at, shared, frames = 13, None, []
    if flags & 0x80:
        shared, at = _palette(data, at, flags)
    control = (0, 0, None)
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return width, height, frames
        if kind == 0x21:
            label = data[at]
            body, at = _joined(data, at + 1)
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                control = (delay, bits >> 2 & 7, index if bits & 1 else None)
        elif kind == 0x2C:
            left, top, cols, rows, bits = struct.unpack_from("<HHHHB", data, at)
            at += 9
            if rows * cols > MOST_PIXELS:
                raise GifError(f"a frame of {cols} x {rows}")
            palette = shared
            if bits & 0x80:
                palette, at = _palette(data, at, bits)
            if palette is None:
                palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
            size = data[at]
            if not 2 <= size <= 8:
                raise GifError(f"minimum code size {size}")
            body, at = _joined(data, at + 1)
            samples = np.frombuffer(lzw_decode(body, size, rows * cols), np.uint8)
            if len(samples) < rows * cols:
                raise GifError("a frame lacks samples")
            samples = samples.reshape(rows, cols)
            if bits & 0x40:
                order = np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                laid = np.empty_like(samples)
                laid[order] = samples
                samples = laid
            frames.append(Frame(left, top, samples, palette, *control))
            control = (0, 0, None)
        else:
            raise GifError(f"unknown block {kind}")


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 * (2 << (flags & 7))
    if len(data) < at + n:
        raise GifError("the data break off")
    return np.frombuffer(data, np.uint8, n, at).reshape(-1, 3), at + n


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def shown(width: int, height: int, frames: list[Frame]) -> Iterator[tuple[int, np.ndarray]]:
    """(delay, RGBA canvas) as each frame is on show: transparent samples leave what lies below; a frame's
    disposal then keeps it (0, 1), clears its place (2) or brings back what stood before it (3)."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        rows, cols = max(0, min(f.samples.shape[0], height - f.top)), max(0, min(f.samples.shape[1], width - f.left))
        place = canvas[f.top : f.top + rows, f.left : f.left + cols]
        samples = f.samples[:rows, :cols]
        palette = np.zeros((256, 4), np.uint8)
        palette[: len(f.palette), :3] = f.palette
        palette[:, 3] = 255
        seen = samples != f.transparent if f.transparent is not None else np.ones(samples.shape, bool)
        place[seen] = palette[samples[seen]]
        yield f.delay, canvas.copy()
        if f.disposal == 2:
            place[:] = 0
        elif before is not None:
            canvas = before


def histogram(canvas: np.ndarray) -> list[int]:
    """Opaque pixels by 2 bits each of red, green and blue (64 counts), and the number of clear ones."""
    rgb = (canvas[..., :3] >> 6).astype(np.int64)
    bins = rgb[..., 0] << 4 | rgb[..., 1] << 2 | rgb[..., 2]
    bins[canvas[..., 3] == 0] = 64
    return np.bincount(bins.ravel(), minlength=65).tolist()


FRAMES = pa.list_(pa.struct([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("histogram", pa.list_(pa.int64()))]))
FRAMES_SCHEMA = "array<struct<frame: int, start_cs: bigint, delay_cs: int, histogram: array<bigint>>>"


def timed_frames(width: int, height: int, frames: list[Frame]) -> list[dict[str, object]]:
    """frame, start_cs, delay_cs (hundredths of a second) and histogram of each frame as it is on show."""
    out: list[dict[str, object]] = []
    start = 0
    for k, (delay, canvas) in enumerate(shown(width, height, frames)):
        out.append({"frame": k, "start_cs": start, "delay_cs": delay, "histogram": histogram(canvas)})
        start += delay
    return out


def gif_frames(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Timed frames of a binary column: id, frame, start_cs, delay_cs (hundredths of a second), histogram, error.

    Null, empty or unreadable media, and those of more than MOST_PIXELS, give one row with frame -1 and the reason in
    ``error``; a GIF without frames gives none. Repeated rows give repeated frames; other columns are ignored; an
    empty table gives an empty one.
    """
    source = only(media, id_col, media_col)
    names = ("frame", "start_cs", "delay_cs", "histogram", "error")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    rows = timed_frames(*read_gif(batch.column(1)[i].as_py() or b""))
                except GifError as e:
                    rows = [{"frame": -1, "start_cs": 0, "delay_cs": 0, "histogram": [], "error": str(e)}]
                if rows:
                    ids = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]], names=[id_col, *names])

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, frame int, start_cs long, delay_cs int, histogram array<long>, error string")


# Payloads ------------------------------------------------------------------------

GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
#: Sample i as a colour: three bits of red, three of green, two of blue.
COLOURS = np.stack([(np.arange(256) >> 5) * 255 // 7, (np.arange(256) >> 2 & 7) * 255 // 7, (np.arange(256) & 3) * 85], axis=1).astype(np.uint8)


def store_payload(payload: bytes) -> bytes:
    """A payload of whole rows as a GIF: sample i has colour i; each frame is cleared before the next."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Frame(0, 0, rows[i : i + FRAME_ROWS], COLOURS, DELAY, disposal=2) for i in range(0, len(rows), FRAME_ROWS)]
    return write_gif(frames, WIDTH, min(len(rows), FRAME_ROWS))


def _feature(frames: list[dict[str, object]]) -> str:
    """Frames, their time, and opaque pixels by 64 colours over all of them."""
    counts = np.sum([f["histogram"] for f in frames], axis=0)[:64]
    return f"frames={len(frames)};cs={sum(f['delay_cs'] for f in frames)};rgb64=" + ",".join(map(str, counts.tolist()))


def payload_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and frames of every
    row; with ``keep_media`` also the GIF as ``media``. ``frames`` lists frame, start_cs, delay_cs and the histogram of
    its 64 colours and clear pixels.

    A null text is the empty one, whose payload is 64 bytes 0; a very long one runs over several frames; equal texts
    give equal values; null ids are kept; repeated rows give repeated results; other columns are ignored; an empty
    table gives an empty one. One scan and one map, no shuffle.
    """

    def work(texts: list[str]) -> dict[str, pa.Array]:
        rows = []
        for text in texts:
            raw = text.encode("utf-8")
            media = store_payload(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0"))
            width, height, frames = read_gif(media)
            back = b"".join(f.samples.tobytes() for f in frames)
            timed = timed_frames(width, height, frames)
            rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), _feature(timed), timed, media if keep_media else None))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "media")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), FRAMES, pa.binary())
        made = {n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*rows, strict=True), strict=True)}
        return made if keep_media else {n: v for n, v in made.items() if n != "media"}

    schema = f"n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames {FRAMES_SCHEMA}"
    return map_texts(docs, id_col, text_col, work, schema + ", media binary" * keep_media)


def payload_text(media: DataFrame, id_col: str, media_col: str, length_col: str) -> DataFrame:
    """The texts back from stored payloads: id and text (null where the media is null)."""
    source = only(media, id_col, media_col, length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for data, n in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                stored = data.as_py()
                texts.append(None if stored is None else b"".join(f.samples.tobytes() for f in read_gif(stored)[2])[: n or 0].decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, text string")
