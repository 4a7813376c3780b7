"""GIF media columns (operator 4): an encoder, a decoder, and frames with colour histograms.

The decoder reads GIF87a/89a: sub-blocks, LZW code streams of any code width, global and
local palettes, interlacing, transparency and the disposal rules; it gives timed frames
as they appear on the canvas.  The encoder stores samples as colour numbers of a grey
palette, in LZW streams with a table and codes that widen.

Encoding: the streams of many frames are coded in step, sample by sample; each has its own
hash table of (code, sample).  Frames are so small that no table fills up.  Decoding: between
two clear codes the width of a code follows from its place, so all codes are read at once.
The table's entry that the code of place j made is that code's samples and the one after
them, which lie side by side in the output; so each output sample points to an earlier one
or is a literal, and the pointers are followed for all samples together.

Defined results: null media have no frames; media that are cut off, not GIF, or larger than
``CANVAS`` samples give an ``error`` text instead of frames; empty samples are one frame of
zeros; repeated rows are stored and read each; long samples become many frames; an empty
table gives no rows; other columns stay, but for those named as the new ones.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.cluster import map_arrow

WIDTH = 64
#: Rows of a frame; longer samples become several frames.  A stream of so many samples has fewer codes than the table has places.
ROWS = 56
#: Samples of a canvas or frame that is read at most; frames that are coded in step.
CANVAS = 1 << 26
LANES = 512
DELAY = 10
GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
BINS = 8


@dataclass
class Frame:
    """A frame: its box, time in hundredths of a second, disposal, transparent colour or None, colour numbers, palette."""

    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    pixels: np.ndarray
    palette: np.ndarray


def widths(n: int, least: int) -> np.ndarray:
    """Bits of each of n codes after a clear code; at its turn, each code but the first two finds one more entry than the one before."""
    size = np.maximum(np.arange(n) - 1, 0) + (1 << least) + 2
    return np.clip(np.ceil(np.log2(size + 1)).astype(np.int64), least + 1, 12)


def codes_of(streams: list[np.ndarray]) -> list[np.ndarray]:
    """The LZW codes of streams of 8-bit samples, without clear and stop codes; none is longer than ROWS * WIDTH."""
    out: list = [None] * len(streams)
    order = sorted(range(len(streams)), key=lambda k: -len(streams[k]))
    for begin in range(0, len(order), LANES):
        lanes = order[begin : begin + LANES]
        lengths = np.array([len(streams[k]) for k in lanes])
        longest = int(lengths[0])
        samples = np.zeros((longest, len(lanes)), np.uint32)
        for j, k in enumerate(lanes):
            samples[: lengths[j], j] = streams[k]
        room = 1 << max(4, (2 * longest - 1).bit_length())
        shift = np.uint32(33 - room.bit_length())
        # entries are 12 bits of code, 8 of the sample, 12 of the new code; 0 is free
        table = np.zeros(len(lanes) * room, np.uint32)
        base = np.arange(len(lanes), dtype=np.int64) * room
        found = np.zeros((longest + 1, len(lanes)), np.uint16)
        made = np.zeros(len(lanes), np.int64)
        now = samples[0].copy()
        alive = np.searchsorted(-lengths, -np.arange(longest), "left")
        for t in range(1, longest):
            n = int(alive[t])
            key = now[:n] << np.uint32(8) | samples[t, :n]
            at = base[:n] + (key * np.uint32(2654435769) >> shift)
            entry = table[at]
            other = np.flatnonzero((entry != 0) & (entry >> np.uint32(12) != key))
            while len(other):
                at[other] = base[other] + ((at[other] + 1) & (room - 1))
                entry[other] = got = table[at[other]]
                other = other[(got != 0) & (got >> np.uint32(12) != key[other])]
            new = np.flatnonzero(entry == 0)
            place = made[new]
            found[place, new] = now[new]
            table[at[new]] = key[new] << np.uint32(12) | (place + 258).astype(np.uint32)
            made[new] = place + 1
            now[:n] = entry & np.uint32(4095)
            now[new] = samples[t, new]
        found[made, np.arange(len(lanes))] = now
        for j, k in enumerate(lanes):
            out[k] = found[: made[j] + 1, j]
    return out


def packed(codes: np.ndarray) -> bytes:
    """The stream of a clear code, codes of 8-bit samples and the stop code."""
    every = np.concatenate([[256], codes, [257]]).astype(np.uint16)
    bits = np.append(9, widths(len(codes) + 1, 8))
    all_bits = np.unpackbits(every.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(all_bits[np.arange(12) < bits[:, None]], bitorder="little").tobytes()


def sub_blocks(data: bytes) -> bytes:
    n = len(data) // 255
    head = np.empty((n, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, n * 255).reshape(n, 255)
    rest = data[n * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a file; frames whose palette is the first one's use the global palette."""
    return encode_all([(frames, width, height)])[0]


def encode_all(files: list[tuple[list[Frame], int, int]]) -> list[bytes]:
    """GIF89a files; larger frames are cut into streams that the table holds, with a clear code before each."""
    pieces = [[[p.ravel()[k : k + ROWS * WIDTH] for k in range(0, p.size, ROWS * WIDTH)] for p in (f.pixels for f in frames)] for frames, _, _ in files]
    codes = iter(codes_of([piece for file in pieces for frame in file for piece in frame]))
    return [_file(frames, width, height, [[next(codes) for _ in frame] for frame in file]) for (frames, width, height), file in zip(files, pieces, strict=True)]


def _file(frames: list[Frame], width: int, height: int, codes: list[list[np.ndarray]]) -> bytes:
    first = frames[0].palette
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), first.tobytes()]
    for f, streams in zip(frames, codes, strict=True):
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, f.delay, f.transparent or 0) + b"\0")
        own = f.palette is not first and not np.array_equal(f.palette, first)
        h, w = f.pixels.shape
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, w, h, 0x87 if own else 0) + (f.palette.tobytes() if own else b"") + b"\x08")
        out.append(sub_blocks(packed(streams[0]) if len(streams) == 1 else _cleared(streams)))
    return b"".join(out) + b"\x3b"


def _cleared(streams: list[np.ndarray]) -> bytes:
    """One stream of several, each after a clear code of the width that the one before has come to."""
    bits, every = [np.array([9])], [np.array([256])]
    for codes in streams:
        bits.append(widths(len(codes) + 1, 8))
        every += [codes, np.array([256])]
    every[-1] = np.array([257])
    every, bits = np.concatenate(every).astype(np.uint16), np.concatenate(bits)
    all_bits = np.unpackbits(every.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(all_bits[np.arange(12) < bits[:, None]], bitorder="little").tobytes()


def of_samples(many: list[bytes]) -> list[bytes]:
    """The GIFs of bytes, whose number is a positive multiple of WIDTH."""
    files = []
    for data in many:
        pixels = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
        files.append(([Frame(0, 0, DELAY, 1, None, pixels[k : k + ROWS], GREY) for k in range(0, len(pixels), ROWS)], WIDTH, min(len(pixels), ROWS)))
    return encode_all(files)


def _codes(bits: np.ndarray, at: int, least: int) -> tuple[np.ndarray, int | None, bool]:
    """The codes from a bit on up to a clear or stop code; the bit after that, or None where the data end first; whether it was a clear code.

    Reads a block of codes at a time, as many as a full table, then twice as many each time."""
    clear, found, begin, block = 1 << least, [], 0, 4096
    while True:
        width = widths(begin + block, least)[begin:]
        ends = at + np.cumsum(width)
        fits = int(np.searchsorted(ends, len(bits), "right"))
        place = (ends - width)[:fits, None] + np.arange(12)
        codes = (bits[np.minimum(place, len(bits) - 1)].astype(np.int64) * (np.arange(12) < width[:fits, None])) @ (1 << np.arange(12)) if fits else np.empty(0, np.int64)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(marks):
            return np.concatenate([*found, codes[: marks[0]]]), int(ends[marks[0]]), bool(codes[marks[0]] == clear)
        found.append(codes)
        if fits < block:
            return np.concatenate(found), None, False
        begin, at, block = begin + block, int(ends[-1]), 2 * block


def _samples(codes: np.ndarray, least: int) -> np.ndarray:
    """The samples of codes between two clear codes."""
    n, literal = len(codes), codes < 1 << least
    entry = np.where(literal, np.arange(n), codes - (1 << least) - 2)
    if (entry > np.where(literal, n, np.arange(n) - 1)).any():
        raise ValueError("bad code")
    # a code's length is one more than that of the code that made its entry
    length, back = np.where(literal, 0, 1), entry.copy()
    while not literal[back].all():
        length, back = length + length[back], back[back]
    length += 1
    start = np.cumsum(length) - length
    total = int(length.sum())
    if total > CANVAS + 4096:
        raise ValueError("image data too long")
    code = np.repeat(np.arange(n), length)
    source = np.arange(total) - (start - start[entry])[code]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    out = np.zeros(total, np.uint8)
    out[start[literal]] = codes[literal]
    return out[source]


def lzw(data: bytes, least: int, size: int) -> np.ndarray:
    """The first ``size`` samples of an LZW code stream."""
    if not 1 <= least <= 8:
        raise ValueError("bad code size")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    out, total, at, more = [], 0, 0, True
    while more and at is not None and total < size and at < len(bits):
        codes, at, more = _codes(bits, at, least)
        if len(codes):
            out.append(_samples(codes, least))
            total += len(out[-1])
    if total < size:
        raise ValueError("image data end early")
    return np.concatenate([np.empty(0, np.uint8), *out])[:size]


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> bytes:
        out = []
        while n := self.take(1)[0]:
            out.append(self.take(n))
        return b"".join(out)

    def palette(self, flags: int) -> np.ndarray:
        n = 2 << (flags & 7)
        return np.frombuffer(self.take(3 * n), np.uint8).reshape(n, 3)


def parse(data: bytes) -> tuple[int, int, list[Frame]]:
    """Canvas width and height, and the frames as stored."""
    r = Reader(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    if width * height > CANVAS:
        raise ValueError("canvas too large")
    common = r.palette(flags) if flags & 0x80 else GREY
    frames, delay, disposal, transparent = [], 0, 0, None
    while (kind := r.take(1)) != b"\x3b":
        if kind == b"\x21":
            label, body = r.take(1), r.blocks()
            if label == b"\xf9":
                f, delay, colour = struct.unpack("<BHB", body[:4])
                disposal, transparent = f >> 2 & 7, colour if f & 1 else None
        elif kind == b"\x2c":
            left, top, w, h, f = struct.unpack("<HHHHB", r.take(9))
            palette = r.palette(f) if f & 0x80 else common
            least = r.take(1)[0]
            if w * h > CANVAS:
                raise ValueError("frame too large")
            pixels = lzw(r.blocks(), least, w * h).reshape(h, w)
            if f & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                woven = np.empty_like(pixels)
                woven[order] = pixels
                pixels = woven
            frames.append(Frame(left, top, delay, disposal, transparent, pixels, palette))
            delay, disposal, transparent = 0, 0, None
        else:
            raise ValueError("bad block")
    return width, height, frames


def shown(width: int, height: int, frames: list[Frame]):
    """For each frame the canvas (height, width, red-green-blue), as it is shown; what nothing covers is black."""
    canvas = np.zeros((height, width, 3), np.uint8)
    for f in frames:
        h, w = f.pixels.shape
        box = np.s_[f.top : f.top + h, f.left : f.left + w]
        before = canvas[box].copy() if f.disposal == 3 else None
        part = canvas[box]
        pixels = f.pixels[: part.shape[0], : part.shape[1]]
        colours = f.palette[np.minimum(pixels, len(f.palette) - 1)]
        part[...] = colours if f.transparent is None else np.where((pixels == f.transparent)[..., None], part, colours)
        yield canvas
        if f.disposal == 2:
            canvas[box] = 0
        elif f.disposal == 3:
            canvas[box] = before


def histogram(pixels: np.ndarray) -> np.ndarray:
    """Counts of each channel's BINS equal parts, red first."""
    part = (pixels.reshape(-1, 3) // (256 // BINS)).astype(np.int64)
    return np.concatenate([np.bincount(part[:, c], minlength=BINS) for c in range(3)])


FRAMES = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("left", "top", "width", "height", "delay", "start", "disposal")]
        + [T.StructField("histogram", T.ArrayType(T.LongType()))]
    )
)


def store(rows: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds the GIF of a binary column: zeros are appended up to a positive multiple of WIDTH; null is empty."""
    names = [c for c in rows.columns if c != out]
    rows = rows.select(*names)
    at = names.index(payload)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        media = of_samples([(d or b"") + bytes(-len(d or b"") % WIDTH or (0 if d else WIDTH)) for d in batch.column(at).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(media, pa.binary())], names=[*names, out])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(out, T.BinaryType())]), rows=2048)


def read(rows: DataFrame, media: str = "media") -> DataFrame:
    """Adds frames (boxes, times, histograms of what is shown), samples (each frame's shown red channel within its box, joined) and error."""
    names = [c for c in rows.columns if c not in ("frames", "samples", "error")]
    rows = rows.select(*names)
    at = names.index(media)

    def one(data: bytes | None) -> tuple[list | None, bytes | None, str | None]:
        if data is None:
            return None, None, None
        try:
            width, height, stored = parse(data)
            frames, samples, start = [], [], 0
            for f, canvas in zip(stored, shown(width, height, stored), strict=True):
                h, w = f.pixels.shape
                part = canvas[f.top : f.top + h, f.left : f.left + w]
                frames.append({"left": f.left, "top": f.top, "width": w, "height": h, "delay": f.delay, "start": start, "disposal": f.disposal, "histogram": histogram(part).tolist()})
                samples.append(part[..., 0].tobytes())
                start += f.delay
            return frames, b"".join(samples), None
        except (ValueError, struct.error, MemoryError) as e:
            return None, None, str(e) or "too large"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [one(d) for d in batch.column(at).to_pylist()]
        kinds = (pa.list_(pa.struct([*((n, pa.int32()) for n in ("left", "top", "width", "height", "delay", "start", "disposal")), ("histogram", pa.list_(pa.int64()))])), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], names=[*names, "frames", "samples", "error"])

    fields = [*rows.schema.fields, T.StructField("frames", FRAMES), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType())]
    return map_arrow(rows, run, T.StructType(fields), rows=256)


def document_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text's UTF-8 bytes as a GIF, reads it back, and gives digests of both and the summed colour histogram."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = read(store(docs.select(F.col(key), body.alias("body")), "body").select(key, F.octet_length("body").cast("long").alias("n_bytes"), "media"))
    red = F.transform("frames", lambda f: F.slice(f["histogram"], 1, BINS))
    total = F.aggregate(red, F.array_repeat(F.lit(0).cast("long"), BINS), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return rows.select(
        key, "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -WIDTH, WIDTH)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(",", F.transform(total, lambda n: n.cast("string"))).alias("feature"), F.size("frames").cast("long").alias("n_frames"), "error",
    )
