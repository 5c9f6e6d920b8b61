"""Media columns: GIF files as binary columns, decoded to timed frames with colour histograms.

``decode_gif`` reads the container (logical screen, global and local palettes, graphic control, interlacing), expands the
LZW code streams, and composes frames under the disposal and transparency rules. ``encode_payload`` stores any byte
string as the palette indices of an animation, so that a text column can be turned into media without loss.

Edge cases: a null text is an empty one; an empty text is one block of padding; a null, truncated or foreign media value
decodes to a row with zero frames and a non-null ``error``. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc, id_and_text, read_table, record

BLOCK = 576
#: Frames of 576 x 64 pixels: the dictionary starts anew with each, and a frame stays small.
FRAME_ROWS = 64
DELAY_CS = 4
_CLEAR, _END = 256, 257


def _widths(size: int, n: int) -> np.ndarray:
    """Bits of the n codes that follow a clear code: the decoder's table grows by one entry a code, from the second on."""
    known = (1 << size) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.maximum(size + 1, np.ceil(np.log2(known + 1)).astype(np.int64)))


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _SCHEDULES.get(size)
    if found is None or len(found[0]) < n:
        w = _widths(size, max(n, 8192))
        found = _SCHEDULES[size] = w, np.concatenate([[0], np.cumsum(w)])
    return found[0][:n], found[1][: n + 1]


def lzw_encode(data: bytes) -> bytes:
    """Code stream of 8-bit samples: a clear code first, and again when the table is full."""
    runs: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    new = 258
    prefix = -1
    get = table.get
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        key = prefix << 8 | c
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = new
        new += 1
        prefix = c
        if new == 4096:
            codes.append(_CLEAR)
            runs.append(codes)
            codes, new = [], 258
            table.clear()
    if prefix >= 0:
        codes.append(prefix)
    codes.append(_END)
    runs.append(codes)
    values = np.concatenate([np.array([_CLEAR]), *(np.array(r) for r in runs)])
    widths = np.concatenate([np.array([9]), *(_schedule(8, len(r))[0] for r in runs)])
    at = np.cumsum(widths) - widths
    total = int(at[-1] + widths[-1] + 7) // 8
    spread = values << (at & 7)
    byte = at >> 3
    out = np.zeros(total + 3)
    for k in range(3):
        out += np.bincount(byte + k, weights=(spread >> (8 * k)) & 255, minlength=total + 3)
    return out[:total].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int) -> bytes:
    """Samples of a GIF code stream with the given minimum code size. Stops at the end code or the end of the data."""
    clear, end = 1 << size, (1 << size) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    bits, at = len(stream) * 8, 0
    out: list[bytes] = []
    while at + size + 1 <= bits:
        # codes up to the next clear or end code; the widths depend only on how many came before
        codes: list[int] = []
        stop, n = None, 4096
        while stop is None:
            w, cum = _schedule(size, n)
            pos = at + cum[len(codes) : n]
            w = w[len(codes) :]
            fits = int(np.searchsorted(pos + w, bits, side="right"))
            pos, w = pos[:fits], w[:fits]
            b = pos >> 3
            got = ((raw[b] | raw[b + 1] << 8 | raw[b + 2] << 16) >> (pos & 7)) & ((1 << w) - 1)
            special = np.flatnonzero((got == clear) | (got == end))
            if len(special):
                stop = int(got[special[0]])
                at = int(pos[special[0]] + w[special[0]])
                codes += got[: special[0]].tolist()
            else:
                codes += got.tolist()
                if fits < n - (len(codes) - fits):
                    stop = end
                n += 4096
        if codes:
            if codes[0] >= clear:
                raise ValueError("a code stream starts with an unknown code")
            table = base.copy()
            add, emit = table.append, out.append
            prev = table[codes[0]]
            emit(prev)
            known = clear + 2
            for c in codes[1:]:
                if c < known:
                    entry = table[c]
                elif c == known:
                    entry = prev + prev[:1]
                else:
                    raise ValueError("a code points beyond the table")
                if known < 4096:
                    add(prev + entry[:1])
                    known += 1
                emit(entry)
                prev = entry
        if stop == end:
            break
    return b"".join(out)


def encode_payload(payload: bytes, width: int = BLOCK, rows: int = FRAME_ROWS) -> bytes:
    """A GIF89a animation whose palette indices, frame by frame, are the payload; the palette is the grey ramp.

    The length must be a positive multiple of ``width``.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    step = width * rows
    height = min(rows, len(payload) // width)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey]
    for i in range(0, len(payload), step):
        frame = payload[i : i + step]
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_CS, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0) + b"\x08")
        code = lzw_encode(frame)
        for j in range(0, len(code), 255):
            block = code[j : j + 255]
            parts.append(bytes([len(block)]) + block)
        parts.append(b"\0")
    return b"".join([*parts, b"\x3b"])


@dataclass
class Frame:
    """One image of the animation: its own samples and place, and the screen after it was drawn (RGBA)."""

    indices: np.ndarray
    left: int
    top: int
    start_cs: int
    delay_cs: int
    disposal: int
    screen: np.ndarray


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> Iterator[Frame]:
    """Frames in order, one at a time. Raises ValueError or IndexError where the file is not a GIF or ends early."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = clock = 0
    transparent = None
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = shared
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
            at += n
        if palette is None:
            raise ValueError("an image without a palette")
        size = data[at]
        if not 1 <= size <= 11:
            raise ValueError("a code size out of range")
        stream, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, size), np.uint8)[: w * h]
        if len(flat) < w * h:
            raise ValueError("an image ends early")
        indices = flat.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            woven = np.empty_like(indices)
            woven[order] = indices
            indices = woven
        saved = canvas.copy() if disposal == 3 else None
        seen = indices[: max(0, height - top), : max(0, width - left)]
        drawn = palette[np.minimum(seen, len(palette) - 1)]
        region = canvas[top : top + seen.shape[0], left : left + seen.shape[1]]
        shows = seen != transparent if transparent is not None else np.ones(seen.shape, bool)
        region[shows] = np.concatenate([drawn, np.full((*seen.shape, 1), 255, np.uint8)], axis=2)[shows]
        yield Frame(indices, left, top, clock, delay, disposal, canvas)
        clock += delay
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = saved
        delay, disposal, transparent = 0, 0, None


def histogram(frame: Frame, bins: int = 8) -> list[int]:
    """Pixels of the drawn screen by luma, in equal bins; transparent pixels count nowhere."""
    rgba = frame.screen
    luma = (rgba[..., 0].astype(np.int64) * 299 + rgba[..., 1].astype(np.int64) * 587 + rgba[..., 2].astype(np.int64) * 114) // 1000
    return np.bincount((luma[rgba[..., 3] > 0] * bins) >> 8, minlength=bins).tolist()


_GIF = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("gif", pa.binary())])
_FRAME = pa.struct([("start_cs", pa.int64()), ("delay_cs", pa.int64()), ("left", pa.int64()), ("top", pa.int64()), ("width", pa.int64()), ("height", pa.int64()), ("histogram", pa.list_(pa.int64()))])
_DECODED = pa.schema([*_GIF, ("frames", pa.list_(_FRAME)), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("error", pa.string())])
_DECODED_DDL = "doc_id long, n_bytes long, gif binary, frames array<struct<start_cs: long, delay_cs: long, left: long, top: long, width: long, height: long, histogram: array<long>>>, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"


def text_to_gif(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, gif: each whole text, padded with bytes 255 to whole rows of 576, as an animation."""

    def encode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                raw = [t.encode() for t in part.column("text").to_pylist()]
                yield record({"doc_id": part.column("doc_id").to_pylist(), "n_bytes": [len(b) for b in raw], "gif": [encode_payload(b + b"\xff" * (-len(b) % BLOCK if b else BLOCK)) for b in raw]}, _GIF)

    return id_and_text(docs).mapInArrow(encode, "doc_id long, n_bytes long, gif binary")


def decode_column(media: DataFrame) -> DataFrame:
    """Adds to (doc_id, n_bytes, gif) the timed frames with their histograms, and digests of the samples read back."""

    def decode(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                rows = {k: part.column(k).to_pylist() for k in ("doc_id", "n_bytes", "gif")} | {f.name: [] for f in _DECODED if f.name not in ("doc_id", "n_bytes", "gif")}
                for data in rows["gif"]:
                    frames, sha, tail, size, error = [], hashlib.sha256(), b"", 0, None
                    try:
                        for f in decode_gif(data or b""):
                            samples = f.indices.tobytes()
                            sha.update(samples)
                            tail, size = (tail + samples)[-32:], size + len(samples)
                            frames.append({"start_cs": f.start_cs, "delay_cs": f.delay_cs, "left": f.left, "top": f.top, "width": f.indices.shape[1], "height": f.indices.shape[0], "histogram": histogram(f)})
                    except (ValueError, IndexError, struct.error) as e:
                        frames, sha, tail, size, error = [], hashlib.sha256(), b"", 0, str(e) or type(e).__name__
                    for k, v in (("frames", frames), ("payload_bytes", size), ("payload_sha256", sha.hexdigest()), ("tail_crc32", crc(tail)), ("error", error)):
                        rows[k].append(v)
                yield record(rows, _DECODED)

    return media.select("doc_id", "n_bytes", "gif").mapInArrow(decode, _DECODED_DDL)


def op7_gif_columns(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a GIF, read back, and described: the feature string holds frames, duration and summed luma histogram."""
    d = decode_column(text_to_gif(read_table(spark, sf_dir, "documents")))
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 8), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    return d.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        F.octet_length("gif").cast("long").alias("media_bytes"), F.sha2("gif", 256).alias("media_sha256"),
        F.concat_ws(";", F.size("frames").cast("string"), F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_cs"]).cast("string"), F.array_join(total.cast("array<string>"), ",")).alias("feature"),
    )
