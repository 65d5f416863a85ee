"""GIF columns: any bytes stored as timed 8-bit frames and read back, with colour histograms.

``encode`` writes a GIF89a file of grey-palette frames whose pixels are the payload's bytes;
``decode`` reads any GIF: variable-width LZW code streams (with clear codes, full tables and the
deferred clear), global and local palettes, interlacing, disposal and transparency.
A code's width depends only on its place after the last clear code, so whole runs of codes are
unpacked from the bit stream, and packed into it, with array arithmetic; only the growth of the
string table is a loop.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, texts

FULL = 4096
FRAME = "struct<left:int, top:int, width:int, height:int, delay_ms:int, disposal:int, transparent:int, histogram:array<bigint>>"


class Frame(NamedTuple):
    """One image of a file: where it lies, how long it stays, its samples and the canvas once it is drawn."""

    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int
    samples: np.ndarray
    canvas: np.ndarray


def widths(bits: int, n: int) -> np.ndarray:
    """The widths of the first n codes after a clear code, for samples of so many bits."""
    ceiling = (1 << bits) + 1 + np.arange(n, dtype=np.int64)
    return np.clip(np.ceil(np.log2(ceiling + 1)).astype(np.int64), bits + 1, 12)


def compress(samples: bytes, bits: int = 8) -> bytes:
    """The LZW stream of samples, without its sub-blocks."""
    clear = 1 << bits
    runs, codes, known, free = [], [], {}, clear + 2
    prefix = -1
    for sample in samples:
        if prefix < 0:
            prefix = sample
            continue
        key = prefix << 8 | sample
        longer = known.get(key)
        if longer is not None:
            prefix = longer
            continue
        codes.append(prefix)
        prefix = sample
        if free < FULL:
            known[key] = free
            free += 1
        else:
            codes.append(clear)
            runs.append(codes)
            codes, known, free = [], {}, clear + 2
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    runs.append(codes)
    values = np.array([clear, *(c for run in runs for c in run)], np.int64)
    sizes = np.concatenate([[bits + 1], *(widths(bits, len(run)) for run in runs)])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    shifted, byte, total = values << (starts & 7), starts >> 3, int(ends[-1] + 7) >> 3
    packed = sum(np.bincount(byte + k, weights=(shifted >> 8 * k) & 255, minlength=total + 3) for k in range(3))
    return packed[:total].astype(np.uint8).tobytes()


def expand(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of an LZW stream, ``most`` at most; a stream that breaks off or holds a bad code gives what came before."""
    clear, data = 1 << bits, np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    sizes, single = widths(bits, FULL), [bytes([i]) for i in range(clear)] + [b"", b""]
    at, place, end, out, got = 0, 0, 8 * len(stream), [], 0
    table, previous = single.copy(), b""
    while got < most:
        size = sizes[place:] if place < FULL else np.full(FULL, 12, np.int64)
        starts = at + np.cumsum(size) - size
        size = size[starts + size <= end]
        if not len(size):
            break
        starts = starts[: len(size)]
        byte = starts >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (starts & 7) & (1 << size) - 1
        special = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(special[0]) if len(special) else len(codes)
        for code in codes[:n].tolist():
            if code < len(table):
                entry = table[code]
            elif previous and code == len(table) < FULL:
                entry = previous + previous[:1]
            else:
                return b"".join(out)[:most]
            out.append(entry)
            got += len(entry)
            if previous and len(table) < FULL:
                table.append(previous + entry[:1])
            previous = entry
        if n == len(codes):
            at, place = int(starts[-1] + size[-1]), place + n
            continue
        if codes[n] == clear + 1:
            break
        at, place, table, previous = int(starts[n] + size[n]), 0, single.copy(), b""
    return b"".join(out)[:most]


def encode(payload: bytes, width: int = 64, rows: int = 1024, delay_ms: int = 40) -> bytes:
    """A GIF89a file of payload, whose length is a positive multiple of width: grey palette, frames of at most so many rows.

    Every frame but the last fills the canvas and is restored to the background before the next.
    """
    size = width * rows
    frames = [payload[i : i + size] for i in range(0, len(payload), size)]
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    out = [b"GIF89a", struct.pack("<HHBBB", width, len(frames[0]) // width, 0xF7, 0, 0), grey]
    for frame in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, delay_ms // 10, 0, 0))
        out.append(struct.pack("<BHHHHBB", 0x2C, 0, 0, width, len(frame) // width, 0, 8))
        stream = compress(frame)
        full = len(stream) // 255
        blocks = np.empty((full, 256), np.uint8)
        blocks[:, 0] = 255
        blocks[:, 1:] = np.frombuffer(stream[: 255 * full], np.uint8).reshape(full, 255)
        rest = stream[255 * full :]
        out += [blocks.tobytes(), bytes([len(rest)]) + rest if rest else b"", b"\0"]
    return b"".join([*out, b";"])


def decode(media: bytes) -> list[Frame]:
    """The frames of a GIF file, each with the canvas as shown while it stays.

    What is not a GIF file, or ends within its header, raises ValueError. A file that breaks off later gives the frames before, and the
    one it breaks off in with samples of 0 for what is missing. A frame without any palette shows grey levels.
    """
    if media[:3] != b"GIF" or len(media) < 13:
        raise ValueError("not a GIF file")
    frames: list[Frame] = []
    try:
        _read(media, frames)
    except _Ended:
        pass
    return frames


class _Ended(Exception):
    """The file broke off."""


def _read(media: bytes, frames: list[Frame]) -> None:
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", media, 6)
    at, shared = 13, None
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(-1, 3)

    def need(n: int) -> None:
        if at + n > len(media):
            raise _Ended

    def palette(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << (flags & 7) + 1
        need(n)
        found = np.frombuffer(media, np.uint8, n, at).reshape(-1, 3)
        at += n
        return found

    def blocks() -> bytes:
        nonlocal at
        found = []
        while at < len(media) and (n := media[at]):
            found.append(media[at + 1 : at + 1 + n])
            at += n + 1
        at += 1
        return b"".join(found)

    if flags & 0x80:
        shared = palette(flags)
    ground = shared[background] if shared is not None and background < len(shared) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    delay, disposal, transparent = 0, 0, -1
    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            need(2)
            label, at = media[at + 1], at + 2
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                control, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = control >> 2 & 7, index if control & 1 else -1
            continue
        if media[at] != 0x2C:  # nothing that the format knows: go on at the next byte
            at += 1
            continue
        need(11)
        left, top, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
        at += 10
        colours = palette(flags) if flags & 0x80 else grey if shared is None else shared
        need(1)
        bits, at = min(max(media[at], 1), 8), at + 1
        samples = np.zeros(w * h, np.uint8)
        got = np.frombuffer(expand(blocks(), bits, w * h), np.uint8)
        samples[: len(got)] = got
        samples = samples.reshape(h, w)
        if flags & 0x40:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = samples[: area.shape[0], : area.shape[1]]
        drawn = colours[np.minimum(seen, len(colours) - 1)]
        if transparent >= 0:
            area[:] = np.where((seen == transparent)[..., None], area, drawn)
        else:
            area[:] = drawn
        frames.append(Frame(left, top, 10 * delay, disposal, transparent, samples, canvas.copy()))
        if disposal == 2:
            area[:] = ground
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, -1


def histogram(canvas: np.ndarray, levels: int = 4) -> list[int]:
    """Pixels by colour, with so many levels (a power of two) for each of red, green and blue."""
    shift = 8 - (levels.bit_length() - 1)
    bins = canvas.reshape(-1, 3) >> shift
    index = (bins[:, 0].astype(np.int64) * levels + bins[:, 1]) * levels + bins[:, 2]
    return np.bincount(index, minlength=levels**3).tolist()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, rows: int = 1024) -> DataFrame:
    """doc_id, n_bytes, media (the GIF file), payload (its samples, read back), frames (timed, with colour histograms).

    The payload is the text's UTF-8 bytes with zero bytes up to a positive multiple of ``width``; a null
    or empty text gives one row of zeros. Texts longer than a frame go on in further frames. Equal texts give equal
    values, also in repeated rows; an empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(one, batches(parts, 1 << 20))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, files, payloads, shown = [], [], [], []
        for text in batch.column("text"):
            raw = text.as_py().encode()
            payload = raw + bytes(max(width, -(-len(raw) // width) * width) - len(raw))
            files.append(encode(payload, width, rows))
            frames = decode(files[-1])
            payloads.append(b"".join(f.samples.tobytes() for f in frames))
            sizes.append(len(raw))
            shown.append([{"left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "delay_ms": f.delay_ms, "disposal": f.disposal, "transparent": f.transparent, "histogram": histogram(f.canvas)} for f in frames])
        kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("left", "top", "width", "height", "delay_ms", "disposal", "transparent")), ("histogram", pa.list_(pa.int64()))]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary()), pa.array(payloads, pa.binary()), pa.array(shown, kind)], names=["doc_id", "n_bytes", "media", "payload", "frames"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, frames array<{FRAME}>")


def digests(media: DataFrame) -> DataFrame:
    """The columns of media_columns as sizes, digests and one feature string: frames, milliseconds, and pixels by colour over all frames."""
    total = F.aggregate("frames", F.array_repeat(F.lit(0).cast("long"), 64), lambda sums, f: F.zip_with(sums, f["histogram"], lambda a, b: a + b))
    used = F.filter(F.transform(total, lambda n, i: F.concat_ws(":", i.cast("string"), n.cast("string"))), lambda s: ~s.endswith(":0"))
    millis = F.aggregate("frames", F.lit(0), lambda n, f: n + f["delay_ms"])
    return media.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64)")).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.size("frames").cast("string"), millis.cast("string"), F.array_join(used, ",")).alias("feature"))
