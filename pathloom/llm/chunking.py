"""Substring dedup by content-defined chunks.

A gear hash of 32 bits rolls over the bytes of each text: shifted by one bit and added to at each byte, its value
depends on the last 32. A chunk ends at each place whose hash is the least among those of the ``reach`` places to either
side. So a boundary depends on the ``reach`` + 32 bytes before it and the ``reach`` after it alone: two
texts that share a longer passage cut its inside alike, whatever stands before it, and an insertion moves
no boundary beyond that distance. Boundaries are more than ``reach`` bytes apart and about twice that on
average; in stretches whose hashes repeat, equal ones that follow too soon are skipped.

Chunks are compared by a 128-bit digest. Of each digest the first place (by document id, then place) stays.
A passage is a run of repeated chunks, one after the other, of ``shortest`` bytes or more, or a whole text: passages are
removed. Shorter runs are stock phrases; they are counted (``n_shared``) and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut, texts, utf8
from pathloom.plans.lineage import unbound

GEAR = np.random.default_rng(20240301).integers(0, 2**32, 256, np.uint32)
WINDOW = 32
#: A chunk's place: 32 bits that tell apart the texts of one id, then 31 bits of where it starts.
START_BITS = 31
START_MASK = (1 << START_BITS) - 1


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: that of 2k bytes is made of those of k bytes at the place and k before."""
    hashes, size = GEAR[data], 1
    while size < WINDOW:
        longer = hashes.copy()
        longer[size:] += hashes[:-size] << np.uint32(size)
        hashes, size = longer, 2 * size
    return hashes


def boundaries(data: np.ndarray, reach: int) -> np.ndarray:
    """Where the chunks of one text end."""
    if not len(data):
        return np.zeros(0, np.int64)
    hashes, window = gear_hashes(data), 2 * reach + 1
    edge = np.full(reach, 0xFFFFFFFF, np.uint32)
    least, size = np.concatenate([edge, hashes, edge]), 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(data)], least[window - size : window - size + len(data)])
    ends = np.flatnonzero(hashes == least) + 1
    ends = ends[(ends > reach) & (ends < len(data) - reach)]
    if len(ends) and np.diff(ends, prepend=0).min() <= reach:
        kept, last = [], 0
        for end in ends.tolist():
            if end - last > reach:
                kept.append(end)
                last = end
        ends = np.array(kept, np.int64)
    return np.append(ends, len(data)).astype(np.int64)


def _chunks(reach: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches(parts):
            data, offsets = utf8(batch.column("text"))
            view, keys = memoryview(data), np.asarray(batch.column("key")) << START_BITS
            rows, places, digests = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                ends = boundaries(data[a:b], reach)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
                rows.append(np.full(len(ends), i))
                places.append(keys[i] | begins)
                digests += [xxhash.xxh3_128_digest(view[a + s : a + e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), batch.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places))], names=["digest1", "digest2", "doc_id", "place"])

    return run


def repeated_chunks(docs: DataFrame, reach: int) -> DataFrame:
    """doc_id, key, starts: of each text, where the chunks start that are not their digest's first place.

    Half a digest is counted first, so that chunks found once, nearly all, leave before whole rows are compared.
    """
    cut_up = docs.mapInArrow(_chunks(reach), f"digest1 long, digest2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, place long")
    often = cut_up.groupBy("digest1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest1")
    shared = cut(cut_up.join(unbound(often, "digest1"), "digest1", "left_semi"))
    # Rows without an id come after all others.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "place")
    first = shared.groupBy("digest1", "digest2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("digest1", "digest2", "first")
    later = shared.join(unbound(first, "digest1", "digest2"), ["digest1", "digest2"]).where(~place.eqNullSafe(F.col("first")))
    start = F.col("place").bitwiseAND(START_MASK).cast("int")
    return later.groupBy("doc_id", F.shiftright("place", START_BITS).alias("key")).agg(F.collect_set(start).alias("starts"))


def passages(ends: np.ndarray, low: np.ndarray, shortest: int) -> np.ndarray:
    """Of repeated chunks, by their sorted starts: the run (start, end) of each that is part of a passage, once a chunk."""
    high = ends[np.searchsorted(ends, low, "right")]
    number = np.cumsum(np.concatenate([[0], low[1:] != high[:-1]]))
    length = np.bincount(number, weights=high - low)[number]
    return np.stack([low, high], axis=1)[(length >= shortest) | (length == ends[-1])]


def dedup_chunks(docs: DataFrame, reach: int = 20, shortest: int = 96, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_shared (chunks that stand elsewhere first), n_repeated (those removed with a passage), n_removed (bytes) and kept (the remaining bytes) for every row.

    Null texts are empty and have no chunks. Of equal texts the one with the smallest id stays and the others lose
    everything, whatever their length; rows that repeat both id and text stay alike; null ids come last and are one id. At its
    edges a passage stays up to the nearest boundary inside it. A table without rows gives none.
    """
    keyed = texts(docs, id_col, text_col).withColumn("key", F.xxhash64("text").bitwiseAND(2**32 - 1))
    found = repeated_chunks(keyed, reach).withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["__id"]) & (keyed["key"] == found["__key"]), "left").select("doc_id", "text", "starts")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            data, offsets = utf8(batch.column("text"))
            counts, shared, repeats, removed, kept = [], [], [], [], []
            for i in range(batch.num_rows):
                body = data[offsets[i] : offsets[i + 1]]
                ends, lows = boundaries(body, reach), batch.column("starts")[i].values
                low = np.sort(np.asarray(lows).astype(np.int64)) if lows is not None else np.zeros(0, np.int64)
                gone = np.zeros(len(body), bool)
                parts_gone = passages(ends, low, shortest) if len(low) else ()
                for a, b in parts_gone:
                    gone[a:b] = True
                counts.append(len(ends))
                shared.append(len(low))
                repeats.append(len(parts_gone))
                removed.append(int(gone.sum()))
                kept.append(body[~gone].tobytes())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long(np.diff(offsets)), long(counts), long(shared), long(repeats), long(removed), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_chunks", "n_shared", "n_repeated", "n_removed", "kept"])

    return joined.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_chunks long, n_shared long, n_repeated long, n_removed long, kept binary")
