"""Exact repeated substrings by bucket-pointer refinement, without suffixes of the whole corpus.

A suffix is looked at where it can matter: of every ``length`` bytes the gram of ``gram`` bytes with the
smallest hash is an anchor, which any two equal strings of that length share at the same place. Anchors fall
into initial buckets by their gram, and buckets of one are final: those suffixes leave at once. An anchor
answers for a stretch: all strings of which it is the smallest gram. Stretches found twice, by identifiers of 128 bits, are
settled by counts alone, however often they occur, and go on as one.

What is left in a bucket differs somewhere inside its stretch. Buckets come together in groups of bounded size, and
a group is refined as in a suffix array (``refined``): each place points to its bucket; places in a bucket of several are sorted by
their own bucket and that of the place as many bytes on as are already known to be equal; the pointers change in
place, so the next pass sorts by refined buckets and twice as many bytes are known; places alone in their bucket drop out. That
part compares bytes and is exact without hashes. Buckets beyond ``hot`` members are counted string by string across the cluster,
by identifiers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut, texts, utf8
from pathloom.plans.lineage import unbound

#: Places are kept in the low bits of the keys; a buffer of 2^17 bytes keeps its arrays in a core's cache.
PLACES, BUFFER = 1 << 20, 1 << 17
BASE = 32
MULTIPLIERS = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]], np.uint64)
FIRST = np.random.default_rng(20240229).integers(0, 2**64, 2, np.uint64)


def join_ids(left: np.ndarray, right: np.ndarray, family: int) -> np.ndarray:
    """The identifier of two strings, one after the other, from theirs."""
    a, b = MULTIPLIERS[family]
    mixed, other = left >> np.uint64(29), right >> np.uint64(32)
    mixed ^= left
    mixed *= a
    other ^= right
    other *= b
    mixed += other
    np.right_shift(mixed, np.uint64(31), out=other)
    mixed ^= other
    return mixed


def base_ids(data: np.ndarray, family: int) -> np.ndarray:
    """Identifiers of the BASE bytes from each place on."""
    eights = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    ids, size = (eights ^ FIRST[family]) * MULTIPLIERS[family, 0], 8
    ids ^= ids >> np.uint64(32)
    while size < BASE:
        ids, size = join_ids(ids[:-size], ids[size:], family), 2 * size
    return ids


def ids_at(base: np.ndarray, places: np.ndarray, length: int, family: int) -> np.ndarray:
    """Identifiers of ``length`` (at least BASE) bytes from some places on."""
    if length == BASE:
        return base[places]
    half = BASE
    while 2 * half < length:
        half *= 2
    return join_ids(ids_at(base, places, half, family), ids_at(base, places + (length - half), half, family), family)


def sliding_minimum(keys: np.ndarray, window: int) -> np.ndarray:
    least, size = keys, 1
    while 2 * size <= window:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    return np.minimum(least[: len(keys) - window + 1], least[window - size :])


def buffers(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the rows' bytes, and for each: row, its place in the buffer, its offset in the row, its number of strings.

    Rows are laid end to end up to BUFFER bytes; a longer row goes on in the next buffer, less ``length`` - 1 bytes.
    """
    parts, held, used = [], [], 0
    for row, (start, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        at = start
        while end - at >= length:
            if BUFFER - used < min(end - at, 16 * length):
                yield np.concatenate(parts), np.array(held, np.int64)
                parts, held, used = [], [], 0
            take = min(end - at, BUFFER - used)
            parts.append(data[at : at + take])
            held.append((row, used, at - start, take - length + 1))
            used += take
            at += take - length + 1
    if parts:
        yield np.concatenate(parts), np.array(held, np.int64)


def anchors(data: np.ndarray, held: np.ndarray, length: int, gram: int, identify: bool = True) -> dict[str, np.ndarray]:
    """Each anchor of a buffer: row, low (offset of its first string in the row), span (how many strings), bucket and two identifiers of its stretch."""
    bases = [base_ids(data, family) for family in ((0, 1) if identify else (0,))]
    grams = join_ids(bases[0][: len(data) - gram + 1], bases[0][gram - BASE :], 0)
    keys = grams & ~np.uint64(PLACES - 1) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_minimum(keys, length - gram + 1) & np.uint64(PLACES - 1)).astype(np.int64)
    starts = np.concatenate([np.arange(at, at + n) for at, n in zip(held[:, 1].tolist(), held[:, 3].tolist(), strict=True)])
    at = least[starts]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    low, high, place = starts[first], starts[np.append(first[1:], len(starts)) - 1], at[first]
    owner = np.searchsorted(held[:, 1], low, "right") - 1
    if not identify:
        return {"row": held[owner, 0], "bucket": grams[place].view(np.int64)}
    span = high - low + 1
    ids = [join_ids(ids_at(b, low, length, f), ids_at(b, high, length, f) + span.astype(np.uint64), f) for f, b in enumerate(bases)]
    return {"row": held[owner, 0], "low": low - held[owner, 1] + held[owner, 2], "span": span, "bucket": grams[place].view(np.int64), "id1": ids[0].view(np.int64), "id2": ids[1].view(np.int64)}


def _twice(seen: dict[bytes, int], data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Each text's key, and whether it is one of the first two of its key here: a third copy adds nothing to what two settle."""
    keys = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    wanted = np.zeros(len(keys), bool)
    for i, key in enumerate(keys):
        if seen.get(key, 0) < 2:
            if len(seen) >= 200_000:
                seen.clear()
            seen[key] = seen.get(key, 0) + 1
            wanted[i] = True
    return keys, wanted


def _buckets(length: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches(parts):
            data, offsets = utf8(batch.column("text"))
            wanted = _twice(seen, data, offsets)[1]
            for buffer, held in buffers(data, offsets, length):
                held = held[wanted[held[:, 0]]]
                if len(held):
                    yield pa.RecordBatch.from_arrays([pa.array(anchors(buffer, held, length, gram, identify=False)["bucket"])], names=["bucket"])

    return run


def _stretches(length: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches(parts):
            data, offsets = utf8(batch.column("text"))
            keys, wanted = _twice(seen, data, offsets)
            for buffer, held in buffers(data, offsets, length):
                held = held[wanted[held[:, 0]]]
                if not len(held):
                    continue
                found = anchors(buffer, held, length, gram)
                order = np.lexsort((found["low"], found["id2"], found["id1"], found["row"]))
                found = {name: values[order] for name, values in found.items()}
                same = np.concatenate([[False], np.all([found[c][1:] == found[c][:-1] for c in ("row", "id1", "id2", "bucket")], axis=0)])
                first = np.flatnonzero(~same)
                ends = np.append(first, len(same))
                rows = found["row"][first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found[c][first], pa.int64()) for c in ("bucket", "id1", "id2")]
                    + [pa.array([keys[r] for r in rows], pa.binary()), batch.column("doc_id").take(pa.array(rows)), pa.array(np.diff(ends), pa.int64()), pa.array(found["span"][first], pa.int32()),
                       pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found["low"], pa.int32()))],
                    names=["bucket", "id1", "id2", "key", "doc_id", "n", "span", "lows"])

    return run


def _strings(length: int):
    """Each string of a bucket's stretches: key, place, identifiers."""

    def of(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        column = table.column("stretch")
        data, offsets = utf8(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
        sizes = np.diff(offsets) - length + 1
        member = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        places = offsets[:-1][member] + inner
        ids = [ids_at(base_ids(data, f), places, length, f) for f in (0, 1)]
        return member, np.asarray(table.column("low"))[member] + inner, *ids

    return of


def refined(data: np.ndarray, length: int, start: int = 8) -> np.ndarray:
    """The bucket of each place of data: two places share one exactly if ``length`` (at least 8) bytes from there on are equal.

    Data counts as followed by zero bytes. A bucket's number is the rank of its first member, as in a suffix array.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    grams = np.ascontiguousarray(np.ndarray((n,), "<u8", padded, strides=(1,)))
    order = np.argsort(grams, kind="stable")
    pointers, known = np.full(n + length, n, np.uint64), start
    pointers[n:] += np.arange(length, dtype=np.uint64)  # beyond the end each place is a bucket of its own
    open_ = _renumber(pointers, order, grams[order], np.zeros(n, np.uint64))
    while known < length and len(open_):
        step = min(known, length - known)
        keys = pointers[open_] * np.uint64(n + length) + pointers[open_ + step]
        order = np.argsort(keys, kind="stable")
        open_ = _renumber(pointers, open_[order], keys[order], pointers[open_[order]])
        known += step
    return pointers[:n]


def _renumber(pointers: np.ndarray, places: np.ndarray, keys: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sets the pointers of places, sorted by key inside their bucket ``before``; the places that still share a bucket."""
    if not len(places):
        return places
    change = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.arange(len(places))
    first = np.maximum.accumulate(np.where(change, at, 0))
    bucket = np.maximum.accumulate(np.where(np.concatenate([[True], before[1:] != before[:-1]]), at, 0))
    pointers[places] = before + (first - bucket).astype(np.uint64)
    return places[~change | ~np.append(change[1:], True)]


def _runs(member: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Successive places of a member as (member, first, how many)."""
    order = np.lexsort((place, member))
    member, place = member[order], place[order]
    first = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (place[1:] != place[:-1] + 1)])) if len(member) else np.zeros(0, np.int64)
    return member[first], place[first], np.diff(np.append(first, len(member)))


def same_text(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Joins rows by doc_id and key; other's columns come along, but for those two.

    Null-safe, so that no filter is put before the exchange of the texts: within a query it is then made once and used again.
    """
    renamed = other.withColumnsRenamed({"doc_id": "__id", "key": "__key"})
    return docs.join(renamed, docs["doc_id"].eqNullSafe(renamed["__id"]) & docs["key"].eqNullSafe(renamed["__key"]), how).drop("__id", "__key")


def _members(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """The stretches of buckets with several members, a row for each text that holds one and each set of places; what led there can be cleaned up."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_stretches(length, gram), f"bucket long, id1 long, id2 long, key binary, doc_id {id_type}, n long, span int, lows array<int>")
    buckets = docs.select("text").mapInArrow(_buckets(length, gram), "bucket long")
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    kept = unbound(rows.join(unbound(shared, "bucket"), "bucket", "left_semi"), "bucket")
    # Buffers end at any place of a long text: it comes once for each buffer that holds the stretch, each time with other places.
    return cut(kept.groupBy("bucket", "id1", "id2", "key", "lows").agg(F.sum("n").alias("n"), F.min("doc_id").alias("doc_id"), F.min("span").alias("span")))


def repeated(docs: DataFrame, length: int = 200, gram: int = 40, hot: int = 5_000, group: int = 1_000) -> DataFrame:
    """docs: doc_id, text and key (MD5 of the text). key, spans: the places of each text at which a string of ``length`` bytes starts that also starts elsewhere, as runs (low, span)."""
    members = _members(docs, length, gram)
    stretches = members.groupBy("bucket", "id1", "id2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "key", "span", F.col("lows")[0].alias("low"))).alias("one"))
    settled = members.select("bucket", "id1", "id2", "key", "span", "lows").join(unbound(stretches.where("n > 1").select("bucket", "id1", "id2"), "bucket", "id1", "id2"), ["bucket", "id1", "id2"], "left_semi")
    found = settled.select("key", F.explode("lows").alias("low"), "span")

    sizes = stretches.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    open_ = cut(stretches.join(unbound(sizes, "bucket"), "bucket").select("bucket", "members", "one.*"))
    stretch = F.expr(f"substring(cast(text AS binary), low + 1, span + {length - 1})")
    open_docs = same_text(docs, open_, "inner").select("bucket", "members", "key", "low", stretch.alias("stretch"))
    groups = max(1, -(-open_.count() // group))
    strings = _strings(length)

    def compare(table: pa.Table) -> pa.Table:
        data, offsets = utf8(table.column("stretch").combine_chunks())
        sizes = np.diff(offsets) - length + 1
        member = np.repeat(np.arange(len(sizes)), sizes)
        inner = np.arange(len(member)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        bucket = refined(data, length)[offsets[:-1][member] + inner]
        twice = np.flatnonzero((np.bincount(bucket.astype(np.int64), minlength=1) > 1)[bucket.astype(np.int64)])
        owner, low, span = _runs(member[twice], (np.asarray(table.column("low"))[member] + inner)[twice])
        return pa.table({"key": table.column("key").take(pa.array(owner)), "low": pa.array(low, pa.int32()), "span": pa.array(span, pa.int32())})

    usual = open_docs.where(F.col("members") <= hot)
    found = found.unionByName(usual.withColumn("group", F.pmod(F.xxhash64("bucket"), F.lit(groups))).groupBy("group").applyInArrow(compare, "key binary, low int, span int"))
    if open_.where(F.col("members") > hot).head(1):

        def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches(parts):
                member, place, id1, id2 = strings(batch)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(member)), pa.array(place, pa.int32()), pa.array(id1.view(np.int64)), pa.array(id2.view(np.int64))], names=["key", "low", "id1", "id2"])

        each = open_docs.where(F.col("members") > hot).mapInArrow(spread, "key binary, low int, id1 long, id2 long")
        twice = each.groupBy("id1", "id2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = found.unionByName(each.join(twice, ["id1", "id2"], "left_semi").select("key", "low", F.lit(1).alias("span")))
    return found.groupBy("key").agg(F.collect_list(F.struct("low", "span")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) for every row.

    A byte goes if a string of ``length`` bytes covers it that also starts at another place of any row, its own
    included; overlaps count, and all strings are judged on the input. Null texts are empty; texts shorter than ``length``
    bytes keep everything; copies of a text (and repeated rows) of at least ``length`` bytes lose everything. An empty table gives no rows.
    """
    docs = texts(docs, id_col, text_col).withColumn("key", F.unhex(F.md5("text")))
    spans = docs.select("doc_id", "key").distinct().join(repeated(docs, length, **settings), "key")
    joined = same_text(docs, spans, "left").select("doc_id", "text", F.col("spans.low").alias("lows"), F.col("spans.span").alias("sizes"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            data, offsets = utf8(batch.column("text"))
            removed, runs, kept = [], [], []
            for i in range(batch.num_rows):
                body, lows = data[offsets[i] : offsets[i + 1]], batch.column("lows")[i].values
                if lows is None or not len(lows):
                    removed.append(0)
                    runs.append(0)
                    kept.append(body.tobytes())
                    continue
                low, size = np.asarray(lows).astype(np.int64), np.asarray(batch.column("sizes")[i].values).astype(np.int64)
                edges = np.zeros(len(body) + 1, np.int64)
                np.add.at(edges, low, 1)
                np.add.at(edges, low + size + length - 1, -1)
                gone = np.cumsum(edges)[:-1] > 0
                removed.append(int(gone.sum()))
                runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept.append(body[~gone].tobytes())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), long(np.diff(offsets)), long(removed), long(runs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
