"""Packing documents into training sequences: concatenate and cut.

Two passes. The first tokenizes each partition once, gives every document its place in the
partition's own run of ids, and writes ids and places to a checkpoint. The totals of the partitions
(one row each) are summed in partition order; that gives every partition its global base. The second pass
needs no order any more: base plus local place is the document's global offset, and windows of
``length`` ids are cut from it. A document that crosses a window's edge yields one record for each
side. Only the very last window can be short, so padding is below one sequence in all.
"""

from __future__ import annotations

import functools
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut, give_back, texts, utf8

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The contractions that byte-level vocabularies split off after an apostrophe (fixed values of their pattern:
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+).
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
WORDS_KEPT, LONGEST_KEPT = 1_000_000, 64  # words and bytes a word: some 250 MB in a Python worker at most


class Splitter:
    """Where a byte-level tokenizers file splits texts into words, found for a whole batch at once.

    What kind a character is (letter, number, white space, other) the file itself is asked, once for each character that occurs,
    so that no table of another Unicode version comes in.
    """

    def __init__(self, split):
        self.split, self.kinds = split, np.zeros(0x110000, np.uint8)

    def kind(self, char: str) -> int:
        return next((kind for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(before + char)) == 1), SPACE)

    def starts(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The places in body (UTF-8) at which words start; texts start at ``offsets``."""
        lead = np.flatnonzero((body & 0xC0) != 0x80)
        points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), "<u4")
        kinds, n = self.kinds[points], len(points)
        if not kinds.all():
            for point in np.unique(points[kinds == 0]).tolist():
                self.kinds[point] = self.kind(chr(point))
            kinds = self.kinds[points]
        first = np.zeros(n + 1, bool)
        first[np.searchsorted(lead, offsets)] = True
        space, blank, start = kinds == SPACE, points == 0x20, first[:n].copy()
        start[1:] |= (kinds[1:] != kinds[:-1]) & ~(blank[:-1] & ~first[1:n])  # a blank belongs to the word after it
        start[1:-1] |= space[1:-1] & space[:-2] & ~space[2:] & ~first[2:n]  # of several spaces the last stands apart, unless the text ends
        for i in np.flatnonzero((points == 0x27) & start).tolist():
            end = i + 1 + int(np.argmax(first[i + 1 : i + 4])) if first[i + 1 : i + 4].any() else i + 3
            after = "".join(map(chr, points[i + 1 : end].tolist()))
            size = 1 + next((k for k in (1, 2) if after[:k] in CONTRACTIONS and len(after) >= k), 0)
            if size > 1:
                start[i + 1 : i + size] = False
                start[i + size : i + size + 1] |= kinds[i + size : i + size + 1] == LETTER
        return lead[start]


@functools.lru_cache(maxsize=1)
def encoder(json_name: str, folder: str | None = None, job: str = ""):
    """A function from a column of texts to their ids (little-endian bytes) and to how many bytes an id takes, by a tokenizers file.

    A byte-level file without a normalizer encodes each word for itself, so the file is asked once for each different word of a batch,
    and answers are kept from batch to batch and, in a Python worker, from task to task of one ``job``, until its second pass (words of up to LONGEST_KEPT bytes; beyond WORDS_KEPT it starts anew). Texts that spell out a special token, and files of another kind, are encoded whole.
    ``folder``: where the file lies; None asks the installed ``public_tokenizers``.
    """
    from tokenizers import Tokenizer

    if folder is None:
        import public_tokenizers

        place = public_tokenizers.path(json_name)
    else:
        place = f"{folder}/{json_name}"
    full = Tokenizer.from_file(str(place))
    made, width = json.loads(full.to_str()), 2 if full.get_vocab_size() <= 1 << 16 else 4
    first = made["pre_tokenizer"] or {}
    by_word = first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"] and made["normalizer"] is None and made["model"]["type"] == "BPE"
    special, known = [t["content"] for t in made["added_tokens"]], {}
    splitter = Splitter(full.pre_tokenizer.pre_tokenize_str) if by_word else None

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{width}").tobytes() for e in full.encode_batch(texts, add_special_tokens=False)]

    def ask(words: list[bytes]) -> Iterator[bytes]:
        for i in range(0, len(words), 4096):
            some = [word.decode() for word in words[i : i + 4096]]
            got = full.encode(some, is_pretokenized=True, add_special_tokens=False)
            ends = np.cumsum(np.bincount(np.array(got.word_ids, np.int64), minlength=len(some))) * width
            raw, at = np.array(got.ids, f"<u{width}").tobytes(), 0
            for end in ends.tolist():
                yield raw[at:end]
                at = end

    def encode(column: pa.Array) -> tuple[list[bytes], int]:
        if splitter is None:
            return whole(column.to_pylist()), width
        odd = np.zeros(len(column), bool)
        for token in special:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        body, offsets = utf8(column)
        starts = splitter.starts(body, offsets)
        bounds = pa.py_buffer(np.append(starts, len(body)))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, bounds, pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
        different = words.dictionary.to_pylist()
        if len(known) > WORDS_KEPT:
            known.clear()
        new = [word for word in different if word not in known]
        known.update(zip(new, ask(new), strict=True))
        taken = pa.array([known[word] for word in different], pa.large_binary()).take(words.indices)
        for word in new:
            if len(word) > LONGEST_KEPT:
                del known[word]
        raw, ends = utf8(taken)
        raw, at = raw.tobytes(), ends[np.searchsorted(starts, offsets)].tolist()
        return [whole([column[i].as_py()])[0] if odd[i] else raw[at[i] : at[i + 1]] for i in range(len(column))], width

    return encode


def tokenize(docs: DataFrame, json_name: str = "byte_bpe_50k.json", end_id: int = 1, folder: str | None = None) -> DataFrame:
    """doc_id, part (the partition), place (ids before the document in its partition), ids (uint16 or uint32 bytes, little-endian), width, n."""

    job = uuid.uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encode, part, place = encoder(json_name, folder, job), TaskContext.get().partitionId(), 0
        for batch in batches(parts):
            found, width = encode(batch.column("text"))
            ids = [raw + end_id.to_bytes(width, "little") for raw in found]
            counts = np.array([len(raw) // width for raw in ids], np.int64)
            places = place + np.cumsum(counts) - counts
            place += int(counts.sum())
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * n, pa.int32()), pa.array(places, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * n, pa.int32()), pa.array(counts, pa.int64())],
                names=["doc_id", "part", "place", "ids", "width", "n"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, place long, ids binary, width int, n long")


def pack(docs: DataFrame, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", **tokenizer) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids_le32.

    A null or empty text is its end id alone. Rows with equal ids or equal texts are packed each for
    itself, in the table's own order. An empty table gives no rows. The checkpoint fixes the order, so a
    recomputed second pass agrees with itself. What reaches the driver is one total for each partition.
    """
    tokens = cut(tokenize(texts(docs, id_col, text_col), **tokenizer))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).collect()
    bases, total = {}, 0
    for row in sorted(totals):
        bases[row["part"]] = total
        total += row["n"]
    return tokens.mapInArrow(_cutter(bases, length), PIECES.replace("doc_id long", f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}") + ", ids_le32 binary")


def _cutter(bases: dict[int, int], length: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder.cache_info().currsize:  # the first pass is over, and Python workers outlive it
            encoder.cache_clear()
            give_back()
        for batch in batches(parts):
            rows, starts, sizes, crcs, sequences, offsets, pieces = [], [], [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("part", "place", "ids", "width", "n"))
            for i, (part, place, raw, width, n) in enumerate(zip(*columns, strict=True)):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                at, start = bases[part] + place, 0
                while start < n:
                    offset = (at + start) % length
                    size = min(length - offset, n - start)
                    piece = ids[start : start + size].tobytes()
                    rows.append(i)
                    starts.append(start)
                    sizes.append(size)
                    crcs.append(zlib.crc32(piece))
                    sequences.append((at + start) // length)
                    offsets.append(offset)
                    pieces.append(piece)
                    start += size
            take = pa.array(rows, pa.int64())
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), long(starts), long(sizes), long(crcs), batch.column("n").take(take), long(sequences), long(offsets), pa.array(pieces, pa.binary())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids_le32"])

    return run
