"""Operators on texts against brute force: nulls, empty and long texts, repeated rows, ties, extra columns, empty tables."""

import collections
import hashlib
import random
import re
import struct
import zlib

import pytest

pytest.importorskip("pathloom.llm")

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from pathloom.llm import chunking, gif, licenses, mixing, neardup, packing, private, quality, repeats  # noqa: E402

WORDS = "the of and rain stone river cloud light winter under over paper music north seven small green quiet table window".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + (str(r.randrange(300)) if r.random() < 0.7 else "") for _ in range(n))


def corpus(seed=5):
    """Texts with exact and near copies, shared passages, null, empty, one-word and long ones; two rows that repeat an id and its text."""
    r = random.Random(seed)
    base = [sentence(r, r.randrange(20, 90)) for _ in range(14)]
    passage = sentence(r, 60)
    texts = [*base, base[0], base[0], base[1] + " more", base[2].replace("the", "thé"), passage + " " + base[3], base[4] + " " + passage, None, "", "word", "  \n", "x" * 700, "ab" * 400, sentence(r, 3000), "é" * 300 + base[5]]
    rows = [(i, t, "en" if i % 2 else None, r.choice(["a", "b", None, "c"])) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[7]]


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """The corpus with columns whose names the operators use themselves."""
    df = spark.createDataFrame(corpus(), SCHEMA)
    for name in ("key", "size", "n", "spans", "id", "start", "kept", "node", "root", "hashes", "place", "draw", "score"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_repeats(docs, empty):
    length = 64
    bodies = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    count = collections.Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    want = []
    for i, b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        want.append((i, len(b), sum(gone), runs, bytearray(x for x, g in zip(b, gone, strict=True) if not g)))
    for settings in ({}, {"hot": 1}, {"group": 2}):
        got = repeats.remove_repeats(docs, length=length, gram=40, **settings)
        assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(want, key=repr)
    assert repeats.remove_repeats(empty).count() == 0


def test_repeats_of_200_bytes(spark):
    """Production parameters: copies, shifted and overlapping passages, a string one byte short, and a bucket refined beyond its stretch."""
    r = random.Random(12)
    length, passage = 200, sentence(r, 80)
    assert len(passage) > 260
    rows = [(i, f"{sentence(r, 40)} {passage[: 200 + 7 * i]} {sentence(r, 40)}") for i in range(6)]
    rows += [(10, passage), (11, passage), (12, passage[:199]), (13, "y" + passage[20:219]), (14, "ab" * 300), (15, sentence(r, 500)), (16, None), (17, "")]
    count = collections.Counter(t.encode()[k : k + length] for _, t in rows if t for k in range(len(t.encode()) - length + 1))
    want = []
    for i, t in rows:
        body = (t or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if count[body[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        want.append((i, len(body), sum(gone), bytearray(x for x, g in zip(body, gone, strict=True) if not g)))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "kept") == sorted(want, key=repr)


def test_repeats_of_one_text_in_several_buffers(spark):
    """A stretch that comes in two buffers of a long text goes at both places; so does one of a run longer than a buffer."""
    filler = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage, text = "p" * 150 + filler("q", 100) + "r" * 150, "a" * 140_000
    rows = [(1, text), (2, filler("x", 9_000) + "!" + passage + "?" + filler("y", 30_000) + "#" + passage + "%" + filler("z", 9_000)), (3, filler("u", 30_000))]
    assert all(len(t) > repeats.BUFFER for _, t in rows)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (len(text), 1), 2: (2 * len(passage), 2), 3: (0, 0)}


def test_bucket_pointers():
    r = random.Random(7)
    for n, letters, length in ((1, 1, 8), (40, 1, 11), (300, 2, 13), (1000, 3, 40), (2000, 4, 200), (500, 2, 64)):
        data = bytes(r.randrange(letters) for _ in range(n))
        data += data[: n // 2]
        pointers = repeats.refined(np.frombuffer(data, np.uint8), length).tolist()
        whole = sorted((data[i : i + length], i) for i in range(len(data) - length + 1))
        buckets = collections.defaultdict(set)
        for gram, i in whole:
            buckets[gram].add(pointers[i])
        assert all(len(b) == 1 for b in buckets.values()) and len(set.union(set(), *buckets.values())) == len(buckets)


def test_repeats_in_pieces(monkeypatch, docs):
    """Texts longer than a buffer give the same result."""
    whole = rows_of(repeats.remove_repeats(docs, length=64), "doc_id", "n_removed", "n_spans")
    data = np.frombuffer(b"".join((t or "").encode() for _, t, *_ in corpus()), np.uint8)
    offsets = np.cumsum([0, *(len((t or "").encode()) for _, t, *_ in corpus())])
    monkeypatch.setattr(repeats, "BUFFER", 2000)
    starts = collections.Counter()
    for buffer, held in repeats.buffers(data, offsets, 64):
        for row, at, low, n in held:
            body = data[offsets[row] + low : offsets[row] + low + n + 63]
            assert bytes(buffer[at : at + n + 63]) == bytes(body)
            starts.update((row, low + k) for k in range(n))
    assert set(starts.values()) == {1}
    assert len(starts) == sum(max(0, n - 63) for n in np.diff(offsets))
    assert whole


def brute_boundaries(body, reach):
    gear, value, hashes = chunking.GEAR.tolist(), 0, []
    for byte in body:
        value = ((value << 1) + gear[byte]) & 0xFFFFFFFF
        hashes.append(value)
    ends, last = [], 0
    for k in range(reach, len(body) - reach - 1):
        if hashes[k] == min(hashes[max(0, k - reach) : k + reach + 1]) and k + 1 - last > reach:
            ends.append(k + 1)
            last = k + 1
    return [*ends, len(body)] if body else []


def test_chunk_boundaries():
    r = random.Random(8)
    for body in [b"", b"a", b"x" * 300, b"ab" * 150, r.randbytes(2000), sentence(r, 200).encode(), bytes(50) + r.randbytes(90) + bytes(70)]:
        for reach in (1, 5, 20):
            assert chunking.boundaries(np.frombuffer(body, np.uint8), reach).tolist() == brute_boundaries(body, reach)


def test_chunks(spark, docs, empty):
    reach, shortest = 8, 48
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus()]

    def cut_up(body):
        ends = brute_boundaries(body, reach)
        return list(zip([0, *ends[:-1]], ends, strict=False))

    first = {}
    for i, body in sorted(set(texts)):
        for a, b in cut_up(body):
            first.setdefault(body[a:b], (i, a))
    want = []
    for i, body in texts:
        gone, run, shared, repeated = bytearray(len(body)), [], 0, 0
        for a, b in [*cut_up(body), (None, None)]:
            if a is not None and first[body[a:b]] != (i, a):
                run.append((a, b))
                shared += 1
                continue
            if run and (run[-1][1] - run[0][0] >= shortest or run[-1][1] - run[0][0] == len(body)):
                gone[run[0][0] : run[-1][1]] = b"\1" * (run[-1][1] - run[0][0])
                repeated += len(run)
            run = []
        want.append((i, len(body), len(cut_up(body)), shared, repeated, sum(gone), bytearray(x for x, g in zip(body, gone, strict=True) if not g)))
    got = chunking.dedup_chunks(docs, reach, shortest)
    assert rows_of(got, "doc_id", "n_bytes", "n_chunks", "n_shared", "n_repeated", "n_removed", "kept") == sorted(want, key=repr)
    assert chunking.dedup_chunks(empty).count() == 0
    odd = {x["doc_id"]: x for x in chunking.dedup_chunks(spark.createDataFrame([(None, "same short text"), (5, "same short text"), (6, None)], "doc_id long, text string")).collect()}
    assert (odd[5]["n_removed"], odd[None]["n_removed"], odd[6]["n_chunks"]) == (0, 15, 0)


def test_chunks_find_passages():
    """Of passages of 51 words put into two random texts, the run in step is long enough nearly always."""
    r, found = random.Random(3), 0
    for _ in range(300):
        passage = sentence(r, 51)
        a, b = (f"{sentence(r, 30)} {passage} {sentence(r, 30)}".encode() for _ in range(2))
        cuts = [chunking.boundaries(np.frombuffer(t, np.uint8), 20) for t in (a, b)]
        known = {a[x:y] for x, y in zip([0, *cuts[0][:-1]], cuts[0], strict=True)}
        low = np.array([x for x, y in zip([0, *cuts[1][:-1]], cuts[1], strict=True) if b[x:y] in known])
        found += bool(len(low)) and len(chunking.passages(cuts[1], low, 96)) > 0
    assert found >= 298


def test_gif_round_trip(docs, empty):
    got = {r["doc_id"]: r for r in gif.media_columns(docs, rows=8).collect()}
    for i, t, *_ in corpus():
        body = (t or "").encode()
        padded = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        assert bytes(got[i]["payload"]) == padded
        assert got[i]["n_bytes"] == len(body)
        assert len(got[i]["frames"]) == -(-len(padded) // 512)
        assert sum(sum(f["histogram"]) for f in got[i]["frames"]) >= len(padded)
    digests = {r["doc_id"]: r for r in gif.digests(gif.media_columns(docs)).collect()}
    assert digests[0]["payload_sha256"] == digests[14]["payload_sha256"] and digests[0]["feature"] == digests[14]["feature"]
    assert digests[20]["payload_bytes"] == 64 and digests[20]["tail_crc32"] == zlib.crc32(bytes(64))
    assert gif.media_columns(empty).count() == 0


def plain_lzw(stream, bits):
    """The samples of an LZW stream, bit by bit, as the format describes it."""
    clear, out, at = 1 << bits, [], 0
    table, width, previous = {}, bits + 1, None
    while True:
        code = sum((stream[(at + k) >> 3] >> ((at + k) & 7) & 1) << k for k in range(width))
        at += width
        if code == clear:
            table, width, previous = {i: [i] for i in range(clear)}, bits + 1, None
            free = clear + 2
            continue
        if code == clear + 1:
            return out
        entry = table[code] if code in table else previous + previous[:1]
        out += entry
        if previous is not None and free < 4096:
            table[free] = previous + entry[:1]
            free += 1
            width = min(12, max(width, free.bit_length()))
        previous = entry


def test_gif_against_a_plain_reader(spark):
    """Stored files, histograms and features of production parameters against a reader written from the format alone."""
    texts = [t for _, t, *_ in corpus()][:3] + [None, "", "é" * 100, sentence(random.Random(3), 15_000)]
    got = gif.media_columns(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    files = {r["doc_id"]: r for r in got.collect()}
    digests = {r["doc_id"]: r for r in gif.digests(got).collect()}
    for i, text in enumerate(texts):
        body = (text or "").encode()
        payload = body + bytes(max(64, -(-len(body) // 64) * 64) - len(body))
        media = bytes(files[i]["media"])
        assert media[:6] == b"GIF89a" and media[-1:] == b";"
        at, samples, frames, counts, delays = 13 + 768, [], 0, collections.Counter(), 0
        palette = [tuple(media[13 + 3 * k : 16 + 3 * k]) for k in range(256)]
        while media[at] != 0x3B:
            assert media[at : at + 3] == b"\x21\xf9\x04"
            delays += 10 * struct.unpack_from("<H", media, at + 4)[0]
            left, top, width, height, flags, bits = struct.unpack_from("<HHHHBB", media, at + 9)
            assert (media[at + 8], left, top, width, flags, bits) == (0x2C, 0, 0, 64, 0, 8)
            at, stream = at + 19, b""
            while media[at]:
                stream += media[at + 1 : at + 1 + media[at]]
                at += 1 + media[at]
            at += 1
            frame = plain_lzw(stream, bits)
            assert len(frame) == width * height
            rows = struct.unpack_from("<H", media, 8)[0]
            for index in frame + [0] * (64 * rows - len(frame)):  # what a frame does not cover shows the background
                r, g, b = palette[index]
                counts[(r >> 6) * 16 + (g >> 6) * 4 + (b >> 6)] += 1
            samples += frame
            frames += 1
        assert bytes(samples) == payload
        want = ",".join(f"{k}:{counts[k]}" for k in sorted(counts))
        assert digests[i]["feature"] == f"{frames};{delays};{want}"
        assert (digests[i]["n_bytes"], digests[i]["payload_bytes"], digests[i]["media_bytes"]) == (len(body), len(payload), len(media))
        assert (digests[i]["payload_sha256"], digests[i]["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(media).hexdigest())
        assert digests[i]["tail_crc32"] == zlib.crc32(payload[-64:])


def test_gif_broken_files():
    media = gif.encode(bytes(range(256)) * 8, rows=16)
    whole = gif.decode(media)
    for n in range(13, len(media), 7):
        frames = gif.decode(media[:n])
        assert len(frames) <= len(whole) and all(np.array_equal(a.samples, b.samples) for a, b in zip(frames[:-1], whole, strict=False))
    for bad in (b"", b"GIF", b"PNG" * 9, media[:12]):
        with pytest.raises(ValueError):
            gif.decode(bad)
    stream = gif.compress(bytes([1, 2, 3, 0]), 2)
    bare = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0, 0, 0) + struct.pack("<BHHHHBB", 0x2C, 0, 0, 2, 2, 0, 2) + bytes([len(stream)]) + stream + b"\0;"
    assert gif.decode(bare)[0].canvas[:, :, 0].tolist() == [[1, 2], [3, 0]]


def test_gif_rules():
    """Two frames with a local palette, transparency, an offset, interlacing and each disposal."""

    def stream(samples, bits):
        data = gif.compress(bytes(samples), bits)
        return bytes([bits, len(data)]) + data + b"\0"

    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    for disposal, after in ((1, [1, 1, 1, 1]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 0])):
        media = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + shared
        media += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2, 5, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 2, 2, 0) + stream([1, 1, 1, 1], 2)
        media += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1, 7, 2, 0) + struct.pack("<BHHHHB", 0x2C, 1, 0, 1, 2, 0x81) + local + stream([2, 3], 2) + b"\x21\xfe\x02hi\x00;"
        one, two = gif.decode(media)
        assert (one.delay_ms, two.delay_ms, two.left, two.transparent) == (50, 70, 1, 2)
        assert one.canvas.tolist() == [[[255, 0, 0]] * 2] * 2
        colours = {0: [0, 0, 0], 1: [255, 0, 0]}
        assert two.canvas.tolist() == [[colours[after[0]], colours[after[1]]], [colours[after[2]], [6, 6, 6]]]
    rows = list(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    media = b"GIF87a" + struct.pack("<HHBBB", 1, 10, 0xF7, 0, 0) + bytes(range(256)) * 3 + struct.pack("<BHHHHB", 0x2C, 0, 0, 1, 10, 0x40) + stream(order, 8) + b";"
    assert gif.decode(media)[0].samples[:, 0].tolist() == rows
    noise = random.Random(1).randbytes(30_000)
    assert gif.expand(gif.compress(noise), 8, len(noise)) == noise
    assert noise.startswith(gif.expand(gif.compress(noise)[:1000], 8, len(noise)))


def test_near_duplicates(docs, empty):
    lower = {c: c + 32 for c in range(65, 91)}
    def shingles(t):
        w = [x.translate(lower) for x in re.findall(r"[A-Za-z0-9_\u0080-\U0010ffff]+", t or "")]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    rows = corpus()
    r = random.Random(9)
    stem = sentence(r, 120).split()
    for k in range(40):
        w = [*stem]
        for _ in range(k % 5):
            w[r.randrange(len(w))] = f"new{k}"
        rows.append((100 + k, " ".join(w), None, None))
    df = docs.sparkSession.createDataFrame(rows, SCHEMA)
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    links, parent, first = collections.Counter(), {i: i for i, _ in sets}, {}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, x) in enumerate(sets):
        first[x] = min(i, first.get(x, i)) if x else i
        for b, (j, y) in enumerate(sets):
            if a != b and x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = [(i, root(i), links[a], first[x] if x else i) for a, (i, x) in enumerate(sets)]
    for block in (1024, 7):
        assert rows_of(neardup.jaccard_join(df, block=block), "doc_id", "class_id", "n_links", "copy_id") == sorted(want, key=repr)
    kept = neardup.one_of_each(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[1] for w in want}) and kept.columns == df.columns
    assert neardup.jaccard_join(empty).count() == 0
    assert neardup.safe_depth(0.8, 0.9999, 22) == 4
    assert neardup.measured_recall(0, 0, 1e6) > 0.99999 and neardup.measured_recall(5, 10, 100) == pytest.approx(100 / (100 + 28 / 11))
    few = neardup.jaccard_join(df, recall=0.5, node_block=3)
    exact = {w[0]: w for w in want}
    assert all(r["n_links"] <= exact[r["doc_id"]][2] for r in few.collect())


def test_near_duplicates_link_blocks_once():
    """Links of one large group grow with its rows and its pairs of blocks, not with rows times blocks; every tree says the same."""
    own = [i % 6 for i in range(60)]
    sets = [np.arange(40, dtype=np.uint64)] * 60 + [np.arange(50, 70, dtype=np.uint64)[a:b] for a, b in ((0, 17), (0, 20), (3, 20))]
    own += [0, 1, 0]  # the two of block 0 are alike only by way of that of block 1

    def dealt(columns, **fixed):
        for f in range(6):
            for t in range(f, 6):
                rows = [i for i in reversed(range(63)) if own[i] in (f, t)]
                more = {"id": rows, "own": [own[i] for i in rows], "first": [f] * len(rows), "second": [t] * len(rows)}
                yield pa.RecordBatch.from_pydict({**{k: [v] * len(rows) for k, v in fixed.items()}, **more, **{k: [v[i] for i in rows] for k, v in columns.items()}})

    def reached(links):
        root = list(range(63))
        for a, b in links * 63:
            root[a] = root[b] = min(root[a], root[b])
        return root

    want = [0] * 60 + [60] * 3
    checked = pa.Table.from_batches(neardup._verify(0.8)(dealt({"shingles": [x.tobytes() for x in sets], "copies": [1] * 63}, root=0))).to_pylist()
    links = [(r["id"], r["other"]) for r in checked if r["other"] is not None]
    assert reached(links) == want and len(links) <= 62 + 15 + 2
    count = collections.Counter()
    for r in checked:
        count[r["id"]] += r["links"]
    assert [count[i] for i in range(63)] == [59] * 60 + [1, 2, 1]
    signatures = [np.full(8, i // 60, "<u2") for i in range(63)]
    signatures[60][:2], signatures[62][6:] = 7, 8
    found = []
    for tree in range(2):
        table = pa.Table.from_batches(neardup._propose(2, 4, 6, 0.8)(dealt({"signature": [x.tobytes() for x in signatures]}, tree=tree, node=5)))
        found.append([(r["a"], r["b"]) for r in table.to_pylist() if r["a"] is not None])
    assert found[0] == found[1] and reached(found[0]) == want and len(found[0]) <= 62 + 15 + 2


def test_one_of_each_tells_texts_apart(spark):
    """Rows of one id with different texts are different documents; columns of the table may bear any name."""
    r = random.Random(21)
    a, b, c = (sentence(r, 60) for _ in range(3))
    rows = [(8, a), (8, b), (9, a), (9, c + " more"), (7, c), (8, a), (5, None), (5, ""), (None, b), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id int, text string, __id long")
    for name in ("__key", "id", "key", "root", "row", "digest", "first"):
        df = df.withColumn(name, F.lit(name))
    kept = neardup.one_of_each(df)
    assert kept.columns == df.columns
    assert rows_of(kept, "doc_id", "text") == sorted([(8, a), (8, b), (7, c), (5, None), (5, ""), (None, None)], key=repr)
    assert neardup.one_of_each(df.limit(0)).count() == 0


def test_licenses(spark, docs, empty):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0-notice"]
    words = mit.split()
    near = " ".join(w if i % 37 else "other" for i, w in enumerate(words))
    far = " ".join(w if i % 4 else "other" for i, w in enumerate(words))
    r = random.Random(2)
    rows = [(0, None), (1, ""), (2, "one two"), (3, mit), (4, sentence(r, 333) + "\n" + near + "\n" + sentence(r, 7)), (5, far), (6, gpl.upper() + "!" + mit), (7, (gpl + " ") * 200), (8, sentence(r, 30) + " " + gpl), (8, "again"), (9, "Released under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hashes", F.lit(1)).withColumn("license", F.lit(1))

    def shingles(t):
        w = [x for x in re.split(r"[\W]+", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = set()
    for i, t in rows:
        for name, template in licenses.TEMPLATES.items():
            part = shingles(template)
            share = len(part & shingles(t)) / len(part)
            if share >= 0.8:
                want.add((i, name, share))
    got = rows_of(licenses.scan(df), "doc_id", "license", "containment")
    assert got == sorted(want, key=repr) and len(got) >= 7
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_license_bands_are_independent(spark):
    """Windows of similarity J share a band with the chance 1 - (1 - J)^4, and time grows with the text's length and no faster."""
    import time

    r = random.Random(17)
    rows = []
    for k in range(4000):
        a = [r.randrange(-(2**62), 2**62) for _ in range(16)]
        shared = 10
        b = a[:shared] + [r.randrange(-(2**62), 2**62) for _ in range(16 - shared)]
        rows.append((a, b))
    jaccard = 10 / 22
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    hits = F.greatest(*(F.array_min(licenses._permuted(F.col("a"), seed)) == F.array_min(licenses._permuted(F.col("b"), seed)) for seed in licenses.SEEDS))
    share = df.where(hits).count() / len(rows)
    assert abs(share - (1 - (1 - jaccard) ** 4)) < 0.02
    seconds = []
    for n in (20_000, 80_000):
        long = spark.createDataFrame([(1, sentence(r, n) + " " + licenses.TEMPLATES["mit"])], "doc_id long, text string")
        began = time.perf_counter()
        assert [x["license"] for x in licenses.scan(long).collect()] == ["mit"]
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 6 * seconds[0] + 2


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base(text):
    def holds(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(p) <= 255 for p in v.split("."))
        if kind == "card":
            return 14 <= len(digits) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, digits[::-1]))) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    return sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if holds(k, m[0]))


def test_private_base(spark, empty):
    r = random.Random(4)
    alphabet = ["a", "1", "4", "@", ".", "-", " ", "+", "(", ")", "é", "_", "x.co", "192", "😀", "0", "255"]
    texts = [None, "", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "000000255.1.2.3 256.1.1.1", "4111 1111-1111 1111", "é😀 +1 (988) 555-2485, x@y.zz.", "1 " * 4000, "a." * 4000 + "@b", "a@" + "b." * 4000, "9" * 5000, "+1" + " " * 3000 + "2", "+" * 3000, "4111111111111111 " * 60]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit("x"))
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["base"]] for r in private.find_private(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert private.find_private(empty).count() == 0


def luhn_number(r, valid):
    while True:
        n = "4" + "".join(str(r.randrange(10)) for _ in range(15))
        if bool(base(n)) == valid:
            return n


def test_private_bootstrap(spark):
    """Numbers that fail the base test are found where valid ones are usual, and nowhere else."""
    r = random.Random(6)
    rows = [(i, f"{sentence(r, 5)} pay with card {luhn_number(r, True)} today {sentence(r, 4)}") for i in range(12)]
    rows += [(50, f"pay with card {luhn_number(r, False)} today"), (51, f"serial {luhn_number(r, False)} ends"), (52, "no numbers here"), (50, "another text of the same id"), (53, None)]
    rows += [rows[12]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("__hash", F.lit("mine")).withColumn("spans", F.lit(1))
    found = private.find_private(df)
    more = {(x["doc_id"], s["kind"]) for x in found.collect() for s in x["spans"] if s not in x["base"]}
    assert more == {(50, 2)}
    hidden = private.without_private(df)
    assert hidden.columns == df.columns and hidden.count() == len(rows) and hidden.where("`__hash` <> 'mine' OR spans <> 1").count() == 0
    texts = collections.Counter(x["text"] for x in hidden.collect())
    assert texts["pay with card <CARD> today"] == 2 and texts[None] == 1 and not any("4" * 1 + d in (t or "") and "card 4" in (t or "") for t in texts for d in "0123456789")


def brute_private(rows, rounds=3):
    """The whole of op2 by loops: rows of (id, text); the written spans of each."""
    mention = r"(?<![A-Za-z0-9@._%+-])(?:[+(]{0,2}+[0-9]++(?:[ ().-]{1,3}+[0-9]++)++(?![A-Za-z0-9@_%+])|(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+)"
    strip = ".,:;!?()[]{}<>\"'"
    held, graph = [], collections.defaultdict(dict)
    for i, text in rows:
        text = text or ""
        spans = base(text)
        found = [m for m in re.finditer(mention, text)]
        for k, m in enumerate(found):
            if len(m[0]) < 6:
                continue
            before = re.split(r"[ \t\n\x0b\f\r\xa0]+", text[found[k - 1].end() if k else 0 : m.start()])
            after = re.split(r"[ \t\n\x0b\f\r\xa0]+", text[m.end() : found[k + 1].start() if k + 1 < len(found) else len(text)])
            before, after = [w for w in before if w], [w for w in after if w]
            left, left2, right = (w.strip(strip).lower() for w in ((before or [""])[-1], (["", *before][-2] if before else ""), (after or [""])[0]))
            over = [(e, n) for a, n, e in spans if a < m.end() and e > m.start()]
            kind = max(over)[1] if over else None
            shape = re.sub("[A-Za-z]+", "a", re.sub("[0-9]", "9", m[0]))
            some = [("before", left, shape), ("after", shape, right)]
            some += [("left", left)] if left else []
            some += [("two", left, left2)] if left2 else []
            some += [("both", left, right)] if left and right else []
            for pattern in some:
                kinds = [x for x in (graph[pattern].get(m[0]), kind) if x is not None]
                graph[pattern][m[0]] = min(kinds) if kinds else None
            held.append((i, text, m, kind))
    seeds = {}
    for values in graph.values():
        for v, kind in values.items():
            if kind is not None:
                seeds[v] = min(kind, seeds.get(v, 9))
    fits = {0: r"[^@\s]+@[^@\s]+", 1: r"[0-9]{1,3}(\.[0-9]{1,3}){3}", 2: r"(?:[^0-9A-Za-z]*[0-9]){12,19}[^0-9A-Za-z]*", 3: r"(?:[^0-9A-Za-z]*[0-9]){7,15}[^0-9A-Za-z]*"}
    scores = {v: (kind, 1.0) for v, kind in seeds.items()}
    for _ in range(rounds):
        good = {}
        for pattern, values in graph.items():
            sums = collections.Counter()
            for v in values:
                if v in scores:
                    sums[scores[v][0]] += scores[v][1]
            good[pattern] = {kind: s / len(values) for kind, s in sums.items() if s >= 3 and s >= 0.7 * len(values)}
        new = {}
        for pattern, kinds in good.items():
            for v in graph[pattern]:
                for kind, s in kinds.items():
                    if v not in seeds and re.fullmatch(fits[kind], v):
                        new[v] = max(new.get(v, (0, -9)), (s, -kind))
        scores = {v: (kind, 1.0) for v, kind in seeds.items()} | {v: (-k, s) for v, (s, k) in new.items()}
    found = {v: kind for v, (kind, s) in scores.items() if v not in seeds and s >= 0.7}
    result = []
    for i, text in rows:
        more = {(m.start(), found[m[0]], m.end()) for j, t, m, kind in held if j == i and t == (text or "") and kind is None and m[0] in found}
        result.append((i, base(text), sorted([*base(text), *more])))
    return result


def planted(seed=31):
    """Texts with identifiers that the base rules miss, where a reader knows them by what stands around; and innocent numbers."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    phone = lambda: f"+{r.randrange(1, 9)} ({digits(3)}) 555-{digits(4)}"
    rows, hidden, innocent = [], {}, set()
    for i in range(60):
        rows.append(f"{sentence(r, 6)} phone: {phone()}, {sentence(r, 3)} my card number {luhn_number(r, True)} {sentence(r, 4)}")
    for i in range(12):
        local = r.choice([f"0{digits(2)} {digits(4)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(4)}"])
        hidden[len(rows)] = local
        rows.append(f"{sentence(r, 6)} phone: {local}, {sentence(r, 5)}")
        wrong = luhn_number(r, False)
        hidden[len(rows)] = wrong
        rows.append(f"{sentence(r, 6)} my card number {wrong} {sentence(r, 5)}")
    for i in range(40):
        innocent.add(len(rows))
        rows.append(f"{sentence(r, 5)} order {digits(r.choice([7, 8, 16]))} of {r.randrange(1900, 2030)} {r.randrange(10, 99)} {sentence(r, 5)}")
    return list(enumerate(rows)), hidden, innocent


def test_private_against_brute_force(spark):
    """Every column of the query, on texts with planted identifiers; of those nearly all are found, and innocent numbers are left."""
    from pathloom.llm import queries

    rows, hidden, innocent = planted()
    r = random.Random(40)
    rows += [(500 + k, t) for k, t in enumerate([None, "", "a@b.cc", "x@y z@w.org", "phone: " * 30, f"far\u00a0away phone:{' ' * 90}12-34-56-78", "(phone) 1234567 " * 3, f"{'w' * 5000} 123456 {'v' * 5000}", "1 " * 2000, "12 34", "\tcard\n4111 1111 1111 1112", rows[3][1]])]
    rows += [(700 + k, " ".join(r.choice(["phone:", "card", "number", "+1 222 333 4444", "555-1234", "the", "x1234567", "1.2.3.4", "9.9.9.999", "me@here.org", "me@here", ", ", "(020) 1234 5678"]) for _ in range(12))) for k in range(80)]
    rows += [rows[1], (1, "another text of that id"), (None, rows[62][1])]
    want = brute_private(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x["doc_id"], x["n_email"], x["n_ip"], x["n_card"], x["n_phone"], x["base_sha256"], x["spans"]) for x in queries.private_columns(df).collect()), key=repr)
    text = lambda spans: ",".join(f"{private.KINDS[n]}:{a}:{e}" for a, n, e in spans)
    assert got == sorted(((i, *(sum(n == k for _, n, _ in b) for k in range(4)), hashlib.sha256(text(b).encode()).hexdigest(), text(s)) for i, b, s in want), key=repr)


def test_private_discovers_planted_identifiers(spark):
    rows, hidden, innocent = planted()
    found = {x["doc_id"]: {rows[x["doc_id"]][1][s["start"] : s["end"]] for s in x["spans"] if s not in x["base"]} for x in private.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught, wrong = sum(hidden[i] in found[i] for i in hidden), sum(bool(found[i]) for i in innocent)
    print(f"planted identifiers outside the base rules: recall {caught / len(hidden):.2f}, precision {caught / max(1, sum(map(len, found.values()))):.2f}")
    assert caught >= 0.9 * len(hidden) and wrong == 0


def test_mixing(spark, docs, empty):
    rows = corpus()
    df = spark.createDataFrame([*rows, *((200 + i, sentence(random.Random(i), 40), None, "big") for i in range(60))], SCHEMA).withColumn("size", F.lit("x")).withColumn("key", F.lit(1))
    got = mixing.mix(df).collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for g in got:
        assert g["taken"] in (0, g["size"], 2 * g["size"])
        sizes[g["key"]] += g["size"]
        taken[g["key"]] += g["taken"]
        target[g["key"]] = g["target"]
        assert g["source_size"] >= g["size"]
    total, order = sum(sizes.values()), sorted(k for k in sizes if k) + [k for k in sizes if not k]
    weights = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    share, full = {}, set()
    while True:  # the excess is reshared until none is above
        left = 1.5 * total - sum(2 * sizes[k] for k in full)
        share = {k: 2 * sizes[k] if k in full else left * weights[k] / sum(weights[x] for x in order if x not in full) for k in order}
        over = {k for k in order if k not in full and share[k] > 2 * sizes[k]}
        if not over:
            break
        full |= over
    assert target == pytest.approx(share)
    for k in order:
        most = max(g["size"] for g in got if g["key"] == k)
        assert abs(taken[k] - target[k]) <= most
    again = mixing.take(df)
    assert again.columns == df.columns
    assert again.count() == sum(g["copies"] for g in got)
    assert mixing.mix(empty).count() == 0
    assert {g["size"] for g in got if g["doc_id"] in (20, 21)} == {0}


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    encode = lambda text: plain.encode(text, add_special_tokens=False).ids
    r = random.Random(15)
    points = [chr(r.choice([r.randrange(0x20, 0x300), r.randrange(0xD800), r.randrange(0xE000, 0x110000), 0x20, 0x1F, 0x85, 0xA0, 0x27])) for _ in range(30_000)]
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "a", "1", "!", "é", "S", "\t", "ſ", "’", "<|endoftext|>"]
    several = [t or "" for _, t, *_ in corpus()] + ["tabs\t\t  \n\n 'll 123 日本語 😀", "y" * 500]
    several += ["".join(points[i : i + 60]) for i in range(0, len(points), 60)] + [f"a{c}1{c}!{c}{c} {c}b  {c}" for c in points[:5000]]
    several += ["".join(r.choices(parts, k=r.randrange(14))) for _ in range(20_000)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        whole_texts = Tokenizer.from_file(str(public_tokenizers.path(name)))
        for some in (several[i : i + 700] for i in range(0, len(several), 700)):
            found, width = packing.encoder(name)(pa.array(some))
            assert [np.frombuffer(raw, f"<u{width}").tolist() for raw in found] == [e.ids for e in whole_texts.encode_batch(some, add_special_tokens=False)]
    assert packing.encoder("byte_bpe_50k.json")(pa.array([], pa.string()))[0] == []
    pieces = packing.pack(docs, length=100).collect()
    by_place = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    at = 0
    for p in by_place:
        assert p["sequence_id"] * 100 + p["offset"] == at
        at += p["length"]
        assert len(p["ids_le32"]) == 4 * p["length"] and p["ids_crc32"] == zlib.crc32(p["ids_le32"])
    whole = collections.defaultdict(list)
    for p in by_place:
        whole[p["doc_id"]] += struct.unpack(f"<{p['length']}I", p["ids_le32"])
    wanted = collections.defaultdict(list)
    for i, t, *_ in corpus():
        wanted[i] += [*encode(t or ""), 1]
    assert whole == wanted
    assert {p["doc_tokens"] for p in pieces if p["doc_id"] == 20} == {1}
    assert packing.pack(empty).count() == 0


def test_packing_keeps_no_words_in_its_second_pass():
    """Python workers live on, so what the first pass kept there would stand beside every later stage."""
    assert len(packing.encoder("byte_bpe_50k.json")(pa.array(["some words to keep"]))[0]) == 1
    assert packing.encoder.cache_info().currsize == 1
    assert list(packing._cutter({}, 8)(iter([]))) == []
    assert packing.encoder.cache_info().currsize == 0


def test_quality(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    sample = quality.sample(table, labels, per_class=100)
    assert max(len(t) for t in sample.values()) <= 100
    model = quality.fit(sample)
    scored = quality.score(table, model).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    right = sum(r["predicted"] == r["quality"] for r in scored) / len(scored)
    assert right >= 0.93
    assert quality.fit(sample) == model
    odd = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert odd[20] == odd[21] and odd[0] == odd[14] and all(0 <= s <= 1 for s in odd.values())
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.score(empty, model).count() == 0
    nothing = quality.fit(quality.sample(table, labels.limit(0)))
    assert quality.score(docs, nothing).where("score <> 0.5").count() == 0


def test_quality_by_hand(spark):
    """Scores from the model's dictionaries alone, chunk by chunk; labels that contradict each other, ids with several texts, nulls, bounds."""
    import zstandard

    r = random.Random(11)
    good = [(i, sentence(r, r.randrange(10, 300))) for i in range(60)]
    bad = [(100 + i, " ".join(r.choice(["BUY!!", "click", "$$$", "FREE"]) for _ in range(r.randrange(10, 300)))) for i in range(60)]
    rows = [*good, *bad, (200, None), (201, ""), (7, "short"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("x"))
    labels = spark.createDataFrame([*((i, 1) for i, _ in good), *((i, 0) for i, _ in bad), (7, 1), (8, 0), (200, 0), (999, 1), (None, 1), (1, 5), (2, None)], "doc_id long, quality int")
    learnt = lambda i: zlib.crc32(str(i).encode()) % 5 != 0
    sampled = quality.sample(df, labels)
    least = {}
    for i, t in rows:
        t = t or ""
        least[i] = min(least.get(i, t), t, key=lambda x: (len(x), x))
    assert sorted(sampled[1]) == sorted(least[i] for i, _ in good if learnt(i) and i != 8)
    assert sorted(sampled[0]) == sorted([least[i] for i, _ in bad if learnt(i)] + [least[i] for i in (8, 200) if learnt(i)])
    some = quality.sample(df, labels, per_class=5, most_chars=1500)
    assert all(len(v) <= 5 and sum(map(len, v)) <= 1500 for v in some.values()) and set(some[1]) <= set(sampled[1])
    model = quality.fit(sampled)
    sizes = {}
    for name in ("good", "bad"):
        known = zstandard.ZstdCompressionDict(getattr(model, name))
        pack = zstandard.ZstdCompressor(level=model.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes[name] = [sum(len(pack.compress((t or "").encode()[k : k + 256])) for k in range(0, len((t or "").encode()), 256)) for _, t in rows]
    want = []
    for (i, t), g, b in zip(rows, sizes["good"], sizes["bad"], strict=True):
        p = 1 / (1 + np.exp(-(model.slope * (b - g) / (len((t or "").encode()) + 16) + model.intercept)))
        want.append((i, None if i is None else not learnt(i), round(float(p), 9), int(p >= 0.3)))
    got = [(x["doc_id"], x["held_out"], round(x["score"], 9), x["predicted"]) for x in quality.score(df, model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[3] == (w[0] < 100) for w in want[:120]) >= 118
    kept = quality.keep(df, model)
    assert rows_of(kept, "doc_id", "text") == sorted(((i, t) for (i, t), w in zip(rows, want, strict=True) if w[3]), key=repr)


def test_quality_sample_is_whole(spark):
    text = sentence(random.Random(1), 6000)
    table = spark.createDataFrame([(i, text) for i in range(10)], "doc_id long, text string")
    found = quality.sample(table, table.select("doc_id", F.lit(1).alias("quality")))
    assert len(text) > 20_000 and found[1] and set(found[1]) == {text}


def test_null_ids(spark):
    """Rows with a null id pass the near-duplicate stage by their text, and lose personal data."""
    r = random.Random(2)
    a, b, c = (sentence(r, 60) for _ in range(3))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, b + " more"), (None, c), (7, c + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = rows_of(neardup.one_of_each(df), "doc_id", "text")
    assert {(i, t) for i, t in kept if i is not None} == {(1, a), (7, c + " more")} and len(kept) == 3
    assert [t for i, t in kept if i is None][0] in (b, b + " more")
    cards = [(i, f"{sentence(r, 5)} pay with card {luhn_number(r, True)} today") for i in range(12)]
    mails = [(None, "write to some.one@example.org now"), (None, f"pay with card {luhn_number(r, False)} today")]
    hidden = private.without_private(spark.createDataFrame(cards + mails, "doc_id long, text string")).where("doc_id IS NULL")
    assert sorted(x["text"] for x in hidden.collect()) == ["pay with card <CARD> today", "write to <EMAIL> now"]
