"""Top-k against all scores, with ties, nulls, repeated ids and other dimensions; and the pipeline's stages."""

import math
import random

import pytest

pytest.importorskip("pathloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from pathloom.llm import topk  # noqa: E402


def test_top_k(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, 0.75]) for _ in range(4)]) for i in range(200)]
    rows += [(300 + i, [0.75] * 4) for i in range(30)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [math.nan] * 4), (403, [math.inf] * 4), (404, [1.0, 2.0]), (450, [3.0, 1.0]), (500, []), (None, [1.0] * 4), (100, [0.5] * 4), (150, [0.75] * 4), (150, [0.75] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(good):
        if q % 50 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for other, (i, w) in enumerate(good) if other != at and len(w) == len(v)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    for settings in ({}, {"block": 2}, {"bins": 3}, {"spread": 1, "block": 7}):
        got = [tuple(x) for x in topk.top_k(df, **settings).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(x) for x in topk.top_k(big).orderBy("rank").collect()] == [(0, 1, 2, 76_800_000**2 + 256 * 768), (0, 2, 1, 76_800_000**2 + 256 * 512)]


def test_top_k_narrows_exactly(spark):
    """Many different scores, so that intervals are narrowed several times; widths that the number of bins does not divide."""
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) for _ in range(16)]) for i in range(400)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for q, v in whole[::50]:
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for bins in (256, 10, 2):
        assert sorted(tuple(x) for x in topk.top_k(df, bins=bins, block=50).collect()) == sorted(want)


def test_top_k_of_large_components(spark):
    """Components and scores beyond 2^61 count as 2^61."""
    rows = [(0, [1e12, 2.0]), (0, [1e12, 2.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [1.0, 1.0]), (4, [1e308, 1e308])]
    got = [tuple(x) for x in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("vec_id", "rank").collect()]
    most = 2**61
    small = int(256e12) * 256 + 512 * 256
    per_query = [(0, 1, 0, most), (0, 2, 1, most), (0, 3, 4, most), (0, 4, 3, small), (0, 5, 2, -most)]
    assert sorted(got) == sorted(per_query * 2)


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("extra", F.col("doc_id") * 2)
    columns, before = docs.columns, docs.count()
    for number, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, d).write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns == columns
        now = docs.count()
        assert 0 < now <= (before if number < 3 else 2 * before)
        assert docs.where("extra <> doc_id * 2").count() == 0
        before = now
        if number == 1:
            assert docs.select("doc_id").distinct().count() == now
        if number == 2:
            assert docs.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9]+\.[A-Za-z]")).count() == 0 and docs.where("length(text) <> n_chars").count() == 0
    pieces = pipeline.pack_sequences(spark, docs, d)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert pieces.where("start = 0").count() == before


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, one id for two texts, and columns named as the operators' own."""
    r = random.Random(5)
    words = "the of and rain stone river cloud light winter under over paper music north seven small green quiet table window".split()
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    one, two = text(80), text(80)
    rows = [(1, one, "en", "a"), (1, two, "en", "a"), (2, one, None, "b"), (2, one, None, "b"), (None, one + " more", "de", None), (None, text(50), None, None), (3, None, None, "a"), (4, "", None, None), (5, text(30_000), "en", "b"), (6, "write to me@example.org or +1 (222) 333-4444 " + text(40), "en", "a")]
    rows += [(10 + k, text(60), "en", "b") for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    for name in ("key", "id", "row", "__id", "__key", "__hash", "hash", "spans", "root", "draw", "score", "first", "ids", "n", "part", "quality"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, rows):
    """Each stage on its own input, written and read again: what it keeps, by a plain model."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import collections
    import zlib

    from pathloom.llm import mixing, neardup, private, quality

    odd = odd_documents(spark)
    (odd if rows == "odd" else odd.limit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, 1), (11, 0)] if rows == "odd" else [], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counted = lambda df: collections.Counter((x["doc_id"], x["text"]) for x in df.collect())
    for number, (name, stage) in enumerate(pipeline.STAGES[:-1]):
        before = counted(docs)
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / str(number)))
        after_df = spark.read.parquet(str(tmp_path / str(number)))
        after = counted(after_df)
        assert after_df.columns == odd.columns and after_df.where("`__hash` <> '__hash' OR `__id` <> '__id' OR row <> 'row'").count() == 0
        if name == "quality classifier":
            scores = quality.score(docs, quality.fit(quality.sample(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))))
            assert sum(after.values()) == scores.where("predicted = 1").count()
        if name == "near-duplicates":
            classes = neardup.jaccard_join(docs)
            worded = {x for x in before if x[1]}
            assert all(after[x] == before[x] for x in before if not x[1]) and all(after[x] <= 1 for x in worded)
            if rows == "odd":
                lost = [x for x in worded if not after[x]]
                assert sorted((i for i, _ in lost), key=repr) == [2, None] and classes.count() == sum(before.values())
        if name == "personal data":
            assert sum(after.values()) == sum(before.values())
            if rows == "odd":
                (hidden,) = [t for i, t in after if i == 6]
                assert hidden.startswith("write to <EMAIL> or <PHONE>")
                assert after_df.where("length(text) <> n_chars").count() == 0
            assert private.find_private(after_df).where("size(base) > 0").count() == 0
        if name == "source mix":
            copies = collections.Counter()
            for x in mixing.mix(docs).collect():
                copies[x["doc_id"]] += x["copies"]
            have = collections.Counter()
            for (i, _), n in after.items():
                have[i] += n
            assert have == +copies
        docs = after_df
    pieces = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    at = 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["sequence_id"] * 2048 + p["offset"] == at
        at += p["length"]
    assert sum(p["start"] == 0 for p in pieces) == docs.count()
    if rows == "odd":
        end = zlib.crc32((1).to_bytes(4, "little"))
        assert {p["ids_crc32"] for p in pieces if p["doc_tokens"] == 1} <= {end}
