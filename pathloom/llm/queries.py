"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import chunking, gif, licenses, mixing, neardup, packing, private, quality, repeats, topk
from pathloom.llm.common import job, table


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(job(spark), sf_dir, "documents"))


def private_columns(docs: DataFrame) -> DataFrame:
    found = private.find_private(docs)
    kinds = F.col("base.kind")
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(private.KINDS)]
    digest = F.sha2(private.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, private.written(F.col("spans")).alias("spans"))


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_columns(table(job(spark), sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(job(spark), sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(job(spark), sf_dir, "documents")).drop("ids_le32")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(job(spark), sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(table(job(spark), sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(job(spark), sf_dir, "documents")
    return quality.score(docs, quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"))))


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = chunking.dedup_chunks(table(job(spark), sf_dir, "documents"))
    return kept.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op9_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digests(gif.media_columns(table(job(spark), sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(job(spark), sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_private": op2_private,
    "op3_topk": op3_topk,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_quality": op7_quality,
    "op8_chunk_dedup": op8_chunk_dedup,
    "op9_gif": op9_gif,
    "op10_jaccard_join": op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op1_licenses": licenses.oracle(),
    "op5_mixing": mixing.ORACLE,
    "op3_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, d.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v d ON q.place <> d.place AND len(q.v) = len(d.v)
            WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
