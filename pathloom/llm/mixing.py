"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash. Of each source the mix takes the rows below a hash threshold, so a
larger budget takes a superset of a smaller one's rows (nested), nothing is sorted and reruns agree. To find the
threshold, tokens are summed by source and the hash's first ten bits; only the bucket in which the budget
runs out is refined by the next ten bits, and so on until it holds a single hash. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
BITS, STEP = 60, 10
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words: runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(*columns: Column, seed: str = "mix") -> Column:
    """A 60-bit hash of the columns, null unlike empty, the same on every system."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """key, source, source_size and target of each source, from one row (key, source, source_size) each.

    Sources in code point order, null last, weigh ``weights`` in turn. Together they get ``share`` of all sizes, none more than
    ``most`` times its own: sources are filled in the order in which they meet that limit, and what is left is
    split by weight among the others, which is where resharing the excess ends.
    """
    sizes, last = cut(sizes), F.col("source").isNull()
    ranked = running(sizes, [last, F.col("source")], {"before": F.lit(1)})
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("before").cast("long"), F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("weight", cycle.cast("double")).withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    filled = running(limited.drop("before"), [F.col("ratio"), last, F.col("source")], {"limits": F.col("limit"), "weights": F.col("weight")})
    sums = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share) * F.lit(sums[0]) - F.col("limits")) / (F.lit(sums[1]) - F.col("weights"))
    # The level rises with each source that is filled and falls after the first that isn't, so the highest is the one at which filling ends.
    highest = F.lit(filled.agg(F.max(level)).first()[0])
    return filled.select("key", "source", "source_size", F.least(F.col("weight") * highest, F.col("limit")).alias("target"))


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with, for each of ``sums``, its total over the rows before, in an order that tells all rows apart.

    Rows are dealt out by ranges of the order, summed within a range, and the ranges' totals (one row each) added in turn.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id())
    ranged = cut(ranged.withColumns({f"__{n}": c.cast("double") for n, c in sums.items()}))
    totals = ranged.groupBy("__range").agg(*(F.sum(f"__{n}").alias(f"__base_{n}") for n in sums)).collect()
    bases, so_far = [], [0.0] * len(sums)
    for row in sorted(totals):
        bases.append((row[0], *so_far))
        so_far = [a + b for a, b in zip(so_far, row[1:], strict=True)]
    known = rows.sparkSession.createDataFrame(bases, "__range int, " + ", ".join(f"__base_{n} double" for n in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumns({f"__{n}": F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0.0)) for n in sums})
    return summed.join(F.broadcast(known), "__range").select(*rows.columns, *((F.col(f"__{n}") + F.col(f"__base_{n}")).alias(n) for n in sums))


def source_key(source: Column) -> Column:
    """A source as a string that is never null; null is unlike any other."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("key"), F.col(source_col).cast("string").alias("source"),
                       draw(F.col(id_col), F.col(text_col)).alias("draw"), size_of(F.col(text_col)).alias("size"))


def thresholds(rows: DataFrame) -> DataFrame:
    """For each source: key, source_size, target, whole (how often all of it is taken), edge and edge_taken."""
    sources = targets(rows.groupBy("key", "source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(2))).otherwise(F.lit(0)).cast("int")
    sources = cut(sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    known = sources.drop("source", "rest").join(_thresholds(rows, sources), "key", "left")
    return F.broadcast(known) if sources.count() <= BROADCAST_SOURCES else known


def copies(draw_: Column) -> Column:
    """How often a row is taken, beside its source's threshold."""
    more = F.coalesce((draw_ < F.col("edge")) | ((draw_ == F.col("edge")) & F.col("edge_taken")), F.lit(False))
    return F.col("whole") + more.cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, key (its source's), draw, size, source_size, target, copies (0, 1 or 2) and taken, for every row.

    Whole rows are taken: all of a source as often as its target holds it, and the rows below its threshold once more. The row
    at the threshold is taken if that comes nearer to the target. A null text has size 0, a null source is a
    source. Rows equal in id and text share a hash and are taken alike. An empty table gives no rows.
    """
    rows = cut(drawn(docs, id_col, text_col, source_col))
    mixed = rows.join(thresholds(rows), "key").withColumn("copies", copies(F.col("draw")))
    return mixed.select("doc_id", "key", "draw", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, with all their columns, as often as they are taken."""
    known = thresholds(cut(drawn(docs, id_col, text_col, source_col))).select(F.col("key").alias("__key"), "whole", "edge", "edge_taken")
    keyed = docs.select(F.struct("*").alias("__row"), source_key(F.col(source_col)).alias("__key"), draw(F.col(id_col), F.col(text_col)).alias("__draw"))
    return keyed.join(known, "__key").select("__row", F.explode(F.array_repeat(F.lit(0), copies(F.col("__draw"))))).select("__row.*")


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """key, edge (the hash at which the source's rest runs out) and edge_taken."""
    open_ = sources.where(F.col("rest") > 0).select("key", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    shift = BITS
    while True:
        inside = rows.where(F.col("size") > 0).withColumn("prefix", F.shiftright("draw", shift))
        if shift < BITS:  # at first every row is inside
            inside = inside.join(open_, ["key", "prefix"], "left_semi")
        shift -= STEP
        histogram = inside.groupBy("key", F.shiftright("draw", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("draw").alias("least"), F.max("draw").alias("greatest"))
        histogram = histogram.join(open_.drop("prefix"), "key")
        so_far = Window.partitionBy("key").orderBy("bucket")
        summed = histogram.withColumn("upto", F.col("below") + F.sum("size").over(so_far)).where(F.col("upto") > F.col("rest"))
        edge = summed.groupBy("key").agg(F.min_by(F.struct("bucket", "rest", "size", "upto", "least", "greatest"), "bucket").alias("e")).select("key", "e.*")
        edge = cut(edge.withColumn("below", F.col("upto") - F.col("size")))
        if shift == 0 or not edge.where("least < greatest").head(1):
            return edge.select("key", F.col("least").alias("edge"), (F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")).alias("edge_taken"))
        open_ = edge.select("key", "rest", F.col("bucket").alias("prefix"), "below")


ORACLE = r"""
    WITH d AS (
        SELECT doc_id, source,
               CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
               CAST('0x' || substr(md5('mix:' || coalesce('=' || CAST(doc_id AS VARCHAR), '') || ':' || coalesce('=' || text, '')), 1, 15) AS BIGINT) AS draw
        FROM documents
    ), s AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS most,
               CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
        FROM d GROUP BY source
    ), l AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
                  / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
        FROM s WINDOW before AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ), t AS (
        SELECT source, source_size, least(weight * max(level) OVER (), most) AS target
        FROM l
    ), w AS (
        SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2) ELSE 0 END AS whole FROM t
    ), r AS (
        SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
               sum(d.size) OVER (PARTITION BY d.source ORDER BY draw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
               sum(d.size) OVER (PARTITION BY d.source, draw) AS tied
        FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
    )
    SELECT doc_id, size, source_size, target,
           CAST((whole + CASE WHEN rest <= 0 THEN 0 WHEN upto <= rest THEN 1
                              WHEN upto - tied <= rest AND upto - rest < rest - (upto - tied) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
    FROM r
"""
