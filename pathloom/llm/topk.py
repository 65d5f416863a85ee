"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks of rows, queries into blocks of queries, and blocks of the same dimension meet in a join that
is dealt out over ``spread`` shares of the rows: every share sees every query block, no row travels twice. A
round is one job: each task scores its pairs of blocks as matrices and counts the scores in a
histogram over the interval in which the query's kth score must lie. The summed histograms narrow the interval by their number
of bins, until it is one score wide or holds no more rows than are wanted; the intervals are kept with the query
blocks, so the driver holds nothing that grows with the queries. A last pass keeps the rows at or above
that score; each task keeps its best of them by (score, id), which loses nothing, and a window over those few
ranks them. A task reports only bins at or above its own kth score: the global kth cannot be lower.

A query's own row is a candidate like any other until the end: one more than k rows are selected, and one that equals the
query in id and vector is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import batches, cut

EXACT = float(2**53)
#: Components and scores beyond count as this much.
LIMIT = 2**61
STATE = ("low", "high", "width", "wanted", "least", "open")


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with an id and a vector free of nulls and non-finite components."""
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def quantize(column: pa.Array, scale: float) -> list[np.ndarray]:
    """floor(scale * component) of each row, within LIMIT."""
    offsets = np.asarray(column.offsets)
    with np.errstate(over="ignore"):
        values = np.clip(np.floor(scale * np.asarray(column.values, dtype=np.float64)), -float(LIMIT), float(LIMIT))
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def products(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, within LIMIT: by floating point where that is exact, else by Python's integers."""
    if rows.size == 0 or queries.size == 0 or np.abs(rows).max() * np.abs(queries).max() * rows.shape[1] < EXACT:
        return (rows @ queries.T).astype(np.int64)
    exact = [[int(x) for x in r] for r in queries.tolist()]
    return np.array([[max(-LIMIT, min(LIMIT, sum(int(a) * b for a, b in zip(r, q, strict=True)))) for q in exact] for r in rows.tolist()], dtype=np.int64)


def packed(rows: DataFrame, size: int, scale: float, columns: tuple[str, ...]) -> DataFrame:
    """Blocks of up to ``size`` rows of one dimension: block (a number), dim, n, norm (the greatest), vectors, and the other columns as arrays of longs."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}

        def block(dim: int, some: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            matrix = np.array([v for v, *_ in some], np.float64).reshape(len(some), dim)
            number += 1
            norm = float(np.sqrt((matrix**2).sum(axis=1)).max())
            arrays = [pa.array([np.array([s[k + 1] for s in some], np.int64).tobytes()], pa.binary()) for k in range(len(columns))]
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([dim], pa.int32()), pa.array([len(some)], pa.int32()), pa.array([norm]), pa.array([matrix.tobytes()], pa.binary()), *arrays], names=["block", "dim", "n", "norm", "vectors", *columns])

        for batch in batches(parts):
            for vector, *rest in zip(quantize(batch.column("vector"), scale), *(batch.column(c).to_pylist() for c in columns), strict=True):
                some = held.setdefault(len(vector), [])
                some.append((vector, *rest))
                if len(some) == size:
                    yield block(len(vector), held.pop(len(vector)))
        for dim, some in held.items():
            yield block(dim, some)

    return rows.mapInArrow(run, "block long, dim int, n int, norm double, vectors binary, " + ", ".join(f"{c} binary" for c in columns))


def matrix(row: dict, name: str = "vectors") -> np.ndarray:
    return np.frombuffer(row[name], np.float64).reshape(-1, row["dim"]) if row["dim"] else np.zeros((row["n"], 0))


def longs(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = 2048, bins: int = 256, spread: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, the k best other rows.

    Ties go to the smaller id; fewer rows than k give fewer ranks. Rows whose id, vector or a component is null, or
    a component not finite, take no part. Vectors of another dimension than the query's are no candidates. Rows that
    repeat an id are queries and candidates each for itself, so a query finds the other rows of its id, and a repeated
    query is answered as often. Components and scores beyond 2^61 count as 2^61. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector_col)
    spread = spread or int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = cut(packed(rows, block, scale, ("vec_id",)))
    held = held.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(spread)))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("copies"))
    queries = cut(packed(asked, block, scale, ("vec_id", "copies")).withColumnsRenamed({"vec_id": "query_id", "vectors": "query", "n": "queries", "norm": "query_norm", "block": "q"}))
    longest = held.agg(F.max("norm")).first()[0] or 0.0
    state = cut(queries.select("q", "query_norm", "query", "dim", "queries").mapInArrow(_begin(longest, bins, k + 1), "q long, " + ", ".join(f"{c} binary" for c in STATE) + ", waiting long"))
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))).alias("share")

    def pairs(state: DataFrame) -> DataFrame:
        spread_out = queries.join(state, "q").select("*", shares)
        return held.join(spread_out, ["dim", "share"]).drop("share", "norm", "query_norm", "waiting", "copies", "block")

    while state.agg(F.sum("waiting")).first()[0]:
        counts = pairs(state.where("waiting > 0")).mapInArrow(_counter(bins, k + 1), "q long, query int, bin int, n long").groupBy("q", "query", "bin").agg(F.sum("n").alias("n"))
        open_ = state.where("waiting > 0")
        narrowed = open_.groupBy("q").cogroup(counts.groupBy("q")).applyInArrow(_narrower(bins), state.schema)
        state = cut(narrowed.unionByName(state.where("waiting = 0")))
    found = pairs(state).mapInArrow(_keeper(k + 1), "q long, query int, query_id long, vec_id long, score long, own boolean")
    own = found.withColumn("own", F.col("own") & (F.row_number().over(Window.partitionBy("q", "query", "own").orderBy("vec_id")) == 1))
    order = Window.partitionBy("q", "query").orderBy(F.desc("score"), "vec_id")
    # The selected rows hold the best k + 1 with the query's own, unless k + 1 others precede it.
    ranked = own.where(~F.col("own")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    copies = queries.select("q", "copies").mapInArrow(_copies, "q long, query int, copies long")
    return ranked.join(copies, ["q", "query"]).select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def _copies(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the queries that come more than once or once: how often."""
    for batch in parts:
        for row in batch.to_pylist():
            copies = longs(row["copies"])
            yield pa.RecordBatch.from_arrays([pa.array([row["q"]] * len(copies), pa.int64()), pa.array(range(len(copies)), pa.int32()), pa.array(copies)], names=["q", "query", "copies"])


def _state(rows: list[tuple]) -> pa.RecordBatch:
    """q and the arrays of STATE of each block, as a batch."""
    columns = [pa.array([r[0] for r in rows], pa.int64())]
    columns += [pa.array([np.asarray(r[k + 1], np.int64).tobytes() for r in rows], pa.binary()) for k in range(len(STATE))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([int(np.sum(r[6])) for r in rows], pa.int64())], names=["q", *STATE, "waiting"])


def _begin(longest: float, bins: int, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for row in batch.to_pylist():
                norms = np.sqrt((matrix(row, "query").reshape(row["queries"], -1) ** 2).sum(axis=1)) if row["dim"] else np.zeros(row["queries"])
                bound = np.minimum(np.ceil(norms * longest) + 1, float(LIMIT)).astype(np.int64)
                rows.append((row["q"], -bound, bound + 1, -(-(2 * bound + 1) // bins), np.full(len(bound), k), -bound, np.ones(len(bound))))
            if rows:
                yield _state(rows)

    return run


def _scored(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """For each pair of blocks: the pair, the rows' ids, the scores (rows by queries), and where a row equals the query in id and vector."""
    for i in range(batch.num_rows):
        row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
        rows = matrix(row)
        queries = np.frombuffer(row["query"], np.float64).reshape(row["queries"], -1) if row["dim"] else np.zeros((row["queries"], 0))
        ids, query_ids = longs(row["vec_id"]), longs(row["query_id"])
        own = ids[:, None] == query_ids[None, :]
        for a, b in zip(*np.nonzero(own), strict=True):
            own[a, b] = np.array_equal(rows[a], queries[b])
        yield row, ids, products(rows, queries), own


def _counter(bins: int, k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for q, flat in held.items():
                counts = flat.reshape(-1, bins)
                higher = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
                query, at = np.nonzero((counts > 0) & (higher < k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(query), q)), pa.array(query, pa.int32()), pa.array(at, pa.int32()), pa.array(counts[query, at], pa.int64())], names=["q", "query", "bin", "n"])
            held.clear()

        for batch in batches(parts):
            for row, _, scores, _ in _scored(batch):
                low, high, width, open_ = (longs(row[c]) for c in ("low", "high", "width", "open"))
                index = (scores - low) // width
                counted = (scores >= low) & (scores < high) & (open_ > 0)
                if row["q"] not in held and len(held) == 8:
                    yield from told()
                flat = (np.arange(len(low)) * bins + index)[counted]
                held[row["q"]] = held.get(row["q"], 0) + np.bincount(flat, minlength=len(low) * bins)
        yield from told()

    return run


def _narrower(bins: int):
    def run(state: pa.Table, told: pa.Table) -> pa.Table:
        row = state.to_pylist()[0]
        low, high, width, wanted, least, open_ = (longs(row[c]).copy() for c in STATE)
        counts = np.zeros((len(low), bins), np.int64)
        counts[np.asarray(told.column("query")), np.asarray(told.column("bin"))] = np.asarray(told.column("n"))
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # rows in this bin or a higher one
        for i in np.flatnonzero(open_):
            enough = np.flatnonzero(above[i] >= wanted[i])
            if not len(enough):  # fewer rows than are wanted: all of them
                least[i], open_[i] = low[i], 0
                continue
            at = int(enough[-1])
            least[i] = low[i] + at * width[i]
            if width[i] == 1 or above[i, at] == wanted[i]:
                open_[i] = 0
                continue
            wanted[i] -= above[i, at] - counts[i, at]
            low[i], high[i], width[i] = least[i], least[i] + width[i], -(-width[i] // bins)
        return pa.Table.from_batches([_state([(row["q"], low, high, width, wanted, least, open_)])])

    return run


def _keeper(k: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query", "score", "vec_id", "own"]
        held: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for q, (query_ids, best) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best["query"]), q)), pa.array(best["query"], pa.int32()), pa.array(query_ids[best["query"]]), pa.array(best["vec_id"], pa.int64()), pa.array(best["score"], pa.int64()), pa.array(best["own"].astype(bool))], names=["q", "query", "query_id", "vec_id", "score", "own"])
            held.clear()

        for batch in batches(parts):
            for row, ids, scores, own in _scored(batch):
                if row["q"] not in held:
                    if len(held) == 64:
                        yield from told()
                    held[row["q"]] = longs(row["query_id"]), {n: np.zeros(0, np.int64) for n in names}
                a, b = np.nonzero(scores >= longs(row["least"]))
                query_ids, best = held[row["q"]]
                new = {"query": b, "score": scores[a, b], "vec_id": ids[a], "own": own[a, b]}
                best = {n: np.concatenate([best[n], new[n]]) for n in names}
                order = np.lexsort((best["vec_id"], -best["score"], best["query"]))
                best = {n: v[order] for n, v in best.items()}
                kept = np.arange(len(order)) - np.searchsorted(best["query"], best["query"]) < k
                held[row["q"]] = query_ids, {n: v[kept] for n, v in best.items()}
        yield from told()

    return run
