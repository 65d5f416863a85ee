"""The registered queries: graphs over the driver's tables, each with the SQL that must give the same rows.

Node ids number the tables in turn (customers 4k, orders 4k + 1, suppliers 4k + 2, regions and nations below zero-based
blocks of their own); edge ids are made of keys, so nothing has to be sorted for them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.expr import col, concat_list, element, lit, when
from pathloom.graph import DiGraph, Graph
from pathloom.operators import topology
from pathloom.plans.lineage import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What a path may spend: an order's price and a line's, which lets about half of the lines through.
BUDGET = 250_000


def query(sql: str) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def supply(spark: SparkSession, sf_dir: str, lines: bool = True, of: type[Graph] = Graph) -> Graph:
    """customer -> order (price: the order's) and order -> supplier (price: the line's). Keys are trusted."""
    customers, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    nodes = customers.select((F.col("c_custkey") * 4).alias("id"), F.lit("customer").alias("kind")).unionByName(orders.select((F.col("o_orderkey") * 4 + 1).alias("id"), F.lit("order").alias("kind")))
    edges = orders.select((F.col("o_orderkey") * 1024).alias("id"), (F.col("o_custkey") * 4).alias("src"), (F.col("o_orderkey") * 4 + 1).alias("dest"), F.col("o_totalprice").alias("price"), F.lit(0).cast("bigint").alias("quantity"))
    if lines:
        # The first columns of the table number the lines; lines that agree in these are the same edge but for the number.
        items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
        number = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*items.columns))
        nodes = nodes.unionByName(read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 4 + 2).alias("id"), F.lit("supplier").alias("kind")))
        edges = edges.unionByName(items.select(
            (F.col("l_orderkey") * 1024 + F.col("l_linenumber") * 64 + number).alias("id"), (F.col("l_orderkey") * 4 + 1).alias("src"), (F.col("l_suppkey") * 4 + 2).alias("dest"),
            F.col("l_extendedprice").alias("price"), F.col("l_quantity").cast("bigint").alias("quantity")))
    return of(nodes, edges, validate=False)


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """region -> nation -> customer -> order: nodes 8k + 0, 1, 2, 3."""
    region, nation, customer, orders = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))

    def ids(df: DataFrame, key: str, kind: int) -> DataFrame:
        return df.select((F.col(key).cast("bigint") * 8 + kind).alias("id"))

    def links(df: DataFrame, parent: str, child: str, kind: int) -> DataFrame:
        return df.select((F.col(child).cast("bigint") * 8 + kind + 1).alias("id"), (F.col(parent).cast("bigint") * 8 + kind).alias("src"), (F.col(child).cast("bigint") * 8 + kind + 1).alias("dest"))

    nodes = ids(region, "r_regionkey", 0).unionByName(ids(nation, "n_nationkey", 1)).unionByName(ids(customer, "c_custkey", 2)).unionByName(ids(orders, "o_orderkey", 3))
    edges = links(nation, "n_regionkey", "n_nationkey", 0).unionByName(links(customer, "c_nationkey", "c_custkey", 1)).unionByName(links(orders, "o_custkey", "o_orderkey", 2))
    return Graph(nodes, edges, validate=False)


GEOGRAPHY = """
    geo AS (
        SELECT n_regionkey * 8 AS src, n_nationkey * 8 + 1 AS dest FROM nation
        UNION ALL SELECT c_nationkey * 8 + 1, c_custkey * 8 + 2 FROM customer
        UNION ALL SELECT o_custkey * 8 + 2, o_orderkey * 8 + 3 FROM orders
    )"""
SUPPLY = """
    first AS (SELECT o_custkey * 4 AS c, o_orderkey * 4 + 1 AS o, o_orderkey * 1024 AS e, o_totalprice AS p FROM orders),
    second AS (
        SELECT l_orderkey * 4 + 1 AS o, l_suppkey * 4 + 2 AS s, l_extendedprice AS p, CAST(l_quantity AS BIGINT) AS q,
               l_orderkey * 1024 + l_linenumber * 64 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                   ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS e
        FROM lineitem
    )"""


def joined(values: str | Column) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ">")


def customers_of(graph: Graph) -> DataFrame:
    return graph.nodes.where("kind = 'customer'").select("id")


def spending(graph: Graph, **options):
    spent = col("state.spent") + col("edge.price")
    return graph.search(start_nodes=customers_of(graph), visit=spent <= BUDGET, next_state={"spent": spent}, stop=col("dest.kind") == "supplier", initial_state={"spent": 0.0}, max_depth=2, **options)


@query(f"""WITH {SUPPLY}
    SELECT c || '>' || a.o || '>' || s AS nodes, a.e || '>' || b.e AS edges, round(a.p + b.p, 2) AS spent
    FROM first a JOIN second b USING (o) WHERE 0.0 + a.p <= {BUDGET} AND 0.0 + a.p + b.p <= {BUDGET}""")
def budget_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every way from any customer over an order to a supplier within the budget."""
    found = spending(supply(spark, sf_dir)).frame()
    return found.select(joined("nodes").alias("nodes"), joined("edges").alias("edges"), F.round("state.spent", 2).alias("spent"))


@query(f"""WITH {SUPPLY}
    SELECT c || '>' || a.o || '>' || s AS nodes, round(a.p + b.p, 2) AS spent
    FROM first a JOIN second b USING (o) WHERE 0.0 + a.p <= {BUDGET} AND 0.0 + a.p + b.p <= {BUDGET}
    ORDER BY c DESC, a.e DESC, b.e LIMIT 100""")
def search_dfs_first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred paths in depth-first order."""
    found = spending(supply(spark, sf_dir), max_paths=100).frame()
    return found.select(joined("nodes").alias("nodes"), F.round("state.spent", 2).alias("spent"))


@query(f"""WITH {SUPPLY}
    SELECT c || '>' || a.o || '>' || s AS nodes, round(a.p + b.p, 2) AS spent
    FROM first a JOIN second b USING (o) WHERE 0.0 + a.p <= {BUDGET} AND 0.0 + a.p + b.p <= {BUDGET}
    ORDER BY c, a.e, b.e LIMIT 100""")
def search_bfs_first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred paths in breadth-first order."""
    found = spending(supply(spark, sf_dir), max_paths=100, strategy="bfs").frame()
    return found.select(joined("nodes").alias("nodes"), F.round("state.spent", 2).alias("spent"))


@query(f"""WITH {SUPPLY}, one AS (SELECT count(*) AS n, count(*) FILTER (0.0 + p <= {BUDGET}) AS ok FROM first),
    two AS (SELECT count(*) AS n, count(*) FILTER (0.0 + a.p + b.p <= {BUDGET}) AS ok FROM first a JOIN second b USING (o) WHERE 0.0 + a.p <= {BUDGET})
    SELECT (SELECT count(*) FROM customer) AS start_nodes, (SELECT count(*) FROM customer) + one.ok + two.ok AS path_entries, one.n + two.n AS evaluated_edges,
           one.ok + two.ok AS accepted_edges, one.n + two.n - one.ok - two.ok AS rejected_edges, two.ok AS stopped_paths, CAST(0 AS BIGINT) AS skipped_revisits, CAST(2 AS BIGINT) AS max_depth
    FROM one, two""")
def search_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = vars(spending(supply(spark, sf_dir)).stats)
    names = ("start_nodes", "path_entries", "evaluated_edges", "accepted_edges", "rejected_edges", "stopped_paths", "skipped_revisits", "max_depth")
    return spark.createDataFrame([tuple(stats[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query(f"""WITH {SUPPLY}
    SELECT c || '>' || a.o || '>' || s AS nodes, '0.0>' || round(a.p, 2) || '>' || round(a.p + b.p, 2) AS history
    FROM first a JOIN second b USING (o) WHERE 0.0 + a.p <= {BUDGET} AND 0.0 + a.p + b.p <= {BUDGET}""")
def search_intermediate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spending(supply(spark, sf_dir), intermediate_states=True).frame()
    return found.select(joined("nodes").alias("nodes"), joined(F.transform("states", lambda s: F.round(s["spent"], 2))).alias("history"))


@query(f"""WITH {SUPPLY}
    SELECT c || '>' || a.o || '>' || s AS nodes, b.q AS spent FROM first a JOIN second b USING (o) WHERE s = 6 AND b.q <= 25""")
def named_kernel_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of at most 25 pieces from any customer to supplier 1."""
    graph = supply(spark, sf_dir)
    found = graph.search(start_nodes=customers_of(graph), kernel="weighted_budget", params={"weight_col": "quantity", "budget": 25, "target": 6}, max_depth=2).frame()
    return found.select(joined("nodes").alias("nodes"), F.col("state.spent").alias("spent"))


@query("""SELECT (a.o_orderkey * 4 + 1) || '>' || (a.o_custkey * 4) || '>' || (b.o_orderkey * 4 + 1) AS nodes, (a.o_orderkey * 1024) || '>' || (b.o_orderkey * 1024) AS edges
    FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE b.o_totalprice < a.o_totalprice""")
def digraph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every order to the cheaper orders of the same customer, over edges taken either way."""
    graph = supply(spark, sf_dir, lines=False, of=DiGraph)
    found = graph.search(start_nodes=graph.nodes.where("kind = 'order'").select("id"), visit=(col("dest.kind") == "customer") | (col("edge.price") < col("state.first")), next_state={"first": when(col("dest.kind") == "customer").then(col("edge.price")).otherwise(col("state.first"))},
                         stop=col("dest.kind") == "order", initial_state={"first": 0.0}, max_depth=2).frame()
    return found.select(joined("nodes").alias("nodes"), joined("edges").alias("edges"))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """event type -> the type of the same user's next event, with how often."""
    following = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = read(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(following).alias("dest")).where("dest IS NOT NULL")
    edges = steps.groupBy("src", "dest").agg(F.count(F.lit(1)).alias("n")).withColumn("id", F.concat_ws("-", "src", "dest"))
    return Graph(read(spark, sf_dir, "events").select(F.col("event_type").alias("id")).distinct(), edges)


@query("""WITH RECURSIVE e AS (
        SELECT src, dest, count(*) AS n FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dest FROM events) WHERE dest IS NOT NULL GROUP BY src, dest
    ), p AS (
        SELECT DISTINCT [event_type] AS nodes, CAST(0 AS BIGINT) AS total, 0 AS depth FROM events
        UNION ALL
        SELECT list_append(p.nodes, e.dest), p.total + e.n, p.depth + 1 FROM p JOIN e ON p.nodes[-1] = e.src WHERE p.depth < 3 AND len(list_filter(p.nodes, lambda x: x = e.dest)) <= 1
    ) SELECT array_to_string(nodes, '>') AS nodes, CAST(total AS BIGINT) AS total FROM p WHERE depth = 3""")
def revisit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of three steps between event types that come back to a type at most once."""
    graph = transitions(spark, sf_dir)
    found = graph.search(start_nodes=graph.nodes.select("id"), next_state={"total": col("state.total") + col("edge.n"), "steps": col("state.steps") + 1}, stop=col("state.steps") == 3, initial_state={"total": 0, "steps": 0}, max_depth=3, max_revisits_per_node=1).frame()
    return found.select(F.array_join("nodes", ">").alias("nodes"), F.col("state.total").alias("total"))


DEGREES = """WITH {supply}, e AS (SELECT c AS src, o AS dest FROM first UNION ALL SELECT o, s FROM second),
    n AS (SELECT c_custkey * 4 AS id FROM customer UNION ALL SELECT o_orderkey * 4 + 1 FROM orders UNION ALL SELECT s_suppkey * 4 + 2 FROM supplier),
    d AS (SELECT id, count(*) AS k FROM ({ends}) GROUP BY id)
    SELECT n.id, CAST(coalesce(k, 0) AS BIGINT) AS degree FROM n LEFT JOIN d USING (id)"""


@query(DEGREES.format(supply=SUPPLY, ends="SELECT src AS id FROM e"))
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).degrees_frame("src").select("id", "degree")


@query(DEGREES.format(supply=SUPPLY, ends="SELECT dest AS id FROM e"))
def in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).degrees_frame("dest").select("id", "degree")


@query(DEGREES.format(supply=SUPPLY, ends="SELECT src AS id FROM e UNION ALL SELECT dest FROM e"))
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).degrees_frame().select("id", "degree")


def region_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("source"), (F.col("r_regionkey").cast("bigint") * 8).alias("node"))


@query(f"""WITH RECURSIVE {GEOGRAPHY}, b AS (
        SELECT CAST(r_regionkey AS BIGINT) AS source, CAST(r_regionkey * 8 AS BIGINT) AS node, 0 AS depth FROM region
        UNION ALL SELECT source, CAST(dest AS BIGINT), depth + 1 FROM b JOIN geo ON node = src
    ) SELECT source, node, min(depth) AS depth FROM b GROUP BY source, node""")
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many steps each region is from everything it reaches: all regions in one batch."""
    graph = geography(spark, sf_dir)
    return topology.bfs(topology.out_links(graph.edges), region_ids(spark, sf_dir), ordered=False).select("source", "node", "depth")


@query(f"""WITH RECURSIVE {GEOGRAPHY}, b AS (
        SELECT CAST(r_regionkey * 8 AS BIGINT) AS node, 0 AS depth FROM region WHERE r_regionkey = 0
        UNION ALL SELECT CAST(dest AS BIGINT), depth + 1 FROM b JOIN geo ON node = src
    ) SELECT node FROM b WHERE depth <= 2""")
def reachable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What region 0 reaches in two steps."""
    return geography(spark, sf_dir).bfs_frame([0], max_depth=2, ordered=False).select("node")


@query("""SELECT (r_regionkey * 8) || '>' || (n_nationkey * 8 + 1) || '>' || (c_custkey * 8 + 2) || '>' || (o_orderkey * 8 + 3) AS path
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey""")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest path from its region to each order."""
    graph = geography(spark, sf_dir)
    found = topology.bfs(topology.out_links(graph.edges), region_ids(spark, sf_dir), paths=True, ordered=False)
    return found.where("node % 8 = 3").select(joined("path").alias("path"))


@query(f"""WITH RECURSIVE {GEOGRAPHY}, b AS (
        SELECT CAST(0 AS BIGINT) AS node, [CAST(0 AS BIGINT)] AS trail UNION ALL SELECT CAST(dest AS BIGINT), list_append(trail, CAST(dest AS BIGINT)) FROM b JOIN geo ON node = src
    ) SELECT node, row_number() OVER (ORDER BY trail) - 1 AS place FROM b""")
def dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first order from region 0; in a tree that is the order of the ways to the nodes."""
    return geography(spark, sf_dir).dfs_frame(0)


@query("""SELECT c_custkey * 4 AS id, least(c_custkey * 4, min(o_orderkey * 4 + 1)) AS root FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
    UNION ALL SELECT o_orderkey * 4 + 1, least(o_custkey * 4, min(o_orderkey * 4 + 1) OVER (PARTITION BY o_custkey)) FROM orders""")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their orders; the root is the least id."""
    return supply(spark, sf_dir, lines=False).components_frame().select("id", "root")


def one_step(nodes: DataFrame, states: dict) -> DataFrame:
    """id and the state of every node of a chain (n -> n + 1 for ids from -1 on, moved up by one), as a search of one step computes it."""
    moved = nodes.withColumn("id", F.col("id") + 1)
    start = moved.sparkSession.createDataFrame([(0,)], "id long")
    edges = moved.select("id", F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dest"))
    graph = Graph(moved.unionByName(start, allowMissingColumns=True), edges, validate=False)
    found = graph.search(start_nodes=[0], next_state=states, stop=lit(True), max_depth=1).frame()
    return found.select((F.col("nodes")[1] - 1).alias("id"), "state.*")


def integer_vectors(spark: SparkSession, sf_dir: str, components: Column) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(components, lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def list_states(vectors: DataFrame) -> DataFrame:
    v = col("dest.v")
    text = lambda e: e.list.eval(element().cast("string")).list.join(",")
    return one_step(vectors, {
        "n": v.list.len(), "first": v.list.first(), "last": v.list.last(), "slice": text(v.list.slice(1, 2)), "top": text(v.list.sort(descending=True).list.slice(0, 3)), "low": v.list.min(), "high": v.list.max(), "arg_high": v.list.arg_max(),
        "n_unique": v.list.n_unique(), "held": v.list.contains(v.list.get(3)), "big": text(v.list.filter(element() > 40).list.eval(element() + 1)), "total": v.list.sum(), "mean": v.list.mean(), "middle": v.list.median(),
        "thirds": text(v.list.gather_every(3, 2))})


@query("""SELECT vec_id AS id, CAST(len(v) AS BIGINT) AS n, v[1] AS first, v[-1] AS last, array_to_string(list_transform(v[2:3], lambda x: CAST(x AS VARCHAR)), ',') AS slice,
        array_to_string(list_transform(list_reverse(list_sort(v))[1:3], lambda x: CAST(x AS VARCHAR)), ',') AS top, list_min(v) AS low, list_max(v) AS high, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS arg_high,
        CAST(len(list_distinct(v)) AS BIGINT) AS n_unique, list_contains(v, v[4]) AS held, array_to_string(list_transform(list_filter(v, lambda x: x > 40), lambda x: CAST(x + 1 AS VARCHAR)), ',') AS big,
        CAST(list_sum(v) AS BIGINT) AS total, CAST(list_sum(v) AS DOUBLE) / len(v) AS mean, list_median(v) AS middle, array_to_string(list_transform(list_slice(v, 3, len(v), 3), lambda x: CAST(x AS VARCHAR)), ',') AS thirds
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings)""")
def list_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List operations on all components of every vector, as integers."""
    return list_states(integer_vectors(spark, sf_dir, F.col("embedding")))


TEXT = "array_to_string(list_transform({}, lambda x: CAST(x AS VARCHAR)), ',')"


@query(f"""SELECT vec_id AS id, {TEXT.format("list_reverse(v)")} AS reversed, {TEXT.format("list_sort(list_distinct(v))")} AS uniq, {TEXT.format("list_filter(w, lambda x: x IS NOT NULL)")} AS kept,
        len(list_filter(v, lambda x: x > 60)) > 0 AS above, len(list_filter(v, lambda x: x > -200)) = len(v) AS every, len(list_filter(w, lambda x: x IS NULL OR x > -500)) = len(w) AS known, CAST(len(list_filter(v, lambda x: x = v[1])) AS BIGINT) AS matches,
        {TEXT.format("v[1:len(v) - 2]")} AS later, {TEXT.format("v[4:len(v)]")} AS earlier, {TEXT.format("list_sort(list_distinct(list_concat(a, b)))")} AS united, {TEXT.format("list_sort(list_distinct(list_filter(a, lambda x: list_contains(b, x))))")} AS common,
        {TEXT.format("list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x))))")} AS without, {TEXT.format("list_sort(list_distinct(list_filter(list_concat(a, b), lambda x: NOT (list_contains(a, x) AND list_contains(b, x)))))")} AS either,
        {TEXT.format("list_concat(list_concat(v, [CAST(NULL AS BIGINT)]), a)")} AS flat, v[2] AS second, v[1] - v[2] AS gap, CAST(list_position(v, list_min(v)) - 1 AS BIGINT) AS arg_low
    FROM (SELECT *, list_transform(v, lambda x: CASE WHEN x % 3 <> 0 THEN x END) AS w, v[1:40] AS a, v[20:64] AS b
          FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings))""")
def more_list_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other list operations, on all components of every vector, with lists that hold nulls and lists of lists."""
    vectors = integer_vectors(spark, sf_dir, F.col("embedding"))
    nothing = F.array().cast("array<bigint>")
    vectors = vectors.select("id", "v", F.transform("v", lambda x: F.when(x % 3 != 0, x)).alias("w"), F.slice("v", 1, 40).alias("a"), F.slice("v", 20, 45).alias("b"), F.array("v", nothing, F.slice("v", 1, 40)).alias("lists"))
    v, w, a, b = (col(f"dest.{c}") for c in ("v", "w", "a", "b"))
    text = lambda e: e.list.eval(element().cast("string")).list.join(",")
    pair = v.list.to_struct(["x", "y"])
    return one_step(vectors, {
        "reversed": text(v.list.reverse()), "uniq": text(v.list.unique().list.sort()), "kept": text(w.list.drop_nulls()), "above": v.list.eval(element() > 60).list.any(), "every": v.list.eval(element() > -200).list.all(),
        "known": w.list.eval(element().is_null() | (element() > -500)).list.all(), "matches": v.list.count_matches(v.list.first()), "later": text(v.list.shift(2).list.drop_nulls()), "earlier": text(v.list.shift(-3).list.drop_nulls()),
        "united": text(a.list.set_union(b).list.sort()), "common": text(a.list.set_intersection(b).list.sort()), "without": text(a.list.set_difference(b).list.sort()), "either": text(a.list.set_symmetric_difference(b).list.sort()),
        "flat": text(col("dest.lists").list.explode()), "second": pair.struct.field("y"), "gap": pair.struct.field("x") - pair.struct.field("y"), "arg_low": v.list.arg_min()})


@query("""SELECT o_orderkey AS id, '{"key":' || o_orderkey || ',"next":' || (o_orderkey + 1) || ',"status":"' || o_orderstatus || '"}' AS json, o_orderstatus AS status, o_orderstatus = 'F' AS same, true AS missing FROM orders""")
def struct_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("s"), F.col("o_orderkey").alias("k")).alias("m"))
    named = col("dest.m").struct.rename_fields(["status", "key"])
    return one_step(orders, {
        "json": named.struct.with_fields((named.struct.field("key") + 1).alias("next")).struct.json_encode(), "status": named.struct.field("status"),
        "same": named == lit({"key": 0, "status": "F"}).struct.with_fields(named.struct.field("key").alias("key")), "missing": named.struct.field("none").is_null()})


@query("""SELECT o_orderkey AS id, coalesce(p <> 5, true) AS unequal, NOT coalesce(p > 2, false) AS turned, p / 0.0 AS divided, o_orderkey % 7 - 3 AS rest, CAST(CASE WHEN o_orderkey & 6 = 0 THEN 0 ELSE 9 END AS BIGINT) AS masked, xor(o_orderkey, 5) AS flipped,
        CASE WHEN p IS NULL THEN 'none' WHEN p > 3 THEN 'high' ELSE 'low' END AS level, contains(o_orderpriority, '-U') AS urgent, starts_with(o_orderpriority, '5') AS last, p IS NULL AS absent
    FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 5 + 1 AS BIGINT) END AS p FROM orders)""")
def scalar_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar rules where null, zero and logic differ from SQL's."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5 + 1).alias("p"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("t"))
    p, k = col("dest.p"), col("dest.k")
    return one_step(orders, {
        "unequal": p != 5, "turned": ~(p > 2), "divided": p / 0, "rest": k % 7 - 3, "masked": k.mask_if_any(6, 9), "flipped": k.bit_xor(5), "level": when(p.is_null()).then("none").when(p > 3).then("high").otherwise("low"),
        "urgent": col("dest.t").str.contains("-U"), "last": col("dest.t").str.starts_with("5"), "absent": p.is_null()})


@query("""SELECT o_orderkey AS id, o_orderkey & 29 AS lowbits, o_orderkey | 6 AS either, ends_with(o_orderpriority, 'T') AS closing, CAST(o_orderkey AS VARCHAR) || '' AS whole, CAST(o_orderkey AS DOUBLE) AS fraction, CAST(o_orderkey AS BIGINT) AS counted,
        CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS truth, '[' || o_orderkey || ',null]' AS listed, '{"k":' || o_orderkey || '}' AS structured, NOT (o_orderkey > 5000 AND o_orderkey % 2 = 0) AS neither, p IS NULL OR p > 3 AS alternative, coalesce(p, 0) <= 3 AS at_most, p >= 3 AS at_least,
        o_orderkey * 3 - 7 AS product, p IS NOT NULL AS present, starts_with('5-LOW', o_orderpriority) AS held
    FROM (SELECT *, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 5 + 1 AS BIGINT) END AS p FROM orders)""")
def more_scalar_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits, casts to every kind, the other string test, logic and comparisons with null, and an alias, which changes nothing."""
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 5 + 1).alias("p"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("t"),
        F.array(F.col("o_orderkey"), F.lit(None)).alias("l"), F.struct(F.col("o_orderkey").alias("k")).alias("m"))
    p, k, t = col("dest.p"), col("dest.k"), col("dest.t")
    odd = k % 2 == 0
    return one_step(orders, {
        "lowbits": k.bit_and(29), "either": k.bit_or(6), "closing": t.str.ends_with("T"), "whole": k.cast("string"), "fraction": k.cast("float"), "counted": k.cast("uint").cast("int"), "truth": odd.cast("bool").cast("string"),
        "listed": col("dest.l").cast("string"), "structured": col("dest.m").cast("string"), "neither": ~((k > 5000) & odd), "alternative": p.is_null() | (p > 3), "at_most": when(p.is_null()).then(0).otherwise(p) <= 3, "at_least": p >= 3,
        "product": (k * 3 - 7).alias("other"), "present": p.is_not_null(), "held": lit("5-LOW").str.starts_with(t)})


@query("""WITH n AS (SELECT n_nationkey * 2 AS id, n_nationkey % 2 = 0 AS enabled, n_nationkey % 4 AS cost, n_regionkey FROM nation)
    SELECT '1>' || a.id || '>' || b.id AS nodes, CAST(a.cost + b.cost AS BIGINT) AS hops FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.id <> b.id
    WHERE a.enabled AND b.enabled AND a.cost < 3 AND a.cost + b.cost <= 3 AND (a.cost + b.cost >= 3 OR b.id % 10 = 0) AND NOT (a.id % 10 = 0)
    UNION ALL SELECT '1>' || id, CAST(cost AS BIGINT) FROM n WHERE enabled AND cost <= 3 AND (cost >= 3 OR id % 10 = 0)""")
def hop_budget_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hop_budget kernel: from a hub over enabled nations to targets, or until the costs use up the budget."""
    nation = read(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).cast("bigint").alias("id"), "n_regionkey", (F.col("n_nationkey") % 2 == 0).alias("enabled"), (F.col("n_nationkey") % 4).cast("bigint").alias("cost"))
    hub = spark.createDataFrame([(1,)], "id long")
    nodes = nation.select("id", F.struct((F.col("id") % 10 == 0).alias("target")).alias("profile")).unionByName(hub.select("id", F.struct(F.lit(False).alias("target")).alias("profile")))
    policy = F.struct(F.col("enabled").alias("enabled"), F.array(F.col("cost"), F.lit(0).cast("bigint")).alias("hop_costs")).alias("policy")
    out = nation.select((F.col("id") + 1000).alias("id"), F.lit(1).cast("bigint").alias("src"), F.col("id").alias("dest"), policy)
    near = nation.alias("a").join(nation.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.id") != F.col("b.id")))
    across = near.select((F.col("a.id") * 100 + F.col("b.id") + 100_000).alias("id"), F.col("a.id").alias("src"), F.col("b.id").alias("dest"), F.struct(F.col("b.enabled").alias("enabled"), F.array(F.col("b.cost"), F.lit(0).cast("bigint")).alias("hop_costs")).alias("policy"))
    found = Graph(nodes, out.unionByName(across)).search(start_nodes=[1], kernel="hop_budget", params={"max_hops": 3, "policy_col": "policy", "profile_col": "profile"}, max_depth=2).frame()
    return found.select(joined("nodes").alias("nodes"), F.col("state.hops").alias("hops"))


def stored(spark: SparkSession, sf_dir: str, payloads: str) -> Graph:
    """Customers and their orders as a graph of Parquet files, endpoints called src_id and dest_id, with columns that no query names."""
    graph, place = supply(spark, sf_dir, lines=False), f"{folder(spark)}/stored-{uuid.uuid4().hex}"
    graph.nodes.select("id", "kind", F.lit("unused").alias("pad")).write.parquet(f"{place}/nodes")
    graph.edges.select("id", F.col("src").alias("src_id"), F.col("dest").alias("dest_id"), "price", F.lit("unused").alias("pad")).write.parquet(f"{place}/edges")
    return Graph.from_parquet(f"{place}/nodes", f"{place}/edges", payloads, spark=spark)


STORED = "SELECT (o_custkey * 4) || '>' || (o_orderkey * 4 + 1) AS nodes, o_totalprice AS price FROM orders WHERE o_totalprice > 100000.0"


def dear_orders(graph: Graph) -> DataFrame:
    found = graph.search(start_nodes=customers_of(graph), visit=col("edge.price") > 100_000.0, next_state={"price": col("edge.price")}, stop=col("dest.kind") == "order", initial_state={"price": 0.0}).frame()
    return found.select(joined("nodes").alias("nodes"), F.col("state.price").alias("price"))


@query(STORED)
def lazy_parquet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over Parquet files, of which only the named columns are read."""
    return dear_orders(stored(spark, sf_dir, "lazy"))


@query(STORED)
def eager_parquet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with both tables cached."""
    return dear_orders(stored(spark, sf_dir, "eager"))


@query(STORED)
def lazy_frames_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over frames, by Graph.from_lazy, after other payloads have been put beside the same ids."""
    graph = supply(spark, sf_dir, lines=False)
    lazy = Graph.from_lazy(graph.nodes.drop("_pos", "kind"), graph.edges.drop("_pos", "price"))
    lazy.set_payloads(graph.nodes.select("id", "kind"), graph.edges.select("id", "price"))
    return dear_orders(lazy)


def named_nations(spark: SparkSession, sf_dir: str, of: type[Graph] = Graph) -> Graph:
    """Region and nation names as labels: tables of a few rows, fetched."""
    rows = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).orderBy("n_nationkey").collect()
    return of.from_edges([(f"region {r['r_name']}", f"nation {r['n_name']}", {"key": r["n_nationkey"]}) for r in rows], spark=spark)


@query("SELECT 'region ' || r_name || '>nation ' || n_name AS path, CAST(n_nationkey AS BIGINT) AS key FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0")
def labelled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph made of Python labels with attributes; paths come back as labels."""
    graph = named_nations(spark, sf_dir)
    regions = [label for label in graph.labels if label.startswith("region ")]
    found = graph.search(start_nodes=regions, visit=col("edge.key") % 2 == 0, next_state={"key": col("edge.key")}, stop=lit(True), initial_state={"key": 0}).paths
    return spark.createDataFrame([(">".join(p.nodes), p.state["key"]) for p in found], "path string, key long")


@query("""WITH n AS (SELECT 'region ' || r_name AS r, 'nation ' || n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT a.n AS source, b.n AS target, CASE WHEN a.n = b.n THEN a.n WHEN a.r = b.r THEN a.n || '>' || a.r || '>' || b.n END AS path FROM n a CROSS JOIN n b""")
def shortest_path_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest paths of all pairs of nations over edges taken either way, in one batch; null where there is none."""
    graph = named_nations(spark, sf_dir, DiGraph)
    nations = [label for label in graph.labels if label.startswith("nation ")]
    pairs = [(a, b) for a in nations for b in nations]
    found = graph.shortest_paths(pairs)
    return spark.createDataFrame([(a, b, None if path is None else ">".join(path)) for (a, b), path in zip(pairs, found, strict=True)], "source string, target string, path string")


@query("""WITH n AS (SELECT 'region ' || r_name AS r, 'nation ' || n_name AS n, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
    SELECT r AS start, r || '>' || string_agg(n, '>' ORDER BY k) AS reached FROM n GROUP BY r UNION ALL SELECT n, n FROM n UNION ALL SELECT 'nowhere', NULL""")
def bfs_of_many_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first order of many starts in one batch; null for a start that is no node."""
    graph = named_nations(spark, sf_dir)
    starts = [*graph.labels, "nowhere"]
    found = graph.bfs_many(starts)
    return spark.createDataFrame([(s, None if nodes is None else ">".join(nodes)) for s, nodes in zip(starts, found, strict=True)], "start string, reached string")


@query("""SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS BIGINT) AS nodes, CAST((SELECT count(*) FROM orders) AS BIGINT) AS edges""")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = supply(spark, sf_dir, lines=False)
    return spark.createDataFrame([(graph.node_count, graph.edge_count)], "nodes long, edges long")


@query("""SELECT conv_id || ':' || min(turn) AS start, string_agg(role, '>' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def list_state_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation from its first turn to its last, the roles gathered in a list."""
    turns = read(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    linked = turns.withColumn("dest", F.lead("id").over(order)).withColumn("after", F.lead("id", 2).over(order)).withColumn("first", F.row_number().over(order) == 1)
    edges = linked.where("dest IS NOT NULL").select(F.concat("id", F.lit(">")).alias("id"), F.col("id").alias("src"), "dest", F.col("after").isNull().alias("last"))
    graph = Graph(linked.select("id", "role", "first"), edges, validate=False)
    firsts = edges.select(F.col("src").alias("id")).join(linked.where("first").select("id"), "id", "left_semi")
    gathered = concat_list([when(col("state.roles").list.len() == 0).then(concat_list([col("src.role")])).otherwise(col("state.roles")), col("dest.role")])
    found = graph.search(start_nodes=firsts, next_state={"roles": gathered, "last": col("edge.last")}, stop=col("state.last"), initial_state={"roles": [], "last": False}).frame()
    return found.select(F.col("nodes")[0].alias("start"), F.array_join("state.roles", ">").alias("roles"))
