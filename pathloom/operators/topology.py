"""Topology: breadth-first order, shortest paths, depth-first order, degrees and components.

Breadth-first searches of many starts run together, one join a level; rows are keyed by (source, node). The place of a node
in its level is its parent's place, then the edge's position, so the order is the one of a queue over edges in table order.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators.components import components
from pathloom.plans.lineage import cut


def out_links(edges: DataFrame) -> DataFrame:
    """node, next, and the order in which a node's neighbours are met."""
    return edges.select(F.col("src").alias("node"), F.col("dest").alias("next"), F.struct(F.lit(0).alias("way"), F.col("_pos").alias("at")).alias("turn"))


def both_links(edges: DataFrame) -> DataFrame:
    """As out_links, and after a node's out-edges its in-edges."""
    back = edges.select(F.col("dest").alias("node"), F.col("src").alias("next"), F.struct(F.lit(1).alias("way"), F.col("_pos").alias("at")).alias("turn"))
    return out_links(edges).unionByName(back)


def bfs(links: DataFrame, sources: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None, paths: bool = False, ordered: bool = True) -> DataFrame:
    """source, node and depth, if ordered place (ordered within source and depth), and path if asked for, for every node reached from (source, node) rows.

    targets: (source, node) rows; a source is done once its target is reached. Only an order needs a sort a level. Of several
    shortest paths the one is given that a queue over edges in table order finds: the first in the order of its edges, which
    rows carry where paths are asked for without an order.
    """
    by_turns = paths and not ordered
    kept = ["source", "node", "depth", *(["place"] if ordered else []), *(["path"] if paths else []), *(["turns"] if by_turns else [])]
    # Sources of equal depth 0 are in the order of their number.
    begin = sources.select("source", "node", F.lit(0).alias("depth"), F.col("source").cast("bigint").alias("place"), F.array("node").alias("path"), F.array().cast(T.ArrayType(links.schema["turn"].dataType)).alias("turns"))
    level = cut(begin.select(*kept))
    seen, depth = [level], 0
    while max_depth is None or depth < max_depth:
        frontier = level
        if targets is not None:
            done = level.join(targets, ["source", "node"], "left_semi").select("source")
            targets = cut(targets.join(done, "source", "left_anti"))
            frontier = level.join(targets.select("source"), "source", "left_semi")
        key = F.struct("place", "turn") if ordered else F.concat("turns", F.array("turn")) if paths else F.lit(0)
        steps = frontier.join(links, "node").select("source", F.col("next").alias("node"), key.alias("key"), *([F.col("path")] if paths else []))
        first = steps.groupBy("source", "node").agg(F.min("key").alias("key"), *([F.min_by("path", "key").alias("path")] if paths else []))
        new = first.join(reduce(DataFrame.unionByName, (s.select("source", "node") for s in seen)), ["source", "node"], "left_anti")
        depth += 1
        if ordered:
            new = new.orderBy("key").withColumn("place", F.monotonically_increasing_id())
        if paths:
            new = new.withColumn("path", F.concat("path", F.array("node"))).withColumn("turns", F.col("key")) if by_turns else new.withColumn("path", F.concat("path", F.array("node")))
        level = cut(new.withColumn("depth", F.lit(depth)).select(*kept))
        if not level.head(1):
            break
        seen.append(level)
        if len(seen) % 16 == 0:
            seen = [cut(reduce(DataFrame.unionByName, seen))]
    return reduce(DataFrame.unionByName, seen).drop("turns")


def degrees(nodes: DataFrame, edges: DataFrame, ends: tuple[str, ...]) -> DataFrame:
    """id, _pos, degree for every node; an edge counts once for each of ``ends`` that is the node."""
    per_end = [edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n")) for end in ends]
    counts = reduce(DataFrame.unionByName, per_end).groupBy("id").agg(F.sum("n").alias("n"))
    return nodes.select("id", "_pos").join(counts, "id", "left").select("id", "_pos", F.coalesce("n", F.lit(0)).cast("bigint").alias("degree"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, _pos, root, root_pos for every node: root is the node of its component that comes first in the table."""
    places = nodes.select("id", "_pos")
    links = edges.join(places.select(F.col("id").alias("src"), F.col("_pos").alias("a")), "src").join(places.select(F.col("id").alias("dest"), F.col("_pos").alias("b")), "dest").select("a", "b")
    found = components(links).select(F.col("id").alias("_pos"), F.col("root").alias("root_pos"))
    rooted = places.join(found, "_pos", "left").withColumn("root_pos", F.coalesce("root_pos", "_pos"))
    return rooted.join(places.select(F.col("id").alias("root"), F.col("_pos").alias("root_pos")), "root_pos").select("id", "_pos", "root", "root_pos")


def dfs(links: DataFrame, nodes: DataFrame, start: Column, max_depth: int | None = None) -> DataFrame:
    """node, place: pre-order; neighbours in edge order; a node counts as visited when it is taken from the stack.

    Where what the start reaches is a tree (parallel edges count as one), the order is that of the ways to the nodes: a sort across
    the cluster, of rows as long as their depth. Else depth-first order is sequential by nature: the links among the nodes that the start
    reaches are walked in one task, in flat arrays whose memory is some dozens of bytes a link.
    A node met first at the depth limit is not expanded, even if a shorter way to it exists.
    """
    reached = cut(bfs(links, nodes.where(F.col("id") == start).select(F.lit(0).alias("source"), F.col("id").alias("node")), max_depth, ordered=False).select("node", "depth"))
    expanded = reached if max_depth is None else reached.where(F.col("depth") < max_depth)
    inner = cut(expanded.join(links, "node").groupBy("node", "next").agg(F.min("turn").alias("turn")))
    seen = reached.agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest")).first()
    if seen["n"] and inner.count() == seen["n"] - 1:
        return tree_order(reached.where("depth = 0").select("node"), inner, seen["deepest"])
    following = F.sort_array(F.collect_list(F.when(F.col("next").isNotNull(), F.struct("turn", "next"))))["next"]
    adjacency = cut(reached.join(inner, "node", "left").groupBy("node").agg(F.min("depth").alias("depth"), following.alias("next")))
    return adjacency.coalesce(1).mapInArrow(walked(max_depth), f"node {links.schema['node'].dataType.simpleString()}, place bigint")


def tree_order(root: DataFrame, links: DataFrame, depth: int) -> DataFrame:
    """node, place: pre-order of a tree, whose links are (node, next, turn), by the turns on the way to each node."""
    level = root.withColumn("way", F.array().cast(T.ArrayType(links.schema["turn"].dataType)))
    levels = [level]
    for _ in range(depth):
        level = cut(level.join(links, "node").select(F.col("next").alias("node"), F.concat("way", F.array("turn")).alias("way")))
        levels.append(level)
    sorted_ = cut(reduce(DataFrame.unionByName, levels).orderBy("way").select("node", F.monotonically_increasing_id().alias("at")))
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # the sorted partition, and the row in it
    before, offsets = 0, []
    for r in sorted_.groupBy(part.alias("part")).count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    begin = root.sparkSession.createDataFrame(offsets, "part long, before long")
    return sorted_.withColumn("part", part).join(F.broadcast(begin), "part").select("node", (F.col("before") + inside).alias("place"))


def walked(max_depth: int | None):
    """Depth-first order of all (node, depth, next) rows, from the one of depth 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lists, sizes, first, n = [], [], [], None, 0
        for part in parts:
            held.append(part.column("node"))
            lists.append(part.column("next").flatten())
            sizes.append(pc.fill_null(pc.list_value_length(part.column("next")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = np.flatnonzero(part.column("depth").to_numpy(zero_copy_only=False) == 0)
            first = n + int(start[0]) if len(start) else first
            n += part.num_rows
        if first is None:
            return
        node = pa.concat_arrays(held)
        # What lies beyond the depth limit is no row here, and is never asked for.
        after = memoryview(pc.fill_null(pc.index_in(pa.chunked_array(lists), value_set=node), -1).to_numpy().astype(np.int32))
        del held, lists
        ends = np.cumsum(np.concatenate(sizes))
        at, ends = memoryview(ends - np.concatenate(sizes)), memoryview(ends)
        taken, order, stack = bytearray(n), array("i", [first]), array("i", [first])
        taken[first] = 1
        while stack:
            top = stack[-1]
            if at[top] == ends[top] or max_depth is not None and len(stack) > max_depth:
                stack.pop()
                continue
            found = after[at[top]]
            at[top] += 1
            if not taken[found]:
                taken[found] = 1
                order.append(found)
                stack.append(found)
        for low in range(0, len(order), 1 << 16):
            some = np.array(order[low : low + (1 << 16)], np.int32)
            yield pa.RecordBatch.from_arrays([node.take(pa.array(some)), pa.array(np.arange(low, low + len(some)), pa.int64())], names=["node", "place"])

    return run
