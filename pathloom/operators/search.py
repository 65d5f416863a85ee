"""Stateful path search as a loop of joins, one level of path length a round.

A frontier row is a path: its start, its nodes and edges, its edges' positions, the payload of its last node and its state.
A round joins the frontier to the edges that leave its last nodes, joins the payload of the new nodes (where an expression
names any), and evaluates visit, next_state and stop as Spark columns. Where visit reads no payload of the new node, it is evaluated
before that payload is joined; where it does, and the frontier is large, the payload is joined to the edges, which are fewer than
the paths. Each round is one job, which also counts, but for the last round that max_depth allows: its paths and its counters are
plans, run when they are asked for. A frontier of few rows is broadcast, so that the edges stay where they are. Every
returned path has a key of integers by which the depth-first or breadth-first order is restored.

A depth-first search that needs only its first paths expands the frontier in batches instead, in the order of the search: the
children of a batch come before all that still waits, so waiting batches form a stack, and the search ends once enough
of the paths found precede whatever is open.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.expr import Expr, columns_of
from pathloom.operators.kernels import Kernel
from pathloom.plans.compiler import Compiler, fitted, literal, merged
from pathloom.plans.lineage import cut
from pathloom.sources.tables import concrete, type_of

LOG = logging.getLogger("pathloom.search")
STEPS = 12
#: Path entries that may be broadcast; paths in a batch of a depth-first search, and rounds after which it doubles.
FEW, BATCH, DOUBLING = 100_000, 1024, 16
Expand = Callable[[DataFrame, int, int], DataFrame]


@dataclass
class Traversal:
    """A search's settings, for use more than once."""

    kernel: Kernel
    start_nodes: list[Any] | DataFrame
    max_depth: int | None = None
    max_paths: int | None = None
    strategy: str = "dfs"
    parallel: bool | str = True
    intermediate_states: bool = False
    progress: bool = False
    max_revisits_per_node: int = 0
    max_frontier: int | None = None
    columns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.strategy not in ("dfs", "bfs"):
            raise ValueError(f"strategy must be 'dfs' or 'bfs', not {self.strategy!r}")
        if not (isinstance(self.parallel, bool) or self.parallel in ("on", "off", "auto")):
            raise ValueError("parallel must be a bool, 'on', 'off' or 'auto'")
        for name in ("max_depth", "max_paths", "max_revisits_per_node"):
            value = getattr(self, name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, int) or value < 0):
                raise ValueError(f"{name} must be an integer of 0 or more")


@dataclass
class SearchStats:
    """Counters of a run. Payload counters stay 0: Spark reads payload columns by the plan, not row by row."""

    start_nodes: int = 0
    path_entries: int = 0
    evaluated_edges: int = 0
    accepted_edges: int = 0
    rejected_edges: int = 0
    skipped_revisits: int = 0
    stopped_paths: int = 0
    max_depth: int = 0
    materialized_node_payloads: int = 0
    materialized_edge_payloads: int = 0


def payload(table: DataFrame, names: Iterable[str], what: str, *extra: Column) -> Column:
    wanted = sorted(set(names) - {"id"})
    missing = [n for n in wanted if n not in table.columns]
    if missing:
        raise RuntimeError(f'column "{missing[0]}" is missing in the {what} table')
    return F.struct("id", *wanted, *extra)


def state_type(kernel: Kernel, frame: DataFrame) -> T.StructType:
    """The fields of initial and next state, sorted, each of a type that holds all of its values."""
    names = sorted({*kernel.initial_state, *kernel.next_state})
    begin = Compiler(with_state(frame, {}))
    kinds: dict[str, T.DataType] = {n: begin.compile(v).type if isinstance(v := kernel.initial_state.get(n), Expr) else type_of(v) for n in names}
    changed = {*names}
    for step in range(STEPS):
        compiler = Compiler(with_state(frame, kinds))
        open_ = [n for n in names if n in kernel.next_state and (step == 0 or any(s == "state" and f in changed for s, f in columns_of(kernel.next_state[n])))]
        new = kinds | {n: merged(kinds[n], compiler.compile(kernel.next_state[n]).type) for n in open_}
        changed, kinds = {n for n in names if new[n] != kinds[n]}, new
        if not changed:
            return T.StructType([T.StructField(n, concrete(t)) for n, t in kinds.items()])
    raise RuntimeError("the state's types do not settle")


def with_state(frame: DataFrame, kinds: dict[str, T.DataType]) -> DataFrame:
    empty = F.struct(*(F.lit(None).cast(t).alias(n) for n, t in kinds.items())) if kinds else F.struct(F.lit(None).alias("_"))
    return frame.withColumn("state", empty)


@dataclass
class Found:
    """The paths of a search as a frame in key order, and the counters, which may need a job of their own."""

    df: DataFrame
    count: Callable[[], SearchStats]
    state: T.StructType

    @cached_property
    def stats(self) -> SearchStats:
        return self.count()


def run(nodes: DataFrame, edges: DataFrame, traversal: Traversal) -> Found:
    """paths: path (from 0, in search order), start, nodes, edges, state and, if asked for, states."""
    kernel, spark = traversal.kernel, nodes.sparkSession
    starting = [v for v in kernel.initial_state.values() if isinstance(v, Expr)]
    named = set().union(*(columns_of(e) for e in (*kernel.expressions(), *starting)))
    more = {what: [c for c in traversal.columns if c in table.columns] for what, table in (("node", nodes), ("edge", edges))}
    node_columns = payload(nodes, (*more["node"], *(f for s, f in named if s in ("src", "dest"))), "node")
    edge_columns = payload(edges, (*more["edge"], *(f for s, f in named if s == "edge" and f not in ("src", "dest"))), "edge")
    steps = edges.select(F.col("src").alias("_src"), F.col("dest").alias("_dest"), F.col("_pos").alias("_epos"), F.col("_original" if "_original" in edges.columns else "id").alias("_eid"), edge_columns.alias("edge"))
    ends = nodes.select(F.col("id").alias("_id"), node_columns.alias("dest"))
    plain = ends.schema["dest"].dataType.names == ["id"]  # no payload: an edge knows all of its end
    scopes = ends.select(F.col("dest").alias("src"), "dest").limit(0).crossJoin(steps.select("edge").limit(0))  # schema only: no rows on either side
    kind = state_type(kernel, scopes)
    columns = compiled(kernel, with_state(scopes, {f.name: f.dataType for f in kind}), kind)

    starts = start_rows(nodes, traversal.start_nodes)
    begin = Compiler(scopes.withColumn("state", F.struct(F.lit(None).alias("_"))))
    initial = F.struct(*(start_value(kernel.initial_state.get(f.name), f.dataType, begin).alias(f.name) for f in kind)) if len(kind) else F.struct(F.lit(None).alias("_"))
    frontier = starts.join(ends, "_id").withColumn("src", F.col("dest")).select(
        "start", F.array("_id").alias("nodes"), F.array().cast("array<bigint>").alias("key"), F.array().cast(T.ArrayType(edges.schema["id"].dataType)).alias("edges"),
        "src", initial.alias("state"), *([F.array(initial).alias("states")] if traversal.intermediate_states else []))
    frontier = cut(frontier)
    waiting = frontier.count()
    if waiting != (starts.count() if isinstance(traversal.start_nodes, DataFrame) else len(traversal.start_nodes)):
        raise RuntimeError(f"unknown start node {starts.join(ends, '_id', 'left_anti').orderBy('start').first()['_id']!r}")
    stats = SearchStats(start_nodes=waiting, path_entries=waiting)
    early = not reads_dest(kernel.visit)

    def expand(rows: DataFrame, n: int, depth: int) -> DataFrame:
        if few(rows, n, depth):
            return expanded(F.broadcast(rows), steps, None if plain else ends, columns, traversal, early)
        if plain or early:
            return expanded(rows, steps, None if plain else ends, columns, traversal, early)
        return expanded(rows, steps.join(ends, F.col("_dest") == F.col("_id"), "left").drop("_id"), None, columns, traversal, early)

    last = None
    if traversal.max_paths == 0 or not waiting:
        found, levels = [], []
    elif traversal.strategy == "dfs" and traversal.max_paths is not None:
        found, levels = depth_first(frontier, waiting, expand, traversal, stats)
    else:
        found, levels, last = level_by_level(frontier, waiting, expand, traversal, stats)
    paths = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], frontier.schema).withColumn("depth", F.lit(0))
    order = order_key(traversal.strategy)
    if traversal.max_paths is not None:
        paths = cut(paths.orderBy(order).limit(traversal.max_paths))

    def count() -> SearchStats:
        if last is not None:
            add(stats, last.agg(*tallies()).first().asDict(), traversal.max_depth)
        if traversal.max_paths is not None and levels and stats.stopped_paths >= traversal.max_paths:
            return truncated(levels, paths, order, traversal, stats)
        return stats

    ranked = paths.select(order.alias("_key"), "start", "nodes", "edges", "state", *(["states"] if traversal.intermediate_states else []))
    return Found(ranked, count, kind)


def few(rows: DataFrame, n: int, depth: int) -> bool:
    """Whether rows may be broadcast: their number and the length of their paths bound them, and no field can be long."""
    return n * (depth + 1) <= FEW and all(short(f.dataType) for f in rows.schema if f.name not in ("nodes", "edges", "key"))


def reads_dest(expr: Expr) -> bool:
    """Whether an expression names, or as a Spark column may name, the new node."""
    return expr.op == "spark" or expr.op == "col" and expr.options["scope"] == "dest" or any(map(reads_dest, expr.args))


def short(kind: T.DataType) -> bool:
    """Whether values of a type take a few bytes, whatever they are."""
    return all(short(f.dataType) for f in kind) if isinstance(kind, T.StructType) else not isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType))


def tallies() -> list[Column]:
    return [*(F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(n) for n, c in (("skipped", "_skip"), ("accepted", "_ok"), ("stopped", "_stop"))), F.count(F.lit(1)).alias("all")]


def counted(level: DataFrame, keep: Column | None = None) -> tuple[DataFrame, dict[str, int]]:
    """A level, checkpointed, and its counters, in one job."""
    seen = Observation()
    level = level.observe(seen, *tallies())
    level = cut(level if keep is None else level.where(keep))
    return level, {k: v or 0 for k, v in seen.get.items()}


def level_by_level(frontier: DataFrame, waiting: int, expand: Expand, traversal: Traversal, stats: SearchStats) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """The paths that stop, and the candidates, of each level; and the level that max_depth makes the last one, if it is reached: a plan whose
    candidates are not in the counters yet."""
    found, levels, depth, names = [], [], 0, frontier.columns
    whole = traversal.max_paths is not None and traversal.parallel in (False, "off")  # the counters need rejected candidates too
    while waiting and (traversal.max_depth is None or depth < traversal.max_depth):
        if traversal.max_frontier is not None and waiting > traversal.max_frontier:
            raise RuntimeError(f"{waiting} paths of length {depth} are more than max_frontier")
        depth += 1
        if depth == traversal.max_depth and not traversal.progress:
            level = expand(frontier, waiting, depth)
            found.append(level.where("_ok AND _stop").withColumn("depth", F.lit(depth)))
            levels.append(level.withColumn("depth", F.lit(depth)))
            return found, levels, level
        level, counts = counted(expand(frontier, waiting, depth), None if whole else F.col("_ok"))
        add(stats, counts, depth)
        found.append(level.where("_stop").withColumn("depth", F.lit(depth)))
        levels.append(level.withColumn("depth", F.lit(depth)))
        if traversal.progress:
            LOG.warning("level %d: %s", depth, counts)
        waiting = counts["accepted"] - counts["stopped"]
        if traversal.max_paths is not None and stats.stopped_paths >= traversal.max_paths:
            break
        frontier = level.where("_ok AND NOT _stop").select(*names)
    return found, levels, None


def depth_first(frontier: DataFrame, waiting: int, expand: Expand, traversal: Traversal, stats: SearchStats) -> tuple[list[DataFrame], list[DataFrame]]:
    """The same until max_paths paths precede all that is open.

    A batch holds at least as many paths as are asked for; it doubles every DOUBLING rounds, so that a search over many paths that lead
    nowhere takes few rounds.
    """
    names, found, levels = frontier.columns, [], []
    turn = F.concat(F.array(-F.col("start")), F.transform("key", lambda x: -x))  # when a path is expanded
    at = lambda place: F.array(*(F.lit(x).cast("bigint") for x in place))
    stack: list[tuple[DataFrame, list[int] | None, int]] = [(frontier, None, waiting)]  # rows, those up to which are done, how many are left
    batch, rounds = max(BATCH, traversal.max_paths), 0
    while stack:
        base, done, n = stack.pop()
        rows = base if done is None else base.where(turn > at(done))
        size = batch << rounds // DOUBLING
        rounds += 1
        if n > size:
            done = rows.select(turn.alias("turn")).orderBy("turn").limit(size).agg(F.max("turn")).first()[0]
            rows = rows.where(turn <= at(done))
            taken = rows.count()  # starts that come twice are taken together
            if taken < n:
                stack.append((base, done, n - taken))
            n = taken
        longest = rows.agg(F.max(F.size("key"))).first()[0]
        if traversal.max_depth is not None:
            rows = rows.where(F.size("key") < traversal.max_depth)
        level, counts = counted(expand(rows, n, longest))
        level = level.withColumn("depth", F.size("key"))
        add(stats, counts, longest + 1)
        found.append(level.where("_stop"))
        levels.append(level)
        if traversal.progress:
            LOG.warning("batch %d of %d paths: %s", rounds, n, counts)
        more = counts["accepted"] - counts["stopped"]
        if more:
            stack.append((level.where("_ok AND NOT _stop").select(*names), None, more))
        if stats.stopped_paths >= traversal.max_paths:
            if not stack:
                break
            base, done, _ = stack[-1]
            first = (base if done is None else base.where(turn > at(done))).agg(F.min(turn)).first()[0]
            before = order_key("dfs")["parent"] < at(first)
            if reduce(DataFrame.unionByName, found).where(before).count() >= traversal.max_paths:
                break
    deepest = [x.where("_ok").agg(F.max("depth").alias("d")) for x in levels]
    stats.max_depth = max((r["d"] or 0 for r in reduce(DataFrame.unionByName, deepest).collect()), default=0)
    return found, levels


def start_rows(nodes: DataFrame, starts: list[Any] | DataFrame) -> DataFrame:
    """start (a number that orders the starts) and _id. A frame's starts are in the order of the node table."""
    if isinstance(starts, DataFrame):
        return starts.select(F.col("id").cast(nodes.schema["id"].dataType).alias("_id")).join(nodes.select(F.col("id").alias("_id"), F.col("_pos").alias("start")), "_id", "left").select("start", "_id")
    kind = T.StructType([T.StructField("start", T.LongType()), T.StructField("_id", nodes.schema["id"].dataType)])
    return nodes.sparkSession.createDataFrame([*enumerate(starts)], kind)


def start_value(value: Any, kind: T.DataType, compiler: Compiler) -> Column:
    """A plain value, or an expression over the start node (as src)."""
    if isinstance(value, Expr):
        made = compiler.compile(value)
        return fitted(made.column, made.type, kind)
    return F.lit(None).cast(kind) if value is None else fitted(literal(value), type_of(value), kind)


def compiled(kernel: Kernel, frame: DataFrame, kind: T.StructType) -> dict[str, Column]:
    compiler = Compiler(frame)
    child = []
    for f in kind:
        if f.name in kernel.next_state:
            value = compiler.compile(kernel.next_state[f.name])
            child.append(fitted(value.column, value.type, f.dataType).alias(f.name))
        else:
            child.append(F.col("state").getField(f.name).alias(f.name))
    return {"visit": compiler.predicate(kernel.visit).column, "stop": compiler.predicate(kernel.stop).column, "child": F.struct(*child) if child else F.col("state")}


def expanded(frontier: DataFrame, steps: DataFrame, ends: DataFrame | None, columns: dict[str, Column], traversal: Traversal, early: bool) -> DataFrame:
    """Every candidate edge of a frontier: whether it is skipped, accepted, stopped; and the new path.

    Without ends, steps hold the new node's payload as dest, or a node is its id. Early: visit reads no payload of the new node.
    """
    times = F.size(F.filter("nodes", lambda n: n == F.col("_dest")))
    ok = F.when(F.col("_skip"), F.lit(False)).otherwise(columns["visit"])
    candidates = frontier.join(steps, F.col("src.id") == F.col("_src")).withColumn("_skip", times > traversal.max_revisits_per_node)
    if early:
        candidates = candidates.withColumn("_ok", ok)
    if "dest" in steps.columns:
        joined = candidates
    elif ends is None:
        joined = candidates.withColumn("dest", F.struct(F.col("_dest").alias("id")))
    else:
        joined = candidates.join(ends, (F.col("_dest") == F.col("_id")) & F.col("_ok" if early else "_skip").eqNullSafe(F.lit(early)), "left")
    visited = joined if early else joined.withColumn("_ok", ok)
    moved = visited.withColumn("state", F.when(F.col("_ok"), columns["child"]))
    stopped = moved.withColumn("_stop", F.when(F.col("_ok"), columns["stop"]).otherwise(F.lit(False)))
    longer = [F.concat("nodes", F.array("_dest")).alias("nodes"), F.concat("key", F.array("_epos")).alias("key"), F.concat("edges", F.array("_eid")).alias("edges"), F.col("dest").alias("src"), "state"]
    history = [F.concat("states", F.array("state")).alias("states")] if traversal.intermediate_states else []
    return stopped.select("start", *longer, *history, "_skip", "_ok", "_stop")


def order_key(strategy: str) -> Column:
    """Breadth first: by length, start, edges. Depth first: a path is found when its parent is expanded, and the last of what
    is waiting is expanded first; so by the parent's start and edges downwards, shorter first, then by the last edge upwards."""
    if strategy == "bfs":
        return F.struct(F.col("depth").cast("bigint").alias("depth"), F.col("start"), F.col("key"))
    parent = F.concat(F.array(-F.col("start")), F.transform(F.slice("key", 1, F.size("key") - 1), lambda x: -x))
    return F.struct(parent.alias("parent"), F.element_at("key", -1).alias("last"))


def add(stats: SearchStats, counted: dict[str, int], depth: int) -> None:
    evaluated = counted["all"] - counted["skipped"]
    stats.evaluated_edges += evaluated
    stats.accepted_edges += counted["accepted"]
    stats.rejected_edges += evaluated - counted["accepted"]
    stats.skipped_revisits += counted["skipped"]
    stats.stopped_paths += counted["stopped"]
    stats.path_entries += counted["accepted"]
    if counted["accepted"]:
        stats.max_depth = depth


def truncated(levels: list[DataFrame], paths: DataFrame, order: Column, traversal: Traversal, whole: SearchStats) -> SearchStats:
    """The counters of a run that ends with its last returned path.

    Depth first: every candidate up to that path (all of them are among the batches expanded). Breadth first: whole levels; with parallel off, what was accepted counts
    only up to that path.
    """
    if traversal.strategy == "bfs" and traversal.parallel not in (False, "off"):
        return whole
    last = paths.select(F.max(order).alias("last"))
    candidates = reduce(DataFrame.unionByName, levels).select("depth", "_skip", "_ok", "_stop", order.alias("_order"))
    marked = candidates.crossJoin(F.broadcast(last)).withColumn("_in", F.col("_order") <= F.col("last"))  # one row beside each
    inside = F.col("_in") if traversal.strategy == "dfs" else F.lit(True)
    n = lambda c: F.sum(c.cast("bigint"))
    row = marked.agg(
        n(inside & ~F.col("_skip")).alias("evaluated_edges"), n(F.col("_in") & F.col("_ok")).alias("accepted_edges"), n(inside & ~F.col("_skip") & ~F.col("_ok")).alias("rejected_edges"),
        n(inside & F.col("_skip")).alias("skipped_revisits"), n(F.col("_in") & F.col("_stop")).alias("stopped_paths"), F.max(F.when(F.col("_in") & F.col("_ok"), F.col("depth"))).alias("max_depth")).first()
    found = {f.name: row[f.name] or 0 for f in fields(SearchStats) if f.name in row.asDict()}
    return SearchStats(start_nodes=whole.start_nodes, path_entries=whole.start_nodes + found["accepted_edges"], **found)
