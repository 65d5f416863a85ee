"""Graph: a directed property multigraph over a node frame and an edge frame."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.operators import search as searching
from pathloom.operators import topology
from pathloom.operators.kernels import Kernel, named_kernel
from pathloom.operators.search import Traversal
from pathloom.result import LazyResult, SearchResult
from pathloom.sources import tables

NODE_PARAMS = ("target", "source", "start", "node")


class Graph:
    """nodes: ``id`` and any payload. edges: ``id``, ``src``, ``dest`` and any payload.

    Ids are integers of 0 or more, or strings, of one kind throughout. Rows are ordered by ``node_order`` and ``edge_order``
    (a column of each table), else by id. Payload columns are read only where a search names them.
    """

    both_ways = False

    def __init__(self, nodes: Any, edges: Any, *, node_order: str | None = None, edge_order: str | None = None, validate: bool = True) -> None:
        nodes, edges = tables.single(nodes), tables.single(edges)
        tables.check_columns(nodes, "node", ("id",))
        tables.check_columns(edges, "edge", ("id", "src", "dest"))
        nodes, edges = tables.whole_ids(nodes, ("id",)), tables.whole_ids(edges, ("id", "src", "dest"))
        tables.check_ids(nodes, edges)
        if validate:
            tables.check_rows(nodes, edges)
        self.nodes, self.edges = tables.positioned(nodes, node_order), tables.positioned(edges, edge_order)
        self.labels: list[Hashable] | None = None
        self._ids: dict[Hashable, int] = {}
        self._edge_labels: dict[Any, Hashable] | None = None
        self._needs_columns = False
        if self.both_ways:
            self.edges = tables.with_reverse(self.edges)

    @classmethod
    def from_edges(cls, edges: Iterable[Any], *, nodes: Iterable[Any] | None = None, spark: SparkSession | None = None) -> Graph:
        """From Python labels: (src, dest[, attributes]) and label or (label, attributes)."""
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        made = tables.labelled(session, edges, nodes, cls.both_ways)
        graph = cls.__new__(cls)
        Graph.__init__(_plain(graph), made.nodes, made.edges, validate=False)
        graph.labels, graph._ids, graph._edge_labels = made.labels, {label: i for i, label in enumerate(made.labels)}, made.edge_labels
        return graph

    @classmethod
    def from_lazy(cls, nodes: DataFrame, edges: DataFrame, **options: Any) -> Graph:
        """From frames, as the constructor; a named kernel must then be told its payload columns."""
        graph = cls(nodes, edges, **options)
        graph._needs_columns = True
        return graph

    @classmethod
    def from_parquet(cls, nodes: str, edges: str, payloads: str = "eager", *, spark: SparkSession | None = None, **options: Any) -> Graph:
        """From Parquet; endpoints may be called src_id and dest_id. ``eager`` caches both tables, ``lazy`` reads columns when needed."""
        if payloads not in ("eager", "lazy"):
            raise ValueError(f"payloads must be 'eager' or 'lazy', not {payloads!r}")
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        node_table, edge_table = session.read.parquet(str(nodes)), session.read.parquet(str(edges))
        for end in ("src", "dest"):
            if f"{end}_id" in edge_table.columns:
                edge_table = edge_table.drop(end).withColumnRenamed(f"{end}_id", end)
        if payloads == "eager":
            node_table, edge_table = node_table.cache(), edge_table.cache()
        return cls(node_table, edge_table, **options)

    def set_payloads(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Puts other payload columns beside the same ids. Rows are matched by id: payloads with other ids, or an id twice, are an error and
        change nothing. Topology columns are ignored. Where edges go both ways, both take the payload of the edge itself."""
        keep, made = ("src", "dest", tables.POSITION, "_original"), []
        for old, new, what in ((self.nodes, nodes, "node"), (self.edges, edges, "edge")):
            own = "_original" if "_original" in old.columns else "id"
            payload = tables.whole_ids(new, ("id",)).drop(*keep).withColumnRenamed("id", "_payload")
            known = old.select(F.col(own).alias("_payload")).distinct()
            if payload.count() != known.count() or known.join(payload, "_payload", "left_anti").head(1):
                raise ValueError(f"{what} payloads must have the ids of the graph, each once")
            made.append(old.select("id", *(c for c in keep if c in old.columns)).join(payload, F.col(own) == F.col("_payload")).drop("_payload"))
        self.nodes, self.edges = made

    @cached_property
    def node_count(self) -> int:
        return self.nodes.count()

    @cached_property
    def edge_count(self) -> int:
        return self.edges.count()

    def node_id(self, label: Hashable) -> Any:
        """The engine's id of a label; where the graph has no labels, ids are their own."""
        if self.labels is None:
            return label
        if label not in self._ids:
            raise ValueError(f"node label {label!r} is not present in the graph")
        return self._ids[label]

    def _label(self, node: Any) -> Hashable:
        return node if self.labels is None else self.labels[node]

    def _edge_label(self, edge: Any) -> Hashable:
        return self._edge_labels.get(edge, edge) if self._edge_labels else edge

    # Search

    def search(
        self, *, start_nodes: Iterable[Hashable] | DataFrame, visit: Any = None, next_state: Mapping[str, Any] | None = None, stop: Any = None, initial_state: Mapping[str, Any] | None = None,
        kernel: str | None = None, params: Mapping[str, Any] | None = None, columns: Iterable[str] | None = None, max_depth: int | None = None, max_paths: int | None = None,
        strategy: str = "dfs", parallel: bool | str = True, intermediate_states: bool = False, progress: bool = False, max_revisits_per_node: int = 0, max_frontier: int | None = None,
    ) -> SearchResult:
        """Paths from the start nodes (labels or ids, or a frame with a column ``id``) over accepted edges to where they stop.

        Either expressions (visit, next_state, stop, initial_state) or a named kernel with params. Without stop, max_paths must
        be given and every accepted edge ends a path. Paths and counters are the same at every run; ``parallel`` only says
        whether a breadth-first run that max_paths cuts short counts whole levels. initial_state holds plain values, or expressions
        over the start node as src. ``columns`` are payload columns to read beside those that the expressions name; Spark
        columns in place of expressions need them.
        """
        if kernel is not None:
            if any(x is not None for x in (visit, next_state, stop, initial_state)):
                raise ValueError("pass a named kernel or expressions, not both")
            if self._needs_columns and columns is None:
                raise ValueError("a named kernel on a lazy graph requires 'columns'")
            asked = {k: self._ids.get(v, v) if k in NODE_PARAMS and isinstance(v, Hashable) else v for k, v in (params or {}).items()}
            made = named_kernel(kernel, asked)
        else:
            if stop is None and max_paths is None:
                raise TypeError("search needs stop or max_paths")
            made = Kernel(visit, next_state, True if stop is None else stop, initial_state)
        starts = start_nodes if isinstance(start_nodes, DataFrame) else [*start_nodes]
        return self.traverse(Traversal(made, starts, max_depth, max_paths, strategy, parallel, intermediate_states, progress, max_revisits_per_node, max_frontier, tuple(columns or ())))

    def traverse(self, traversal: Traversal) -> SearchResult:
        starts = traversal.start_nodes
        if not isinstance(starts, DataFrame):
            starts = [self.node_id(s) for s in starts]
        found = searching.run(self.nodes, self.edges, Traversal(**{**vars(traversal), "start_nodes": starts}))
        return LazyResult(found, self._label, self._edge_label)

    # Topology: the *_frame methods give frames of any size, the others fetch them in order

    def _present(self, node: Hashable) -> Any:
        node_id = self.node_id(node)
        whole = isinstance(self.nodes.schema["id"].dataType, T.LongType)
        if isinstance(node_id, bool) or not isinstance(node_id, int if whole else str) or not self.nodes.where(F.col("id") == F.lit(node_id)).head(1):
            raise ValueError(f"node id {node} is not present in the graph")
        return node_id

    def _sources(self, nodes: list[Any]) -> DataFrame:
        kind = T.StructType([T.StructField("source", T.LongType()), T.StructField("id", self.nodes.schema["id"].dataType)])
        asked = self.nodes.sparkSession.createDataFrame([*enumerate(nodes)], kind)
        return asked.join(self.nodes.select("id"), "id").select("source", F.col("id").alias("node"))

    def bfs_frame(self, starts: Iterable[Hashable], max_depth: int | None = None, paths: bool = False, ordered: bool = True) -> DataFrame:
        """source (the number of the start), node, depth and, if ordered, place; starts that are no nodes reach nothing."""
        return topology.bfs(topology.out_links(self.edges), self._sources([self.node_id(s) for s in starts]), max_depth, paths=paths, ordered=ordered)

    def bfs(self, start: Hashable, max_depth: int | None = None) -> list[Hashable]:
        self._present(start)
        return [self._label(r["node"]) for r in self.bfs_frame([start], max_depth).orderBy("depth", "place").collect()]

    def bfs_many(self, starts: Iterable[Hashable], max_depth: int | None = None) -> list[list[Hashable] | None]:
        """A list for each start, None for one that is no node."""
        asked = [*starts]
        known = [s for s in asked if self.labels is None or s in self._ids]
        found: dict[Hashable, list[Hashable]] = {}
        for r in self.bfs_frame(known, max_depth).orderBy("source", "depth", "place").collect():
            found.setdefault(known[r["source"]], []).append(self._label(r["node"]))
        return [found.get(s) for s in asked]

    def dfs_frame(self, start: Hashable, max_depth: int | None = None) -> DataFrame:
        return topology.dfs(topology.out_links(self.edges), self.nodes, F.lit(self._present(start)), max_depth)

    def dfs(self, start: Hashable, max_depth: int | None = None) -> list[Hashable]:
        return [self._label(r["node"]) for r in self.dfs_frame(start, max_depth).orderBy("place").collect()]

    def reachable_nodes(self, start: Hashable) -> list[Hashable]:
        return self.bfs(start)

    def shortest_paths_frame(self, pairs: Iterable[tuple[Hashable, Hashable]]) -> DataFrame:
        """source (the number of the pair) and path, for each pair that is connected."""
        asked = [(self.node_id(a), self.node_id(b)) for a, b in pairs]
        targets = self._sources([b for _, b in asked])
        reached = topology.bfs(topology.out_links(self.edges), self._sources([a for a, _ in asked]), targets=targets, paths=True, ordered=False)
        return reached.join(targets, ["source", "node"], "left_semi").select("source", "path")

    def shortest_paths(self, pairs: Iterable[tuple[Hashable, Hashable]]) -> list[list[Hashable] | None]:
        """A path for each pair, None where an end is no node or there is no path."""
        asked = [*pairs]
        known = [i for i, p in enumerate(asked) if self.labels is None or all(x in self._ids for x in p)]
        found = {known[r["source"]]: [self._label(n) for n in r["path"]] for r in self.shortest_paths_frame([asked[i] for i in known]).collect()}
        return [found.get(i) for i in range(len(asked))]

    def shortest_path(self, source: Hashable, target: Hashable) -> list[Hashable] | None:
        self._present(source)
        self._present(target)
        return self.shortest_paths([(source, target)])[0]

    def degrees_frame(self, *ends: str) -> DataFrame:
        """id, degree and position; ends: src for out-degrees, dest for in-degrees, both (the default) for their sum."""
        return topology.degrees(self.nodes, self.edges, ends or ("src", "dest"))

    def _degrees(self, *ends: str) -> list[int]:
        return [r["degree"] for r in self.degrees_frame(*ends).orderBy(tables.POSITION).collect()]

    def out_degrees(self) -> list[int]:
        return self._degrees("src")

    def in_degrees(self) -> list[int]:
        return self._degrees("dest")

    def degrees(self) -> list[int]:
        return self._degrees("src", "dest")

    def components_frame(self) -> DataFrame:
        """id, _pos, root, root_pos: the weakly connected component of each node by its first node."""
        return topology.weak_components(self.nodes, self.edges)

    def weakly_connected_components(self) -> list[list[Hashable]]:
        """Components by first node; inside, breadth first over out-edges, then in-edges."""
        roots = self.components_frame().where("id = root").select(F.col("root_pos").alias("source"), F.col("root").alias("node"))
        order = topology.bfs(topology.both_links(self.edges), roots).orderBy("source", "depth", "place")
        found: dict[Any, list[Hashable]] = {}
        for r in order.collect():
            found.setdefault(r["source"], []).append(self._label(r["node"]))
        return list(found.values())


class DiGraph(Graph):
    """A graph whose edges go both ways; paths name the edge itself, whichever way it is taken."""

    both_ways = True


def _plain(graph: Graph) -> Graph:
    """The same object, whose edges are taken as they are: labelled tables hold their reverse edges already."""
    graph.both_ways = False
    return graph
