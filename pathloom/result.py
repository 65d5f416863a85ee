"""What a search returns."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row

from pathloom.operators.search import Found, SearchStats


@dataclass
class Path:
    nodes: list[Hashable]
    edges: list[Hashable]
    state: dict[str, Any]
    intermediate_states: list[dict[str, Any]] | None = None


@dataclass
class SearchResult:
    """paths: the paths in search order, fetched to the driver. ``frame()`` has the same as a DataFrame, to go on with or to write."""

    paths: list[Path]
    stats: SearchStats = field(default_factory=SearchStats)


class LazyResult(SearchResult):
    """A result whose paths are fetched, and whose counters are made up, when they are first asked for."""

    def __init__(self, found: Found, node: Callable[[Any], Hashable], edge: Callable[[Any], Hashable]) -> None:
        self._found, self._node, self._edge, self._paths = found, node, edge, None

    def frame(self) -> DataFrame:
        """start, nodes, edges, state (and states) of each path, with engine ids; ``_key`` sorts them in search order."""
        return self._found.df

    @property
    def stats(self) -> SearchStats:  # type: ignore[override]
        return self._found.stats

    @stats.setter
    def stats(self, value: SearchStats) -> None:
        self._found.stats = value

    @property
    def paths(self) -> list[Path]:  # type: ignore[override]
        if self._paths is None:
            rows = self._found.df.orderBy("_key").collect()
            plain = (lambda s: s.asDict(recursive=True)) if len(self._found.state) else (lambda s: {})
            self._paths = [
                Path([self._node(n) for n in r["nodes"]], [self._edge(e) for e in r["edges"]], plain(r["state"]), [plain(s) for s in r["states"]] if "states" in Row.asDict(r) else None)
                for r in rows
            ]
        return self._paths

    @paths.setter
    def paths(self, value: list[Path]) -> None:
        self._paths = value
