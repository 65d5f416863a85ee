"""pathloom: stateful path search over property graphs held as Spark DataFrames."""

from pathloom.functions.expr import Expr, col, concat_list, element, lit, when
from pathloom.graph import DiGraph, Graph
from pathloom.operators.kernels import Kernel, register_kernel
from pathloom.operators.search import SearchStats, Traversal
from pathloom.result import Path, SearchResult

__version__ = "0.1.0"
__all__ = ["DiGraph", "Expr", "Graph", "Kernel", "Path", "SearchResult", "SearchStats", "Traversal", "col", "concat_list", "element", "lit", "parallelism", "register_kernel", "when"]


def parallelism() -> int:
    """How many tasks the running session works on at once."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    return max(1, session.sparkContext.defaultParallelism) if session else 1
