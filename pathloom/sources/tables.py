"""Node and edge tables: validation, row positions, labelled inputs and reversed edges."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Mapping
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.plans.lineage import cut

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
POSITION = "_pos"


def single(table: Any) -> DataFrame:
    """A table given as a frame, or as a list of one (name, frame)."""
    if isinstance(table, DataFrame):
        return table
    if isinstance(table, (list, tuple)) and len(table) == 1 and isinstance(table[0], tuple) and len(table[0]) == 2:
        return table[0][1]
    raise ValueError("a table is a DataFrame or a list of one (name, DataFrame)")


def whole_ids(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Integer ids as long, wherever they come from; unsigned 64-bit ids (decimals) that fit too."""
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, WHOLE) or isinstance(kind, T.DecimalType) and kind.scale == 0:
            df = df.withColumn(c, F.col(c).cast("bigint"))
    return df


def check_columns(df: DataFrame, what: str, needed: Iterable[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"{what} table has no column {', '.join(missing)}")
    if "type" in df.columns and not isinstance(df.schema["type"].dataType, T.StringType):
        raise ValueError(f"{what} column 'type' must be a string")


def check_ids(nodes: DataFrame, edges: DataFrame) -> None:
    """All ids of a graph are of one kind: integers of 0 or more, or strings."""
    kinds = {type(df.schema[c].dataType) for df, cs in ((nodes, ("id",)), (edges, ("id", "src", "dest"))) for c in cs}
    if len(kinds) > 1 or not kinds <= {T.LongType, T.StringType}:
        raise ValueError("node and edge ids must all have the same ID type, integer or string")


def check_rows(nodes: DataFrame, edges: DataFrame) -> None:
    """No null or negative ids, no id twice, and every endpoint a node."""
    for df, what, columns in ((nodes, "node", ("id",)), (edges, "edge", ("id", "src", "dest"))):
        whole = isinstance(df.schema["id"].dataType, T.LongType)
        wrong = F.concat(*(F.array(F.when(F.col(c).isNull(), F.lit(f"{what} {c} is null")), F.when(F.col(c) < 0, F.lit(f"{what} {c} is negative")) if whole else F.lit(None).cast("string")) for c in columns))
        found = df.select(F.explode(F.array_compact(wrong)).alias("wrong")).head(1)
        if found:
            raise ValueError(found[0]["wrong"])
        twice = df.groupBy("id").count().where("count > 1").head(1)
        if twice:
            raise ValueError(f"duplicate {what} id {twice[0]['id']}")
    for end in ("src", "dest"):
        lost = edges.join(nodes.select(F.col("id").alias(end)), end, "left_anti").head(1)
        if lost:
            raise ValueError(f"edge {lost[0]['id']}: missing {end} node {lost[0][end]}")


def positioned(df: DataFrame, order_by: str | None) -> DataFrame:
    """Adds each row's position: its place by ``order_by``, else by id.

    Integer keys are positions as they are. Other keys are ranked by a range-partitioned sort, whose partitions and rows
    ascend together, so that no task sees more than its range.
    """
    if POSITION in df.columns:
        return df
    key = order_by or "id"
    if isinstance(df.schema[key].dataType, WHOLE):
        return df.withColumn(POSITION, F.col(key).cast("bigint"))
    ranked = cut(df.select("id", F.col(key).alias("_key")).orderBy("_key", "id").select("id", F.monotonically_increasing_id().alias(POSITION)))
    return df.join(ranked, "id")


class Labelled(NamedTuple):
    """Tables built from Python values; engine ids count the labels in order of appearance."""

    nodes: DataFrame
    edges: DataFrame
    labels: list[Hashable]
    edge_labels: dict[Hashable, Hashable] | None


NODE_RESERVED = ("id",)
EDGE_RESERVED = ("id", "src", "dest")


def attributes(value: Any, reserved: tuple[str, ...]) -> dict[str, Any]:
    if not isinstance(value, Mapping):
        raise TypeError("attributes must be a mapping")
    clash = [k for k in reserved if k in value]
    if clash:
        raise ValueError(f"attributes use reserved keys: {', '.join(clash)}")
    return dict(value)


def labelled(spark: SparkSession, edges: Iterable[Any], nodes: Iterable[Any] | None, both_ways: bool = False) -> Labelled:
    """Tables from (src, dest[, attributes]) and label or (label, attributes) items.

    A label that comes again adds to its attributes, the later value winning; attributes that are None everywhere
    make no column. Both ways, each edge is followed by its reverse.
    """
    known: dict[Hashable, dict[str, Any]] = {}
    for item in nodes or ():
        label, extra = item if isinstance(item, tuple) and len(item) == 2 and isinstance(item[1], Mapping) else (item, {})
        known.setdefault(label, {}).update(attributes(extra, NODE_RESERVED))
    links: list[tuple[Hashable, Hashable, dict[str, Any]]] = []
    for item in edges:
        source, target, *rest = item
        if len(rest) > 1:
            raise ValueError("an edge is (src, dest) or (src, dest, attributes)")
        links.append((source, target, attributes(rest[0], EDGE_RESERVED) if rest else {}))
        known.setdefault(source, {})
        known.setdefault(target, {})
    labels = list(known)
    ids = {label: i for i, label in enumerate(labels)}
    node_rows = [{"id": i} | known[label] for i, label in enumerate(labels)]
    edge_rows, edge_labels = [], {}
    for i, (source, target, extra) in enumerate(links):
        ends = [(ids[source], ids[target]), (ids[target], ids[source])] if both_ways else [(ids[source], ids[target])]
        for a, b in ends:
            edge_labels[len(edge_rows)] = i
            edge_rows.append({"id": len(edge_rows), "src": a, "dest": b} | extra)
    return Labelled(frame(spark, node_rows, ["id"]), frame(spark, edge_rows, ["id", "src", "dest"]), labels, edge_labels if both_ways else None)


def type_of(value: Any) -> T.DataType:
    """The Spark type of a Python value."""
    from pathloom.plans.compiler import merged

    if value is None:
        return T.NullType()
    if isinstance(value, bool):
        return T.BooleanType()
    if isinstance(value, int):
        return T.LongType() if -(2**63) <= value < 2**63 else T.DecimalType(38, 0)
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, str):
        return T.StringType()
    if isinstance(value, list):
        kind: T.DataType = T.NullType()
        for v in value:
            kind = merged(kind, type_of(v))
        return T.ArrayType(kind)
    if isinstance(value, Mapping):
        return T.StructType([T.StructField(str(k), type_of(v)) for k, v in value.items()])
    raise TypeError(f"{type(value).__name__} is not supported in a table or a state")


def frame(spark: SparkSession, rows: list[dict[str, Any]], ids: list[str]) -> DataFrame:
    from pathloom.plans.compiler import merged

    kinds: dict[str, T.DataType] = {c: T.LongType() for c in ids}
    for row in rows:
        for name, value in row.items():
            if name not in ids:
                kinds[name] = merged(kinds.get(name, T.NullType()), type_of(value))
    kinds = {n: t for n, t in kinds.items() if not isinstance(t, T.NullType)}
    schema = T.StructType([T.StructField(n, concrete(t)) for n, t in kinds.items()])
    return spark.createDataFrame([tuple(shaped(row.get(n), t) for n, t in kinds.items()) for row in rows], schema)


def concrete(kind: T.DataType) -> T.DataType:
    """A type without parts of unknown type: those become strings, and are null anyway."""
    if isinstance(kind, T.NullType):
        return T.StringType()
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(concrete(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, concrete(f.dataType)) for f in kind])
    return kind


def shaped(value: Any, kind: T.DataType) -> Any:
    """A Python value in the shape that createDataFrame takes for a type."""
    if value is None:
        return None
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value]
    if isinstance(kind, T.StructType):
        return tuple(shaped(value.get(f.name), f.dataType) for f in kind)
    return float(value) if isinstance(kind, T.DoubleType) else value


def with_reverse(edges: DataFrame) -> DataFrame:
    """The edges and, after all of them, the reverse of each, with ids of their own; _original names the edge itself.

    Integer ids go on above the greatest; string ids get the suffix ``__rev``, counted up while any id clashes.
    """
    same = edges.withColumn("_original", F.col("id"))
    turned = same.withColumn("_src", F.col("src")).withColumn("src", F.col("dest")).withColumn("dest", F.col("_src")).drop("_src")
    if isinstance(edges.schema["id"].dataType, T.LongType):
        top = edges.agg(F.max("id"), F.max(POSITION)).first()
        turned = turned.withColumn("id", F.col("id") + F.lit((top[0] if top[0] is not None else -1) + 1)).withColumn(POSITION, F.col(POSITION) + F.lit((top[1] if top[1] is not None else -1) + 1))
    else:
        suffix, count = "__rev", 1
        while edges.join(edges.select(F.concat("id", F.lit(suffix)).alias("id")), "id", "left_semi").head(1):
            count += 1
            suffix = f"__rev_{count}"
        top = edges.agg(F.max(POSITION)).first()[0]
        turned = turned.withColumn("id", F.concat("id", F.lit(suffix))).withColumn(POSITION, F.col(POSITION) + F.lit((top if top is not None else -1) + 1))
    return same.unionByName(turned)
