"""The list operations: each takes the compiler, the compiled list and the expression, and gives a value.

A null list gives null, whatever the operation.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from pathloom.functions.expr import Expr
    from pathloom.plans.compiler import Compiler, Value

Op = Callable[["Compiler", "Value", "Expr"], "Value"]
OPS: dict[str, Op] = {}


def op(name: str) -> Callable[[Op], Op]:
    def add(f: Op) -> Op:
        OPS[name] = f
        return f

    return add


def simple(name: str, of: Callable[[Column], Column], known: Callable[[T.ArrayType], T.DataType]) -> None:
    """known: the result's type from the list's."""
    OPS[name] = lambda c, v, e: c.value(lambda x: F.when(x.isNotNull(), of(x)), v, known=known(v.type))


def index_of(best: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: (F.nullif(F.array_position(x, best(x)), F.lit(0)) - 1).cast("bigint")


def doubles(x: Column) -> Column:
    return F.transform(F.array_compact(x), lambda e: e.cast("double"))


WHOLE, ITSELF, ITEM = (lambda t: T.LongType()), (lambda t: t), (lambda t: t.elementType)
simple("len", lambda x: F.size(x).cast("bigint"), WHOLE)
simple("reverse", F.reverse, ITSELF)
simple("unique", F.array_distinct, ITSELF)
simple("drop_nulls", F.array_compact, ITSELF)
simple("min", F.array_min, ITEM)
simple("max", F.array_max, ITEM)
simple("arg_min", index_of(F.array_min), WHOLE)
simple("arg_max", index_of(F.array_max), WHOLE)
simple("n_unique", lambda x: F.size(F.array_distinct(x)).cast("bigint"), WHOLE)
simple("mean", lambda x: F.when(F.size(F.array_compact(x)) > 0, F.aggregate(doubles(x), F.lit(0.0), lambda s, e: s + e) / F.size(F.array_compact(x))), lambda t: T.DoubleType())


def need(c: Compiler, v: Value, expr: Expr, *kinds: str) -> None:
    from pathloom.plans.compiler import ExpressionError, kind

    if kind(v.type.elementType) not in (*kinds, "null"):
        raise ExpressionError(f"{expr.op} needs a list of {' or '.join(kinds)}, got {v.type.simpleString()}")


@op("sum")
def _sum(c: Compiler, v: Value, expr: Expr) -> Value:
    from pathloom.plans.compiler import FRACTIONS

    need(c, v, expr, "number")
    zero = F.lit(0.0) if isinstance(v.type.elementType, FRACTIONS) else F.lit(0).cast("bigint")
    to = "double" if isinstance(v.type.elementType, FRACTIONS) else "bigint"
    return c.value(lambda x: F.aggregate(x, zero, lambda s, e: s + F.coalesce(e.cast(to), zero)), v)


@op("median")
def _median(c: Compiler, v: Value, expr: Expr) -> Value:
    """The middle value as it is (a float beside a list of floats), or the mean of the two middle ones; a float either way here."""
    need(c, v, expr, "number")

    def of(x: Column) -> Column:
        values = F.array_sort(doubles(x))
        n = F.size(values)
        upper, lower = F.get(values, (n / 2).cast("int")), F.get(values, ((n - 1) / 2).cast("int"))
        return F.when(n > 0, (upper + lower) / 2)

    return c.value(of, v)


@op("sort")
def _sort(c: Compiler, v: Value, expr: Expr) -> Value:
    need(c, v, expr, "bool", "number", "string")
    down, last = expr.options.get("descending", False), expr.options.get("nulls_last", False)

    def of(x: Column) -> Column:
        values = F.sort_array(F.array_compact(x), not down)
        nulls = F.filter(x, lambda e: e.isNull())
        return F.concat(values, nulls) if last else F.concat(nulls, values)

    return c.value(of, v)


def item(c: Compiler, v: Value, expr: Expr) -> tuple[Value, Callable[[Column, Column], Column]]:
    """The operation's operand, and its equality with an element."""
    from pathloom.plans.compiler import Value as Compiled

    needle = c.compile(expr.args[1])
    return needle, c.same(Compiled(c, F.lit(None).cast(v.type.elementType)), needle)


@op("contains")
def _contains(c: Compiler, v: Value, expr: Expr) -> Value:
    needle, same = item(c, v, expr)
    equal = expr.options.get("nulls_equal", True)

    def of(x: Column, y: Column) -> Column:
        found = F.exists(x, lambda e: same(e, y))
        return F.when(x.isNotNull(), found if equal else F.when(y.isNotNull(), found))

    return c.value(of, v, needle)


@op("count_matches")
def _count_matches(c: Compiler, v: Value, expr: Expr) -> Value:
    needle, same = item(c, v, expr)
    return c.value(lambda x, y: F.when(x.isNotNull(), F.size(F.filter(x, lambda e: same(e, y))).cast("bigint")), v, needle)


@op("get")
def _get(c: Compiler, v: Value, expr: Expr) -> Value:
    index = c.compile(expr.args[1])

    def of(x: Column, i: Column) -> Column:
        place = F.when(i < 0, F.size(x) + i).otherwise(i)
        inside = (place >= 0) & (place < F.size(x))
        found = F.when(inside, F.get(x, place.cast("int")))
        if expr.options.get("null_on_oob", False):
            return found
        return F.when(x.isNotNull() & i.isNotNull() & ~inside, F.raise_error(F.lit("list index is out of bounds")).cast(v.type.elementType)).otherwise(found)

    return c.value(of, v, index)


@op("slice")
def _slice(c: Compiler, v: Value, expr: Expr) -> Value:
    """A negative offset counts from the end and stops at the beginning; the length counts from there."""
    offset, length = (c.compile(a) for a in expr.args[1:])

    def of(x: Column, o: Column, n: Column) -> Column:
        start = F.greatest(F.when(o < 0, F.size(x) + o).otherwise(o), F.lit(0))
        return F.when(x.isNotNull() & o.isNotNull(), F.when(n.isNull(), F.raise_error(F.lit("list.slice needs a length")).cast(v.type)).otherwise(
            F.slice(x, (start + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int"))))

    return c.value(of, v, offset, length)


def truths(name: str, over: Callable[[Column, Callable[[Column], Column]], Column], neutral: bool) -> None:
    def of(c: Compiler, v: Value, expr: Expr) -> Value:
        need(c, v, expr, "bool")
        ignore = expr.options.get("ignore_nulls", True)
        return c.value(lambda x: F.when(x.isNotNull(), over(x, lambda e: F.coalesce(e, F.lit(neutral)) if ignore else e.cast("boolean"))), v)

    OPS[name] = of


truths("any", F.exists, False)
truths("all", F.forall, True)


@op("join")
def _join(c: Compiler, v: Value, expr: Expr) -> Value:
    need(c, v, expr, "string")
    separator = c.compile(expr.args[1])

    def of(x: Column, s: Column) -> Column:
        values = F.array_compact(x) if expr.options.get("ignore_nulls", True) else x
        text = F.aggregate(values, F.lit(None).cast("string"), lambda done, e: F.when(done.isNull(), e).otherwise(F.concat(done, s, e)))
        joined = F.coalesce(text, F.lit(""))
        return F.when(x.isNotNull() & s.isNotNull() & ~F.exists(values, lambda e: e.isNull()), joined)

    return c.value(of, v, separator)


@op("shift")
def _shift(c: Compiler, v: Value, expr: Expr) -> Value:
    n = c.compile(expr.args[1])
    return c.value(lambda x, k: F.transform(x, lambda e, i: F.when((i - k >= 0) & (i - k < F.size(x)), F.get(x, (i - k).cast("int")))), v, n)


@op("gather_every")
def _gather_every(c: Compiler, v: Value, expr: Expr) -> Value:
    n, offset = (c.compile(a) for a in expr.args[1:])

    def of(x: Column, k: Column, o: Column) -> Column:
        first = F.greatest(o, F.lit(0))
        kept = F.filter(x, lambda e, i: (i >= first) & ((i - first) % F.greatest(k, F.lit(1)) == 0))
        return F.when(k <= 0, F.raise_error(F.lit("list.gather_every needs a step of 1 or more")).cast(v.type)).otherwise(kept)

    return c.value(of, v, n, offset)


def sets(name: str, of: Callable[[Column, Column], Column]) -> None:
    def compiled(c: Compiler, v: Value, expr: Expr) -> Value:
        from pathloom.plans.compiler import ExpressionError, fitted, kind, merged

        other = c.compile(expr.args[1])
        if kind(other.type) not in ("list", "null"):
            raise ExpressionError(f"{expr.op} needs list, got {other.type.simpleString()}")
        want = merged(v.type, other.type)
        return c.value(lambda x, y: of(fitted(x, v.type, want), fitted(y, other.type, want)), v, other)

    OPS[f"set_{name}"] = compiled


sets("union", F.array_union)
sets("intersection", F.array_intersect)
sets("difference", F.array_except)
sets("symmetric_difference", lambda a, b: F.array_union(F.array_except(a, b), F.array_except(b, a)))


@op("eval")
def _eval(c: Compiler, v: Value, expr: Expr) -> Value:
    from pathloom.plans.compiler import Value as Compiled

    body = c.body_of(v, expr.args[1])
    shadow = F.when(v.shadow.isNotNull(), F.array(body.shadow))
    return Compiled(c, F.transform(v.column, c.within(v, expr.args[1], lambda e, b, x: b.column)), shadow)


@op("filter")
def _filter(c: Compiler, v: Value, expr: Expr) -> Value:
    from pathloom.plans.compiler import Value as Compiled

    c.truth(c.body_of(v, expr.args[1]), "list.filter")
    return Compiled(c, F.filter(v.column, c.within(v, expr.args[1], lambda e, b, x: c.truth(b, "list.filter").column)), v.shadow)


@op("explode")
def _explode(c: Compiler, v: Value, expr: Expr) -> Value:
    inner = v.type.elementType
    if not isinstance(inner, T.ArrayType):
        return v
    nothing = F.array(F.lit(None).cast(inner.elementType))
    return c.value(lambda x: F.flatten(F.transform(x, lambda e: F.when(e.isNull() | (F.size(e) == 0), nothing).otherwise(e))), v)


@op("to_struct")
def _to_struct(c: Compiler, v: Value, expr: Expr) -> Value:
    return c.value(lambda x: F.when(x.isNotNull(), F.struct(*(F.get(x, F.lit(i)).alias(n) for i, n in enumerate(expr.options["names"])))), v)
