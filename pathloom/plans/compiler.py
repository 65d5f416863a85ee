"""Compiles expressions to Spark columns, with the search language's rules where they differ from SQL's.

Logic knows no null: a null operand counts as false, and the right operand of and/or is not evaluated where the left one
decides. Equality is null-safe and false between kinds; structs are equal by field name. Ordering and arithmetic
propagate null. Division is always floating point and never raises. List operations propagate a null list. Type
errors are raised when a search is built, except in branches that a literal predicate rules out.

Differences that are meant: integers compare exactly at any size, NaN orders as in Spark and counts as one value in sets,
integer overflow raises, and a null divisor or dividend gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.expr import Expr

NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTIONS = (T.FloatType, T.DoubleType)


class ExpressionError(ValueError):
    """An expression that cannot be compiled against the columns at hand."""


class Value:
    """A compiled expression: its column, and a stand-in for it outside of any lambda, for its type.

    The type is asked of Spark's analyser where the operator does not tell it, and only once it is needed.
    """

    def __init__(self, compiler: Compiler, column: Column, shadow: Column | None = None, known: T.DataType | None = None) -> None:
        self.column, self.shadow = column, column if shadow is None else shadow
        self.compiler, self.known = compiler, known

    @property
    def type(self) -> T.DataType:
        if self.known is None:
            self.known = self.compiler.type_of(self.shadow)
        return self.known


def kind(t: T.DataType) -> str:
    if isinstance(t, NUMBERS):
        return "number"
    return {T.BooleanType: "bool", T.StringType: "string", T.ArrayType: "list", T.StructType: "struct", T.NullType: "null"}.get(type(t), "unsupported")


def merged(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both; structs by field name."""
    if isinstance(a, T.NullType) or a == b:
        return b
    if isinstance(b, T.NullType):
        return a
    if kind(a) == kind(b) == "number":
        if isinstance(a, FRACTIONS) or isinstance(b, FRACTIONS):
            return T.DoubleType()
        return a if isinstance(a, T.DecimalType) else b if isinstance(b, T.DecimalType) else T.LongType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(merged(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = [*a.fieldNames(), *(n for n in b.fieldNames() if n not in a.fieldNames())]
        of = lambda s, n: s[n].dataType if n in s.fieldNames() else T.NullType()
        return T.StructType([T.StructField(n, merged(of(a, n), of(b, n))) for n in names])
    raise ExpressionError(f"{a.simpleString()} and {b.simpleString()} have no common type")


def fitted(column: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column as another type that merged() gave: structs are rebuilt by field name."""
    if have == want:
        return column
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        fields = [(fitted(column[f.name], have[f.name].dataType, f.dataType) if f.name in have.fieldNames() else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(column, lambda x: fitted(x, have.elementType, want.elementType))
    return column.cast(want)


def literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, dict):
        return F.struct(*(literal(v).alias(k) for k, v in value.items()))
    if isinstance(value, bool) or value is None or isinstance(value, (str, float)):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("bigint") if -(2**63) <= value < 2**63 else F.lit(str(value)).cast("decimal(38,0)")
    raise ExpressionError(f"{type(value).__name__} has no literal")


class Compiler:
    """frame: an (empty) frame with the columns src, dest, edge and state, all structs."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame, self.scopes = frame, frame.schema
        self.elements: list[Value] = []

    def type_of(self, column: Column) -> T.DataType:
        try:
            return self.frame.select(column.alias("x")).schema[0].dataType
        except AnalysisException as error:
            raise ExpressionError(str(error).split("\n")[0]) from error

    def compile(self, expr: Expr) -> Value:
        handler = getattr(self, f"_{expr.op}", None)
        if handler is None:
            if expr.op.startswith("list_"):
                return self.list_op(expr)
            raise NotImplementedError(f"unsupported expression: {expr.op}")
        return handler(expr)

    def value(self, of: Callable[..., Column], *args: Value, known: T.DataType | None = None) -> Value:
        """Applies of to the columns, and to their stand-ins."""
        column = of(*(a.column for a in args))
        return Value(self, column, column if all(a.column is a.shadow for a in args) else of(*(a.shadow for a in args)), known)

    def operands(self, expr: Expr, *kinds: str) -> list[Value]:
        found = [self.compile(a) for a in expr.args]
        for v in found:
            if kinds and kind(v.type) not in (*kinds, "null"):
                raise ExpressionError(f"{expr.op} needs {' or '.join(kinds)}, got {v.type.simpleString()}")
        return found

    # Columns and literals

    def _col(self, expr: Expr) -> Value:
        scope, field = expr.options["scope"], expr.options["field"]
        if scope == "edge" and field in ("src", "dest"):
            scope, field = field, "id"
        fields = self.scopes[scope].dataType
        if field not in fields.fieldNames():
            if scope == "state":
                return Value(self, F.lit(None), known=T.NullType())
            raise ExpressionError(f'column "{field}" is missing in {scope}')
        found = Value(self, F.col(scope).getField(field), known=fields[field].dataType)
        if kind(found.type) == "unsupported":
            raise ExpressionError(f"unsupported column type: {found.type.simpleString()}")
        if isinstance(found.type, (T.ByteType, T.ShortType, T.IntegerType)):
            return Value(self, found.column.cast("bigint"), known=T.LongType())
        return Value(self, found.column.cast("double"), known=T.DoubleType()) if isinstance(found.type, T.FloatType) else found

    def _lit(self, expr: Expr) -> Value:
        value = expr.options["value"]
        known = {bool: T.BooleanType(), str: T.StringType(), float: T.DoubleType(), type(None): T.NullType()}.get(type(value))
        return Value(self, literal(value), known=known)

    def _spark(self, expr: Expr) -> Value:
        return Value(self, expr.options["column"])

    def _alias(self, expr: Expr) -> Value:
        return self.compile(expr.args[0])

    def _element(self, expr: Expr) -> Value:
        if not self.elements:
            raise ExpressionError("element() is only known within list.eval and list.filter")
        return self.elements[-1]

    # Logic

    def truth(self, v: Value, op: str) -> Value:
        if kind(v.type) not in ("bool", "null"):
            raise ExpressionError(f"{op} needs bool, got {v.type.simpleString()}")
        return self.value(lambda c: F.coalesce(c.cast("boolean"), F.lit(False)), v, known=T.BooleanType())

    def predicate(self, expr: Expr) -> Value:
        return self.truth(self.compile(expr), "a predicate")

    def _and(self, expr: Expr) -> Value:
        a, b = (self.truth(v, "and") for v in self.operands(expr))
        return self.value(lambda x, y: F.when(x, y).otherwise(F.lit(False)) if raises(expr.args[1]) else x & y, a, b, known=T.BooleanType())

    def _or(self, expr: Expr) -> Value:
        a, b = (self.truth(v, "or") for v in self.operands(expr))
        return self.value(lambda x, y: F.when(x, F.lit(True)).otherwise(y) if raises(expr.args[1]) else x | y, a, b, known=T.BooleanType())

    def _not(self, expr: Expr) -> Value:
        return self.value(lambda x: ~x, *(self.truth(v, "not") for v in self.operands(expr)), known=T.BooleanType())

    def _is_null(self, expr: Expr) -> Value:
        return self.value(lambda x: x.isNull(), *self.operands(expr), known=T.BooleanType())

    def _is_not_null(self, expr: Expr) -> Value:
        return self.value(lambda x: x.isNotNull(), *self.operands(expr), known=T.BooleanType())

    def same(self, a: Value, b: Value) -> Callable[[Column, Column], Column]:
        """Null-safe equality of two columns of the operands' types."""
        if "null" not in (kind(a.type), kind(b.type)) and not alike(a.type, b.type):
            return lambda x, y: x.isNull() & y.isNull()
        want = merged(a.type, b.type)
        return lambda x, y: fitted(x, a.type, want).eqNullSafe(fitted(y, b.type, want))

    def _eq(self, expr: Expr) -> Value:
        a, b = self.operands(expr)
        return self.value(self.same(a, b), a, b, known=T.BooleanType())

    def _ne(self, expr: Expr) -> Value:
        a, b = self.operands(expr)
        same = self.same(a, b)
        return self.value(lambda x, y: ~same(x, y), a, b, known=T.BooleanType())

    def _ordered(self, expr: Expr, of: Callable[[Column, Column], Column]) -> Value:
        a, b = self.operands(expr, "bool", "string", "number")
        if "null" not in (kind(a.type), kind(b.type)) and kind(a.type) != kind(b.type):
            raise ExpressionError(f"{a.type.simpleString()} and {b.type.simpleString()} have no order")
        return self.value(lambda x, y: of(x, y).cast("boolean"), a, b, known=T.BooleanType())

    def _lt(self, expr: Expr) -> Value:
        return self._ordered(expr, lambda x, y: x < y)

    def _le(self, expr: Expr) -> Value:
        return self._ordered(expr, lambda x, y: x <= y)

    def _gt(self, expr: Expr) -> Value:
        return self._ordered(expr, lambda x, y: x > y)

    def _ge(self, expr: Expr) -> Value:
        return self._ordered(expr, lambda x, y: x >= y)

    # Numbers

    def _arithmetic(self, expr: Expr, of: Callable[[Column, Column], Column]) -> Value:
        a, b = self.operands(expr, "number")
        want = merged(merged(a.type, b.type), T.NullType())
        want = T.LongType() if isinstance(want, T.NullType) else want
        return self.value(lambda x, y: of(x.cast(want), y.cast(want)).cast(want), a, b, known=want)

    def _add(self, expr: Expr) -> Value:
        return self._arithmetic(expr, lambda x, y: x + y)

    def _sub(self, expr: Expr) -> Value:
        return self._arithmetic(expr, lambda x, y: x - y)

    def _mul(self, expr: Expr) -> Value:
        return self._arithmetic(expr, lambda x, y: x * y)

    def _div(self, expr: Expr) -> Value:
        def divided(x: Column, y: Column) -> Column:
            x, y = x.cast("double"), y.cast("double")
            by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf")))
            return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))

        return self.value(divided, *self.operands(expr, "number"), known=T.DoubleType())

    def _rem(self, expr: Expr) -> Value:
        a, b = self.operands(expr, "number")
        if isinstance(a.type, FRACTIONS) or isinstance(b.type, FRACTIONS):
            raise ExpressionError("% needs integers")
        return self.value(lambda x, y: x.cast("bigint") % y.cast("bigint"), a, b, known=T.LongType())

    def unsigned(self, v: Value, op: str) -> Value:
        if isinstance(v.type, FRACTIONS):
            raise ExpressionError(f"{op} needs integers")
        return self.value(lambda x: F.when(x.cast("bigint") < 0, F.raise_error(F.lit(f"{op} needs integers of 0 or more"))).otherwise(x.cast("bigint")), v)

    def _bits(self, expr: Expr, of: Callable[[Column, Column], Column]) -> Value:
        return self.value(of, *(self.unsigned(v, expr.op) for v in self.operands(expr, "number")))

    def _bit_and(self, expr: Expr) -> Value:
        return self._bits(expr, lambda x, y: x.bitwiseAND(y))

    def _bit_or(self, expr: Expr) -> Value:
        return self._bits(expr, lambda x, y: x.bitwiseOR(y))

    def _bit_xor(self, expr: Expr) -> Value:
        return self._bits(expr, lambda x, y: x.bitwiseXOR(y))

    def _mask_if_any(self, expr: Expr) -> Value:
        v, mask, then = (self.unsigned(x, expr.op) for x in self.operands(expr, "number"))
        return self.value(lambda x, m, t: F.when(x.bitwiseAND(m) == 0, F.lit(0).cast("bigint")).when(x.bitwiseAND(m) != 0, t), v, mask, then)

    def _cast(self, expr: Expr) -> Value:
        (v,), to = self.operands(expr), expr.options["to"]
        have, whole = kind(v.type), not isinstance(v.type, FRACTIONS)
        if have == "null":
            return Value(self, F.lit(None).cast({"bool": "boolean", "int": "bigint", "uint": "bigint", "float": "double", "string": "string"}[to]))
        if to == "bool" and have == "bool":
            return v
        if to in ("int", "uint") and have == "number" and whole:
            cast = self.value(lambda x: x.cast("bigint"), v)
            return self.unsigned(cast, "cast to uint") if to == "uint" else cast
        if to == "float" and have == "number":
            return self.value(lambda x: x.cast("double"), v)
        if to == "string":
            if have in ("list", "struct"):
                return self.value(lambda x: json_text(x, v.type), v)
            return v if have == "string" else self.value(lambda x: x.cast("string") if whole or have == "bool" else plain_float(x), v)
        raise ExpressionError(f"cannot cast {v.type.simpleString()} to {to}")

    def _when(self, expr: Expr) -> Value:
        *pairs, otherwise = expr.args
        branches: list[tuple[Value | None, Value]] = []
        for predicate, body in zip(pairs[::2], pairs[1::2], strict=True):
            if predicate.op == "lit":  # a branch that a literal rules out is not even compiled
                if predicate.options["value"] is True:
                    branches.append((None, self.compile(body)))
                    break
                continue
            branches.append((self.predicate(predicate), self.compile(body)))
        else:
            branches.append((None, self.compile(otherwise)))
        lists = [isinstance(v.type, T.ArrayType) for _, v in branches if kind(v.type) != "null"]
        lift = any(lists) and not all(lists)  # a scalar beside a list counts as a list of one
        bodies = [self.value(lambda x: F.array(x), v) if lift and kind(v.type) not in ("list", "null") else v for _, v in branches]
        want: T.DataType = T.NullType()
        for v in bodies:
            want = merged(want, v.type)

        def chained(take: Callable[[Value], Column]) -> Column:
            result = fitted(take(bodies[-1]), bodies[-1].type, want)
            for (predicate, _), body in list(zip(branches, bodies, strict=True))[-2::-1]:
                result = F.when(take(predicate), fitted(take(body), body.type, want)).otherwise(result)
            return result

        return Value(self, chained(lambda v: v.column), chained(lambda v: v.shadow), want)

    # Strings

    def _strings(self, expr: Expr, of: Callable[[Column, Column], Column]) -> Value:
        return self.value(lambda x, y: of(x.cast("string"), y.cast("string")), *self.operands(expr, "string"), known=T.BooleanType())

    def _str_contains(self, expr: Expr) -> Value:
        return self._strings(expr, F.contains)

    def _str_starts_with(self, expr: Expr) -> Value:
        return self._strings(expr, F.startswith)

    def _str_ends_with(self, expr: Expr) -> Value:
        return self._strings(expr, F.endswith)

    # Structs

    def _struct(self, expr: Expr) -> Value:
        v = self.compile(expr.args[0])
        if kind(v.type) not in ("struct", "null"):
            raise ExpressionError(f"{expr.op} needs struct, got {v.type.simpleString()}")
        return v

    def _struct_field(self, expr: Expr) -> Value:
        v, name = self._struct(expr), expr.options["name"]
        known = isinstance(v.type, T.StructType) and name in v.type.fieldNames()
        return self.value(lambda x: x.getField(name), v) if known else Value(self, F.lit(None))

    def _struct_rename_fields(self, expr: Expr) -> Value:
        v = self._struct(expr)
        if not isinstance(v.type, T.StructType):
            return v
        names = [*expr.options["names"]]
        names += [f"field_{i}" for i in range(len(names), len(v.type))]
        return self.value(lambda x: F.when(x.isNotNull(), F.struct(*(x.getField(f.name).alias(n) for f, n in zip(v.type, names, strict=False)))), v)

    def _struct_with_fields(self, expr: Expr) -> Value:
        v = self._struct(expr)
        if not isinstance(v.type, T.StructType):
            return v
        if any(a.op != "alias" for a in expr.args[1:]):
            raise ExpressionError("with_fields needs named fields; use alias()")
        new = {a.options["name"]: self.compile(a) for a in expr.args[1:]}
        names = [*v.type.fieldNames(), *(n for n in new if n not in v.type.fieldNames())]
        return self.value(lambda x, *fields: F.when(x.isNotNull(), F.struct(*((dict(zip(new, fields, strict=True))[n] if n in new else x.getField(n)).alias(n) for n in names))), v, *new.values())

    def _struct_json_encode(self, expr: Expr) -> Value:
        v = self._struct(expr)
        return self.value(lambda x: json_text(x, v.type), v) if isinstance(v.type, T.StructType) else Value(self, F.lit(None).cast("string"))

    # Lists

    def _concat_list(self, expr: Expr) -> Value:
        values = [self.compile(a) for a in expr.args]
        want: T.DataType = T.NullType()
        for v in values:
            want = merged(want, v.type.elementType if isinstance(v.type, T.ArrayType) else v.type)

        def part(x: Column, t: T.DataType) -> Column:
            if isinstance(t, T.ArrayType):
                return F.when(x.isNull(), F.array(F.lit(None).cast(want))).otherwise(fitted(x, t, T.ArrayType(want)))
            return F.array(fitted(x, t, want))

        return self.value(lambda *xs: F.concat(*(part(x, v.type) for x, v in zip(xs, values, strict=True))), *values)

    def list_op(self, expr: Expr) -> Value:
        from pathloom.functions.lists import OPS

        of = OPS.get(expr.op.removeprefix("list_"))
        if of is None:
            raise NotImplementedError(f"unsupported expression: {expr.op}")
        v = self.compile(expr.args[0])
        if kind(v.type) not in ("list", "null"):
            raise ExpressionError(f"{expr.op} needs list, got {v.type.simpleString()}")
        if kind(v.type) == "null":
            v = Value(self, F.lit(None).cast("array<void>"))
        return of(self, v, expr)

    def within(self, v: Value, body: Expr, then: Callable[[Value, Value, Column], Column]) -> Callable[[Column], Column]:
        """then(element, compiled body, element's column) for a lambda over the elements of v."""
        stand_in = F.lit(None).cast(v.type.elementType)

        def lambda_body(x: Column) -> Column:
            self.elements.append(Value(self, x, stand_in))
            try:
                return then(self.elements[-1], self.compile(body), x)
            finally:
                self.elements.pop()

        return lambda_body

    def body_of(self, v: Value, body: Expr) -> Value:
        """The body as seen from outside, for its type."""
        self.elements.append(Value(self, F.lit(None).cast(v.type.elementType)))
        try:
            return self.compile(body)
        finally:
            self.elements.pop()


def alike(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of two types can be equal at all."""
    if "null" in (kind(a), kind(b)):
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return alike(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return {*a.fieldNames()} == {*b.fieldNames()} and all(alike(f.dataType, b[f.name].dataType) for f in a)
    return kind(a) == kind(b)


def raises(expr: Expr) -> bool:
    """Whether evaluating an expression can raise, so that it must stay behind its guard."""
    own = expr.op in ("rem", "add", "sub", "mul", "bit_and", "bit_or", "bit_xor", "mask_if_any", "cast", "list_get", "list_gather_every", "list_sum")
    return own or any(map(raises, expr.args))


def plain_float(x: Column) -> Column:
    """A float without exponent and without a needless fraction."""
    text = x.cast("string")
    whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
    long = F.regexp_replace(F.format_number(x, 30), ",", "")
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).when(whole, x.cast("bigint").cast("string")).when(
        ~text.contains("E"), text).otherwise(F.regexp_replace(F.regexp_replace(long, "0+$", ""), r"\.$", ""))


def json_ready(x: Column, t: T.DataType) -> Column:
    """A value with sorted fields, and null for floats that JSON has no form for."""
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(json_ready(x.getField(f.name), f.dataType).alias(f.name) for f in sorted(t, key=lambda f: f.name))))
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: json_ready(e, t.elementType))
    return F.when(F.abs(x) < float("inf"), x) if isinstance(t, FRACTIONS) else x


def json_text(x: Column, t: T.DataType) -> Column:
    return F.to_json(json_ready(x, t), {"ignoreNullFields": "false"})
