"""Expressions over the four scopes of a search: src.*, dest.*, edge.* and state.*.

They are trees that are compiled to Spark columns only when a search knows the schemas
(pathloom.plans.compiler); null and type rules are described there.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column


class Expr:
    """A node: the operator's name, its operands and its settings."""

    def __init__(self, op: str, *args: Expr, **options: Any) -> None:
        self.op, self.args, self.options = op, args, options

    __hash__ = object.__hash__

    def __repr__(self) -> str:
        return f"{self.op}({', '.join([*map(repr, self.args), *(f'{k}={v!r}' for k, v in self.options.items())])})"

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; use & | ~")

    def __and__(self, other: Any) -> Expr:
        return Expr("and", self, wrap(other))

    def __rand__(self, other: Any) -> Expr:
        return Expr("and", wrap(other), self)

    def __or__(self, other: Any) -> Expr:
        return Expr("or", self, wrap(other))

    def __ror__(self, other: Any) -> Expr:
        return Expr("or", wrap(other), self)

    def __invert__(self) -> Expr:
        return Expr("not", self)

    def __eq__(self, other: object) -> Expr:  # type: ignore[override]
        return Expr("eq", self, wrap(other))

    def __ne__(self, other: object) -> Expr:  # type: ignore[override]
        return Expr("ne", self, wrap(other))

    def __lt__(self, other: Any) -> Expr:
        return Expr("lt", self, wrap(other))

    def __le__(self, other: Any) -> Expr:
        return Expr("le", self, wrap(other))

    def __gt__(self, other: Any) -> Expr:
        return Expr("gt", self, wrap(other))

    def __ge__(self, other: Any) -> Expr:
        return Expr("ge", self, wrap(other))

    def __add__(self, other: Any) -> Expr:
        return Expr("add", self, wrap(other))

    def __radd__(self, other: Any) -> Expr:
        return Expr("add", wrap(other), self)

    def __sub__(self, other: Any) -> Expr:
        return Expr("sub", self, wrap(other))

    def __rsub__(self, other: Any) -> Expr:
        return Expr("sub", wrap(other), self)

    def __mul__(self, other: Any) -> Expr:
        return Expr("mul", self, wrap(other))

    def __rmul__(self, other: Any) -> Expr:
        return Expr("mul", wrap(other), self)

    def __truediv__(self, other: Any) -> Expr:
        return Expr("div", self, wrap(other))

    def __rtruediv__(self, other: Any) -> Expr:
        return Expr("div", wrap(other), self)

    def __mod__(self, other: Any) -> Expr:
        return Expr("rem", self, wrap(other))

    def __rmod__(self, other: Any) -> Expr:
        return Expr("rem", wrap(other), self)

    def bit_and(self, other: Any) -> Expr:
        return Expr("bit_and", self, wrap(other))

    def bit_or(self, other: Any) -> Expr:
        return Expr("bit_or", self, wrap(other))

    def bit_xor(self, other: Any) -> Expr:
        return Expr("bit_xor", self, wrap(other))

    def mask_if_any(self, mask: Any, then: Any) -> Expr:
        """0 where no bit of mask is set, else then."""
        return Expr("mask_if_any", self, wrap(mask), wrap(then))

    def is_null(self) -> Expr:
        return Expr("is_null", self)

    def is_not_null(self) -> Expr:
        return Expr("is_not_null", self)

    def cast(self, to: str) -> Expr:
        """to: bool, int, uint, float or string. Only casts that lose nothing by kind are allowed."""
        return Expr("cast", self, to=to)

    def alias(self, name: str) -> Expr:
        return Expr("alias", self, name=name)

    @property
    def list(self) -> Lists:
        return Lists(self)

    @property
    def str(self) -> Strings:
        return Strings(self)

    @property
    def struct(self) -> Structs:
        return Structs(self)

    def to_json(self) -> str:
        return json.dumps(_plain(self))

    @staticmethod
    def from_json(text: str) -> Expr:
        return _built(json.loads(text))


class Strings:
    """Literal substring tests."""

    def __init__(self, of: Expr) -> None:
        self._of = of

    def contains(self, part: Any) -> Expr:
        return Expr("str_contains", self._of, wrap(part))

    def starts_with(self, part: Any) -> Expr:
        return Expr("str_starts_with", self._of, wrap(part))

    def ends_with(self, part: Any) -> Expr:
        return Expr("str_ends_with", self._of, wrap(part))


class Structs:
    def __init__(self, of: Expr) -> None:
        self._of = of

    def field(self, name: str) -> Expr:
        return Expr("struct_field", self._of, name=name)

    def rename_fields(self, names: Iterable[str]) -> Expr:
        return Expr("struct_rename_fields", self._of, names=[*names])

    def with_fields(self, *fields: Expr) -> Expr:
        return Expr("struct_with_fields", self._of, *fields)

    def json_encode(self) -> Expr:
        return Expr("struct_json_encode", self._of)


class Lists:
    """Operations on one list value; none of them multiplies rows."""

    def __init__(self, of: Expr) -> None:
        self._of = of

    def _(self, op: str, *args: Any, **options: Any) -> Expr:
        return Expr(f"list_{op}", self._of, *map(wrap, args), **options)

    def len(self) -> Expr:
        return self._("len")

    def contains(self, item: Any, nulls_equal: bool = True) -> Expr:
        return self._("contains", item, nulls_equal=nulls_equal)

    def get(self, index: Any, null_on_oob: bool = False) -> Expr:
        return self._("get", index, null_on_oob=null_on_oob)

    def first(self) -> Expr:
        return self._("get", 0, null_on_oob=True)

    def last(self) -> Expr:
        return self._("get", -1, null_on_oob=True)

    def slice(self, offset: Any, length: Any) -> Expr:
        return self._("slice", offset, length)

    def reverse(self) -> Expr:
        return self._("reverse")

    def sort(self, descending: bool = False, nulls_last: bool = False) -> Expr:
        return self._("sort", descending=descending, nulls_last=nulls_last)

    def unique(self) -> Expr:
        return self._("unique")

    def drop_nulls(self) -> Expr:
        return self._("drop_nulls")

    def sum(self) -> Expr:
        return self._("sum")

    def min(self) -> Expr:
        return self._("min")

    def max(self) -> Expr:
        return self._("max")

    def arg_min(self) -> Expr:
        return self._("arg_min")

    def arg_max(self) -> Expr:
        return self._("arg_max")

    def mean(self) -> Expr:
        return self._("mean")

    def median(self) -> Expr:
        return self._("median")

    def any(self, ignore_nulls: bool = True) -> Expr:
        return self._("any", ignore_nulls=ignore_nulls)

    def all(self, ignore_nulls: bool = True) -> Expr:
        return self._("all", ignore_nulls=ignore_nulls)

    def count_matches(self, item: Any) -> Expr:
        return self._("count_matches", item)

    def n_unique(self) -> Expr:
        return self._("n_unique")

    def join(self, separator: Any, ignore_nulls: bool = True) -> Expr:
        return self._("join", separator, ignore_nulls=ignore_nulls)

    def shift(self, n: Any = 1) -> Expr:
        return self._("shift", n)

    def gather_every(self, n: Any, offset: Any = 0) -> Expr:
        return self._("gather_every", n, offset)

    def set_union(self, other: Any) -> Expr:
        return self._("set_union", other)

    def set_intersection(self, other: Any) -> Expr:
        return self._("set_intersection", other)

    def set_difference(self, other: Any) -> Expr:
        return self._("set_difference", other)

    def set_symmetric_difference(self, other: Any) -> Expr:
        return self._("set_symmetric_difference", other)

    def eval(self, body: Expr) -> Expr:
        return self._("eval", body)

    def filter(self, predicate: Expr) -> Expr:
        return self._("filter", predicate)

    def explode(self) -> Expr:
        """One level of nesting is removed within the value."""
        return self._("explode")

    def to_struct(self, names: Iterable[str]) -> Expr:
        return self._("to_struct", names=[*names])


class When:
    def __init__(self, branches: tuple[Expr, ...], predicate: Expr) -> None:
        self._branches, self._predicate = branches, predicate

    def then(self, value: Any) -> Then:
        return Then((*self._branches, self._predicate, wrap(value)))


class Then(Expr):
    """Branches so far; what no branch takes is null unless otherwise() says more."""

    def __init__(self, branches: tuple[Expr, ...]) -> None:
        super().__init__("when", *branches, lit(None))
        self._branches = branches

    def when(self, predicate: Any) -> When:
        return When(self._branches, wrap(predicate))

    def otherwise(self, value: Any) -> Expr:
        return Expr("when", *self._branches, wrap(value))


def col(name: str) -> Expr:
    """A column as scope.field, with scope one of src, dest, edge, state."""
    scope, dot, field = name.partition(".")
    if not dot or not field:
        raise ValueError(f"column {name!r} needs a scope: src., dest., edge. or state.")
    if scope not in ("src", "dest", "edge", "state"):
        raise ValueError(f"unknown scope {scope!r} in column {name!r}")
    return Expr("col", scope=scope, field=field)


def lit(value: Any) -> Expr:
    """A literal. A Spark column (also one of a pandas UDF) over the structs src, dest, edge and state stays itself, with Spark's own null rules."""
    if isinstance(value, Expr):
        return value
    return Expr("spark", column=value) if isinstance(value, Column) else Expr("lit", value=value)


wrap = lit


def when(predicate: Any) -> When:
    return When((), wrap(predicate))


def element() -> Expr:
    """The current element; only within list.eval and list.filter."""
    return Expr("element")


def concat_list(items: Iterable[Any]) -> Expr:
    return Expr("concat_list", *map(wrap, items))


def columns_of(expr: Expr) -> set[tuple[str, str]]:
    """(scope, field) of all columns that an expression names."""
    found = {(expr.options["scope"], expr.options["field"])} if expr.op == "col" else set()
    return found.union(*(columns_of(a) for a in expr.args))


def _plain(expr: Expr) -> dict[str, Any]:
    if expr.op == "spark":
        raise TypeError("a Spark column has no serialised form")
    return {"op": expr.op} | ({"args": [_plain(a) for a in expr.args]} if expr.args else {}) | expr.options


def _built(node: Mapping[str, Any]) -> Expr:
    if not isinstance(node, Mapping) or "op" not in node:
        raise ValueError("not a serialised expression")
    return Expr(node["op"], *map(_built, node.get("args", ())), **{k: v for k, v in node.items() if k not in ("op", "args")})
