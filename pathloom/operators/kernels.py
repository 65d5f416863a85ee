"""Kernels: what a search asks of each edge; and the registry of named ones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pathloom.functions.expr import Expr, col, lit, when


def expression(value: Any) -> Expr:
    """A string is a serialised expression; other plain values are literals."""
    return Expr.from_json(value) if isinstance(value, str) else lit(value)


class Kernel:
    """visit: which candidate edges to follow (default all). next_state: fields of the new state, all from the old one.
    stop: whether the path ends here, on the new state (default never). initial_state: plain values, or expressions over the
    start node as src."""

    def __init__(self, visit: Any = None, next_state: Mapping[str, Any] | None = None, stop: Any = None, initial_state: Mapping[str, Any] | None = None) -> None:
        self.visit: Expr = expression(True if visit is None else visit)
        self.next_state: dict[str, Expr] = {k: expression(v) for k, v in (next_state or {}).items()}
        self.stop: Expr = expression(False if stop is None else stop)
        self.initial_state: dict[str, Any] = dict(initial_state or {})

    def expressions(self) -> list[Expr]:
        return [self.visit, *self.next_state.values(), self.stop]


Factory = Callable[[Mapping[str, Any]], Kernel]
REGISTRY: dict[str, Factory] = {}


def register_kernel(name: str) -> Callable[[Factory], Factory]:
    """Registers a factory from params to a kernel; a name is registered once."""

    def add(factory: Factory) -> Factory:
        if name in REGISTRY:
            raise ValueError(f"kernel {name!r} is already registered")
        REGISTRY[name] = factory
        return factory

    return add


def named_kernel(name: str, params: Mapping[str, Any] | None) -> Kernel:
    if name not in REGISTRY:
        raise ValueError(f"unknown kernel {name!r}; known: {', '.join(sorted(REGISTRY))}")
    checked(params or {})
    return REGISTRY[name](params or {})


def checked(value: Any) -> None:
    """Params are plain values: no non-finite floats, only string keys."""
    if isinstance(value, float) and not (abs(value) < float("inf")):
        raise ValueError("params must be finite")
    if isinstance(value, Mapping):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("params need string keys")
        for v in value.values():
            checked(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            checked(v)


def required(params: Mapping[str, Any], name: str, kind: type | tuple[type, ...]) -> Any:
    if not isinstance(params.get(name), kind) or isinstance(params[name], bool):
        raise ValueError(f"param {name!r} is required")
    return params[name]


@register_kernel("weighted_budget")
def weighted_budget(params: Mapping[str, Any]) -> Kernel:
    """Paths to a target whose edge weights sum to a budget at most; a null weight is 0."""
    weight = col(f"edge.{required(params, 'weight_col', str)}")
    spent = col("state.spent") + when(weight.is_null()).then(0).otherwise(weight)
    return Kernel(spent <= required(params, "budget", int), {"spent": spent}, col("dest.id") == required(params, "target", (int, str)), {"spent": 0})


@register_kernel("hop_budget")
def hop_budget(params: Mapping[str, Any]) -> Kernel:
    """Paths over enabled edges that end at a target node, or where the sum of hop costs uses up the budget."""
    most = required(params, "max_hops", int)
    policy, profile = col(f"edge.{required(params, 'policy_col', str)}"), col(f"dest.{required(params, 'profile_col', str)}")
    costs = policy.struct.field("hop_costs").list.sum()
    hops = col("state.hops") + when(costs.is_null()).then(0).otherwise(costs)
    return Kernel(policy.struct.field("enabled") & (hops <= most), {"hops": hops}, (col("state.hops") >= most) | profile.struct.field("target"), {"hops": 0})
