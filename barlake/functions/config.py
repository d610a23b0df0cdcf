"""Declarative features: a list of specifications becomes one projection.

Each indicator is a function of (row names, window, parameters) that returns
named columns.  Unknown names and parameters raise.  All columns of one window
specification are projected together, so Spark sorts once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec

from .core import series

Builder = Callable[..., dict[str, Column]]
REGISTRY: dict[str, Builder] = {}


@dataclass(frozen=True)
class Feature:
    name: str
    params: dict = field(default_factory=dict)


def indicator(name: str) -> Callable[[Builder], Builder]:
    def register(f: Builder) -> Builder:
        REGISTRY[name] = f
        return f

    return register


def compute(bars: DataFrame, features: list[Feature], *, prefix: str = "", keys=("symbol",), order=("ts",), chunk: int = 60) -> DataFrame:
    """``bars`` with the columns of all ``features``; names get ``prefix``.  Wide lists are projected in chunks, to stay within generated code's limits."""
    from ..operators import finite  # noqa: F401  registers its indicators

    w: WindowSpec = series(keys, order)
    made: dict[str, Column] = {}
    for f in features:
        if f.name not in REGISTRY:
            raise KeyError(f"unknown feature {f.name!r}; there are {sorted(REGISTRY)}")
        made |= {prefix + n: c for n, c in REGISTRY[f.name](w, **f.params).items()}
    names = list(made)
    for i in range(0, len(names), chunk):
        bars = bars.withColumns({n: made[n] for n in names[i : i + chunk]})
    return bars
