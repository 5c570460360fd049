"""Lattices: columns whose values of one key merge to a least upper bound.

A bottom is NULL on the way, which every merge skips; a result shows ``bottom``, which for the minimum and the
maximum is NULL as well, since no value of the column's type is below or above all others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lattice:
    """``type``: Spark's type of a value; ``merge`` aggregates, ``join`` is the bound of two, ``improves`` tells whether
    a new value isn't below the old one, ``lift`` makes a value of a raw one."""

    name: str
    type: str
    merge: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    improves: Callable[[Column, Column], Column]
    lift: Callable[[Column], Column] = lambda c: c
    bottom: Callable[[], Column] | None = None

    def shown(self, value: Column) -> Column:
        return F.coalesce(value, self.bottom()) if self.bottom else value

    def better(self, new: Column, old: Column) -> Column:
        return new.isNotNull() & (old.isNull() | self.improves(new, old))


def lmin(type: str = "bigint") -> Lattice:
    return Lattice("lmin", type, F.min, F.least, lambda new, old: new < old)


def lmax(type: str = "bigint") -> Lattice:
    return Lattice("lmax", type, F.max, F.greatest, lambda new, old: new > old)


def lbitset(type: str = "bigint") -> Lattice:
    either = lambda a, b: F.coalesce(a.bitwiseOR(b), a, b)
    return Lattice("lbitset", type, F.bit_or, either, lambda new, old: new.bitwiseAND(F.bitwise_not(old)) != 0, bottom=lambda: F.lit(0).cast(type))


def lset(element: str = "bigint") -> Lattice:
    """Values are arrays, sorted and without repeats, so that equal sets are equal arrays."""
    array = f"array<{element}>"
    return Lattice(
        "lset", array,
        lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))),
        lambda a, b: F.coalesce(F.array_sort(F.array_union(a, b)), a, b),
        lambda new, old: F.size(F.array_except(new, old)) > 0,
        lambda c: F.array(c).cast(array),
        lambda: F.array().cast(array),
    )


def custom(name: str, type: str, merge, join, improves, lift=lambda c: c, bottom=None) -> Lattice:
    """A lattice of the caller's own; the three functions take and give columns, so they may be pandas functions too."""
    return Lattice(name, type, merge, join, improves, lift, bottom)


def of_code(name: str, type: str, update: Callable[[Any, Any], Any], monus: Callable[[Any, Any], Any] | None = None, lift=lambda c: c, bottom=None) -> Lattice:
    """A lattice of any Python code: ``update(a, b)`` is the bound of two values, and ``monus(new, old)`` None if the new one
    adds nothing to the old (by default: if their bound is the old one).  Values come in Arrow batches; those of one key
    are folded in a task, so it is for lattices that no function of columns can express.
    """

    def value(x: Any) -> Any:
        return None if x is None or x is pd.NA or isinstance(x, float) and x != x else x

    def bound(a: Any, b: Any) -> Any:
        a, b = value(a), value(b)
        return b if a is None else a if b is None else update(a, b)

    def fold(lists: pd.Series) -> pd.Series:
        return pd.Series([reduce(bound, x, None) if x is not None else None for x in lists], dtype=object)

    def join(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bound(x, y) for x, y in zip(a, b)], dtype=object)

    def improves(new: pd.Series, old: pd.Series) -> pd.Series:
        adds = monus or (lambda x, y: None if update(x, y) == y else x)
        return pd.Series([value(x) is not None and (value(y) is None or adds(value(x), value(y)) is not None) for x, y in zip(new, old)], dtype=bool)

    folded, joined, better = F.pandas_udf(fold, type), F.pandas_udf(join, type), F.pandas_udf(improves, "boolean")
    return Lattice(name, type, lambda c: folded(F.collect_list(c)), joined, better, lift, bottom)
