"""Sets as sorted arrays without repeats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(c: Column) -> Column:
    return F.array_sort(F.array_distinct(c))


def insert(s: Column, x: Column) -> Column:
    return make(F.array_append(s, x))


def erase(s: Column, x: Column) -> Column:
    return F.array_remove(s, x)


def erase_at(s: Column, at: int | Column) -> Column:
    """Without the element at a place, counted from 0; whole if there is none."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.filter(s, lambda x, i: i != at)


def clear(s: Column) -> Column:
    """The empty set of the same type; NULL stays."""
    return F.filter(s, lambda x: F.lit(False))


def find(s: Column, x: Column) -> Column:
    """The place of an element, counted from 0; NULL if it isn't there."""
    at = F.array_position(s, x)
    return F.when(at > 0, at - 1)


def lower_bound(s: Column, x: Column) -> Column:
    """The place of the first element that isn't below one; the set's size if all are."""
    return F.size(F.filter(s, lambda y: y < x))


def at(s: Column, i: int | Column) -> Column:
    """The element at a place, counted from 0; NULL if there is none."""
    return F.get(s, F.lit(i) if isinstance(i, int) else i)


def keep_if(s: Column, f) -> Column:
    return F.filter(s, f)


def erase_if(s: Column, f) -> Column:
    return F.filter(s, lambda x: ~f(x))


def count_if(s: Column, f) -> Column:
    return F.size(F.filter(s, f))


def singleton(s: Column) -> Column:
    """The element of a set of one, else NULL."""
    return F.when(F.size(s) == 1, F.element_at(s, 1))


def is_subset(s: Column, of: Column) -> Column:
    return F.size(F.array_except(s, of)) == 0


def union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def diff(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


contains, least, greatest, size = F.array_contains, F.array_min, F.array_max, F.size
