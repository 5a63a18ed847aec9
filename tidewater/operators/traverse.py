"""Combinators over arrays, for flat-mapping without leaving the JVM: each takes and gives an array column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Fn = Callable[[Column], Column]


def map_items(items: Column, fn: Fn) -> Column:
    """Nulls that fn gives are dropped."""
    return F.filter(F.transform(items, fn), lambda x: x.isNotNull())


def filter_items(items: Column, keep: Fn) -> Column:
    return F.filter(items, keep)


def flat_map_items(items: Column, fn: Fn) -> Column:
    return F.flatten(F.transform(items, fn))


def _first_false(items: Column, keep: Fn) -> Column:
    """The place (from 1) of the first item that keep refuses, 0 if there is none."""
    return F.array_position(F.transform(items, lambda x: F.coalesce(keep(x), F.lit(False))), False)


def take_while(items: Column, keep: Fn) -> Column:
    at = _first_false(items, keep)
    return F.when(at == 0, items).otherwise(F.slice(items, F.lit(1), (at - 1).cast("int")))


def drop_while(items: Column, keep: Fn) -> Column:
    at = _first_false(items, keep)
    return F.when(at == 0, F.slice(items, 1, 0)).otherwise(F.slice(items, F.greatest(at, F.lit(1)).cast("int"), F.size(items)))


def append(items: Column, item: Column) -> Column:
    return F.concat(items, F.array(item))


def prepend(items: Column, item: Column) -> Column:
    return F.concat(F.array(item), items)
