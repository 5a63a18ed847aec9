"""Enrichment joins: a stage against others by key.

An enriching side is broadcast only if Spark knows it to be small: the size in its plan's statistics, times ``UNPACKED`` as files are
compressed, is checked against ``BROADCAST_BYTES``. Beyond it the join shuffles, and adaptive execution splits skewed keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.aggregates import ColumnLike, col

BROADCAST_BYTES = 64 << 20
#: How many times as large as in a compressed file a table may be in memory: statistics of a scan are file sizes.
UNPACKED = 4


def plan_bytes(df: DataFrame) -> int:
    """Upper bound that the optimizer has for the size of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its size allows."""
    return F.broadcast(df) if not df.isStreaming and plan_bytes(df) * UNPACKED <= BROADCAST_BYTES else df


@dataclass(frozen=True)
class JoinClause:
    """Equal keys; columns are what is taken from the enriching side (all, if none is named)."""

    left: tuple[ColumnLike, ...]
    right: tuple[ColumnLike, ...]
    columns: tuple[str, ...] = ()

    def projecting(self, *columns: str) -> JoinClause:
        return JoinClause(self.left, self.right, columns)


def on_keys(left: ColumnLike | tuple, right: ColumnLike | tuple) -> JoinClause:
    tup = lambda x: tuple(x) if isinstance(x, tuple | list) else (x,)
    return JoinClause(tup(left), tup(right))


def join_map_entries(left: ColumnLike) -> JoinClause:
    """Against key-value entries: joins on ``key`` and gives ``value``."""
    return on_keys(left, "key").projecting("value")


@dataclass
class HashJoin:
    """A chain of joins; each side comes out as a struct column named by its tag, null where nothing matched."""

    df: DataFrame
    sides: list[tuple[str, DataFrame, JoinClause, bool]] = field(default_factory=list)

    def add(self, tag: str, other: DataFrame, clause: JoinClause) -> HashJoin:
        """Left outer: rows without a match stay."""
        self.sides.append((tag, other, clause, False))
        return self

    def add_inner(self, tag: str, other: DataFrame, clause: JoinClause) -> HashJoin:
        self.sides.append((tag, other, clause, True))
        return self

    def build(self, *output: ColumnLike) -> DataFrame:
        """All columns of the left with the tags, or the given expressions over them.

        Null keys match each other, and duplicates on the right multiply, as in a hash table of entries.
        """
        left = self.df
        names = list(left.columns)
        for tag, other, clause, inner in self.sides:
            keys = [f"__k{i}" for i in range(len(clause.right))]
            right = other.select("*", *[col(k).alias(n) for k, n in zip(clause.right, keys, strict=True)])
            kept = [F.col(c) for c in clause.columns] if clause.columns else [F.col(f"`{c}`") for c in other.columns]
            right = small(right.select(*keys, F.struct(*kept).alias(tag)))
            same = reduce(Column.__and__, [col(k).eqNullSafe(F.col(n)) for k, n in zip(clause.left, keys, strict=True)])
            left = left.join(right, same, "inner" if inner else "left").select(*[f"`{c}`" for c in names], tag)
            names.append(tag)
        return left.select(*[col(c) if isinstance(c, Column) else F.col(c) for c in output]) if output else left
