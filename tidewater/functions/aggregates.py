"""Aggregate operations as values: a Catalyst expression, what it gives for no rows, and whether null means no result.

Built-in operations stay in the JVM: partial aggregation, spill and code generation are Spark's. ``custom`` takes
Python accumulators and runs in two stages as well (see operators.grouping).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Aggregate:
    """build(guard) gives the expression over rows where guard holds (None: all rows)."""

    build: Callable[[Column | None], Column]
    #: The value for no rows; None if there is none.
    empty: Any = None
    #: Whether a null result means that a global aggregation has no row.
    null_is_none: bool = False
    #: Applied to the rows before, for operations that change their number.
    prepare: Callable[[DataFrame], DataFrame] | None = None
    #: The n and the order, under a guard, of which only the first n rows of a group count: they are cut before they are gathered.
    first: tuple[int, Callable[[Column | None], list[Column]]] | None = None
    #: The same as build, of several functions that Spark can hash, for group-bys: build's single one can go over a frame of rows.
    hashed: Callable[[Column | None], Column] | None = None

    def column(self, guard: Column | None = None) -> Column:
        made = (self.hashed or self.build)(guard)
        return made if self.empty is None else F.coalesce(made, literal(self.empty))


def literal(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _when(guard: Column | None, value: Column) -> Column:
    return value if guard is None else F.when(guard, value)


def counting() -> Aggregate:
    return Aggregate(lambda g: F.count(_when(g, F.lit(1))), 0)


def summing_long(x: ColumnLike) -> Aggregate:
    """Overflow raises, as the session is in ANSI mode."""
    return Aggregate(lambda g: F.sum(_when(g, col(x).cast("long"))), F.lit(0).cast("long"))


def summing_double(x: ColumnLike) -> Aggregate:
    return Aggregate(lambda g: F.sum(_when(g, col(x).cast("double"))), 0.0)


def averaging_long(x: ColumnLike) -> Aggregate:
    """NaN for no rows. The sum is a long: overflow raises, as the session is in ANSI mode."""

    def build(g: Column | None) -> Column:
        value = _when(g, col(x).cast("long"))
        return F.when(F.count(value) > 0, F.sum(value).cast("double") / F.count(value))

    return Aggregate(build, float("nan"))


def averaging_double(x: ColumnLike) -> Aggregate:
    return Aggregate(lambda g: F.avg(_when(g, col(x).cast("double"))), float("nan"))


def _item(item: ColumnLike | list[ColumnLike]) -> Column:
    return F.struct(*[col(c) if isinstance(c, Column) else F.col(c) for c in item]) if isinstance(item, list | tuple) else col(item)


def min_by(item: ColumnLike | list, *by: ColumnLike) -> Aggregate:
    """The item with the least key; further keys say which of equals comes first. A null key is less than all others."""
    hashed = _by_one_key(F.min_by, _item(item), col(by[0])) if len(by) == 1 else None
    return Aggregate(lambda g: F.min_by(_item(item), _when(g, F.struct(*map(col, by)))), None, True, hashed=hashed)


def max_by(item: ColumnLike | list, by: ColumnLike, *first: ColumnLike) -> Aggregate:
    """The item with the greatest key; of equals the one that comes first by ``first`` (numbers or texts). A null key is less than all others."""
    hashed = None if first else _by_one_key(F.max_by, _item(item), col(by))
    return Aggregate(lambda g: F.max_by(_item(item), _when(g, F.struct(col(by), *[c for f in first for c in _reversed(col(f))]))), None, True, hashed=hashed)


def _by_one_key(pick: Callable[[Column, Column], Column], item: Column, key: Column) -> Callable[[Column | None], Column]:
    """pick by the key itself: numbers are then held in a hash table, while a struct as key makes Spark sort all rows before they are aggregated."""

    def build(g: Column | None) -> Column:
        null = key.isNull() if g is None else g & key.isNull()
        best, of_null = pick(item, _when(g, key)), F.max_by(item, F.when(null, F.lit(1)))
        if pick is F.min_by:
            return F.when(F.count(F.when(null, F.lit(1))) > 0, of_null).otherwise(best)
        return F.when(F.count(_when(g, key)) > 0, best).otherwise(of_null)

    return build


def _reversed(c: Column) -> tuple[Column, Column]:
    """Two columns that sort the other way: numbers negated, texts by the complement of their bytes, with an end above all digits."""
    text = F.typeof(c) == "string"
    digits = F.translate(F.hex(F.encode(c.cast("string"), "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210")
    return F.when(text, F.lit(None)).otherwise(-c), F.when(text, F.concat(digits, F.lit("G")))


def _sorted(g: Column | None, key: Column, item: Column, descending: bool) -> Column:
    pairs = F.collect_list(_when(g, F.struct(key.alias("k"), item.alias("v"))))
    return F.transform(F.sort_array(pairs, not descending), lambda p: p["v"])


def _n(n: int, item: ColumnLike | list, by: tuple[ColumnLike, ...], descending: bool) -> Aggregate:
    key, own = F.struct(*map(col, by)), _item(item)

    def order(g: Column | None) -> list[Column]:
        guard = [] if g is None else [F.coalesce(g, F.lit(False)).desc()]
        return [*guard, key.desc() if descending else key.asc(), own.desc() if descending else own.asc()]

    return Aggregate(lambda g: F.slice(_sorted(g, key, own, descending), 1, n), None, first=(n, order))


def top_n(n: int, item: ColumnLike | list, *by: ColumnLike) -> Aggregate:
    """The n items with the greatest keys, in descending order. As an operation of its own it ranks rows and gathers n of a group; inside of
    all_of and on streams it gathers the group."""
    return _n(n, item, by, True)


def bottom_n(n: int, item: ColumnLike | list, *by: ColumnLike) -> Aggregate:
    return _n(n, item, by, False)


def linear_trend(x: ColumnLike, y: ColumnLike) -> Aggregate:
    """Slope of the least-squares line; NaN where it isn't determined."""
    return Aggregate(lambda g: F.regr_slope(_when(g, col(y).cast("double")), _when(g, col(x).cast("double"))), float("nan"))


def concatenating(x: ColumnLike, delimiter: str = "", prefix: str = "", suffix: str = "", *, order: ColumnLike | None = None) -> Aggregate:
    """Texts in the given order; empty ones add no delimiter. Without an order, as they arrive."""

    def build(g: Column | None) -> Column:
        text = _when(g, col(x).cast("string"))
        items = F.collect_list(text) if order is None else F.transform(
            F.sort_array(F.collect_list(_when(g, F.struct(col(order).alias("k"), col(x).cast("string").alias("v"))))), lambda p: p["v"]
        )
        return F.concat(F.lit(prefix), F.array_join(F.filter(items, lambda t: t != ""), delimiter), F.lit(suffix))

    return Aggregate(build, prefix + suffix)


def to_list(x: ColumnLike | list) -> Aggregate:
    return Aggregate(lambda g: F.collect_list(_when(g, _item(x))))


def to_set(x: ColumnLike | list) -> Aggregate:
    return Aggregate(lambda g: F.collect_set(_when(g, _item(x))))


to_collection = to_list


def to_map(key: ColumnLike, value: ColumnLike, merge: Callable[[ColumnLike], Aggregate] | None = None) -> Aggregate:
    """A map; equal keys raise, or are merged: merge gives an aggregate of the values, done before."""
    if merge is None:
        return Aggregate(lambda g: F.map_from_entries(F.collect_list(_when(g, F.struct(col(key).alias("key"), col(value).alias("value"))))))
    return Nested([("k", key)], merge(value))


@dataclass(frozen=True)
class Nested:
    """A group-by inside a group: a map from inner key to inner result; runs as two group-bys."""

    inner_keys: list[tuple[str, ColumnLike]]
    inner: Aggregate
    empty: Any = None
    null_is_none: bool = False
    prepare: Callable[[DataFrame], DataFrame] | None = None


def grouping_by(key: ColumnLike, op: Aggregate | None = None) -> Nested:
    """A map from the key to op of its rows (to_list of whole rows is ``grouping_by(key, to_list([...]))``)."""
    return Nested([("k", key)], op or counting())


def mapping(fn: Callable[[ColumnLike], Column], op: Callable[[Column], Aggregate], x: ColumnLike) -> Aggregate:
    """op over fn(x); rows where fn gives null are left out."""
    value = fn(col(x))
    made = op(value)
    return _guarded(made, value.isNotNull())


def _guarded(op: Aggregate, own: Column) -> Aggregate:
    """op over the rows where own holds."""
    under = lambda g: own if g is None else g & own
    first = op.first and (op.first[0], lambda g: op.first[1](under(g)))
    hashed = op.hashed and (lambda g: op.hashed(under(g)))
    return replace(op, build=lambda g: op.build(under(g)), first=first, hashed=hashed)


def filtering(condition: ColumnLike, op: Aggregate) -> Aggregate:
    return _guarded(op, F.coalesce(col(condition), F.lit(False)))


def flat_mapping(array: ColumnLike, op: Callable[[Column], Aggregate], name: str = "item") -> Aggregate:
    """op over the elements of an array; the rows are exploded first. A group whose arrays are all empty or null has op's result for no rows."""
    made = _guarded(op(F.col(name)), F.col(f"__has_{name}"))

    def prepare(df: DataFrame) -> DataFrame:
        boxed = df.withColumn(f"__box_{name}", F.explode_outer(F.transform(col(array), lambda x: F.struct(x.alias("x")))))
        return boxed.withColumns({f"__has_{name}": F.col(f"__box_{name}").isNotNull(), name: F.col(f"__box_{name}.x")}).drop(f"__box_{name}")

    return replace(made, prepare=prepare)


def reducing(zero: Any, x: ColumnLike, combine: Callable[[Column, Column], Column], order: ColumnLike | None = None) -> Aggregate:
    """A fold of the values; give an order if combine isn't commutative."""

    def build(g: Column | None) -> Column:
        values = F.collect_list(_when(g, col(x))) if order is None else _sorted(g, col(order), col(x), False)
        return F.aggregate(values, literal(zero), combine)

    return Aggregate(build, zero)


def pick_any(x: ColumnLike | list) -> Aggregate:
    return Aggregate(lambda g: F.any_value(_when(g, _item(x)), F.lit(True)), None, True)


def sorting(x: ColumnLike, descending: bool = False) -> Aggregate:
    return Aggregate(lambda g: F.sort_array(F.collect_list(_when(g, col(x))), not descending))


def all_of(**ops: Aggregate) -> Aggregate:
    """Several operations in one pass: a struct with a field for each."""
    if any(isinstance(op, Nested | Custom) or op.prepare for op in ops.values()):
        raise ValueError("nested and flat-mapping operations go into aggregate(name=op) directly")
    return Aggregate(lambda g: F.struct(*[op.column(g).alias(name) for name, op in ops.items()]))


class AllOfBuilder:
    """all_of, one operation at a time."""

    def __init__(self):
        self.ops: dict[str, Aggregate] = {}

    def add(self, name: str, op: Aggregate) -> str:
        self.ops[name] = op
        return name

    def build(self) -> Aggregate:
        return all_of(**self.ops)


@dataclass(frozen=True)
class CoAggregate:
    """One operation for each of several inputs; the result is a struct with a field for each."""

    ops: list[tuple[str, Aggregate]]


def aggregate_operation2(op0: Aggregate, op1: Aggregate) -> CoAggregate:
    return CoAggregate([("f0", op0), ("f1", op1)])


def aggregate_operation3(op0: Aggregate, op1: Aggregate, op2: Aggregate) -> CoAggregate:
    return CoAggregate([("f0", op0), ("f1", op1), ("f2", op2)])


class CoAggregateBuilder:
    def __init__(self):
        self.ops: list[tuple[str, Aggregate]] = []

    def add(self, tag: str, op: Aggregate) -> str:
        self.ops.append((tag, op))
        return tag

    def build(self) -> CoAggregate:
        return CoAggregate(self.ops)


@dataclass(frozen=True)
class Custom:
    """A user's accumulator in Python: create() gives one, accumulate[i](acc, row) takes a row of input i (a dict) and returns the
    accumulator, combine(a, b) merges, finish(acc) gives the result (None: no result), of SQL type ``returns``."""

    create: Callable[[], Any]
    accumulate: tuple[Callable[[Any, dict], Any], ...]
    combine: Callable[[Any, Any], Any] | None
    finish: Callable[[Any], Any]
    returns: str


@dataclass
class AggregateBuilder:
    """Custom, step by step: with_create(...).and_accumulate(...).and_combine(...).and_export_finish(..., returns)."""

    create: Callable[[], Any]
    steps: list[Callable[[Any, dict], Any]] = field(default_factory=list)
    merge: Callable[[Any, Any], Any] | None = None

    def and_accumulate(self, fn: Callable[[Any, dict], Any]) -> AggregateBuilder:
        """Call again for a further input."""
        self.steps.append(fn)
        return self

    def and_combine(self, fn: Callable[[Any, Any], Any]) -> AggregateBuilder:
        self.merge = fn
        return self

    def and_deduct(self, fn: Callable[[Any, Any], Any]) -> AggregateBuilder:
        """Taken for completeness: windows are aggregated anew, nothing is ever deducted."""
        return self

    def and_export_finish(self, fn: Callable[[Any], Any], returns: str) -> Custom:
        if not self.steps:
            raise ValueError("and_accumulate is missing")
        return Custom(self.create, tuple(self.steps), self.merge, fn, returns)


def with_create(create: Callable[[], Any]) -> AggregateBuilder:
    return AggregateBuilder(create)
