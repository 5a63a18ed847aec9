"""Aggregation of one or several inputs, global or by key, with or without a window."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.aggregates import Aggregate, CoAggregate, Custom, Nested, col, literal

#: Accumulators that a task holds before it hands them on.
HELD_KEYS = 100_000


def aggregate(df: DataFrame, keys: Sequence[Column], ops: dict[str, Aggregate | Nested | Custom]) -> DataFrame:
    """keys and one column for each operation. Without keys exactly one row, or none if a result that needs rows is null."""
    names = _names(df, keys)
    if names and not _windowed(names) and len(_plain(df, names, ops)) < len(ops) > 1:
        return _unboxed(_aggregate(_boxed(df, keys, names), [F.col("__key")], ["__key"], ops), names, ops)
    return _aggregate(df, keys, names, ops)


def _windowed(names: Sequence[str]) -> bool:
    """Whether a window is among the keys: it must be a key itself, as Spark merges sessions and repeats rows there."""
    return "__window" in names


def _ranked(df: DataFrame, names: Sequence[str], op) -> bool:
    return bool(op.first) and not df.isStreaming and not _windowed(names)


def _plain(df: DataFrame, names: Sequence[str], ops: dict) -> dict:
    """The operations that one group-by of the rows as they are can do together."""
    return {n: op for n, op in ops.items() if isinstance(op, Aggregate) and not op.prepare and not _ranked(df, names, op)}


def _boxed(df: DataFrame, keys: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """df with its keys as one struct: structs with equal nulls are equal, so that plain equality joins null keys too, without another shuffle."""
    return df.withColumn("__key", F.struct(*[k.alias(n) for k, n in zip(keys, names, strict=True)]))


def _unboxed(out: DataFrame, names: Sequence[str], ops) -> DataFrame:
    return out.select(*[F.col("__key").getField(n).alias(n) for n in names], *ops)


def _aggregate(df: DataFrame, keys: Sequence[Column], names: Sequence[str], ops: dict) -> DataFrame:
    plain = _plain(df, names, ops)
    parts = []
    if plain:
        parts.append(df.groupBy(*keys).agg(*[op.column().alias(n) for n, op in plain.items()]))
    for n, op in ops.items():
        if n not in plain:
            parts.append(_special(df, keys, names, n, op))
    out = parts[0] if len(parts) == 1 else reduce(lambda a, b: _join_keys(a, b, names, "inner"), parts) if names else reduce(DataFrame.crossJoin, parts)
    for n, op in ops.items():
        if not names and getattr(op, "null_is_none", False):
            out = out.where(F.col(n).isNotNull())
    return out.select(*names, *ops)


def _names(df: DataFrame, keys: Sequence[Column]) -> list[str]:
    return df.select(*keys).columns if keys else []


def _join_keys(a: DataFrame, b: DataFrame, names: Sequence[str], how: str) -> DataFrame:
    """Joins on equal keys, null being a key. Boxed keys join as they are; others (of windows) null-safely, which shuffles what is aggregated again."""
    if list(names) == ["__key"]:
        return a.join(b, "__key", how)
    right = b.select(*[F.col(f"`{n}`").alias(f"__r_{n}") for n in names], *[c for c in b.columns if c not in names])
    same = reduce(Column.__and__, [F.col(f"`{n}`").eqNullSafe(F.col(f"`__r_{n}`")) for n in names])
    joined = a.join(right, same, how)
    keys = [F.coalesce(F.col(f"`{n}`"), F.col(f"`__r_{n}`")).alias(n) for n in names]
    return joined.select(*keys, *[c for c in a.columns if c not in names], *[c for c in b.columns if c not in names])


def _special(df: DataFrame, keys: Sequence[Column], names: Sequence[str], n: str, op) -> DataFrame:
    if isinstance(op, Custom):
        if list(names) == ["__key"]:  # accumulators are held by plain keys
            fields = df.schema["__key"].dataType.fieldNames()
            done = custom(df, [F.col("__key").getField(f).alias(f) for f in fields], op, n)
            return done.select(F.struct(*[f"`{f}`" for f in fields]).alias("__key"), n)
        return custom(df, keys, op, n)
    if op.prepare:
        df = op.prepare(df)
    if isinstance(op, Nested):
        inner = [col(c).alias(f"__{k}") for k, c in op.inner_keys]
        first = aggregate(df, [*keys, *inner], {"__v": op.inner})
        entry = F.struct(*[F.col(f"__{k}") for k, _ in op.inner_keys][:1], F.col("__v"))
        return first.groupBy(*names).agg(F.map_from_entries(F.collect_list(entry)).alias(n))
    if _ranked(df, names, op):
        most, order = op.first
        if names:
            rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order(None)))
            df = df.withColumn("__rank", rank).where(F.col("__rank") <= max(most, 1))
        else:
            df = df.orderBy(*order(None)).limit(max(most, 1))
    return df.groupBy(*keys).agg(op.column().alias(n))


def co_aggregate(inputs: Sequence[tuple[DataFrame, Sequence[Column]]], ops: Sequence[tuple[str, Aggregate]]) -> DataFrame:
    """Each input aggregated by its keys, then joined on them; an absent input gives its operation's empty result.

    Key columns take the first input's names. Inputs shuffle once each: they are aggregated and joined by the same struct of keys. From the third
    input on, what was joined so far (a row a key) shuffles again, as a full join's result has no known partitioning.
    """
    names = _names(*inputs[0])
    parts = []
    for (df, keys), (n, op) in zip(inputs, ops, strict=True):
        if names and not _windowed(names):
            parts.append(_aggregate(_boxed(df, keys, names), [F.col("__key")], ["__key"], {n: op}))
        else:
            parts.append(_aggregate(df, [k.alias(name) for k, name in zip(keys, names, strict=True)], names, {n: op}))
    if not names:
        return reduce(DataFrame.crossJoin, parts)
    joined = names if _windowed(names) else ["__key"]
    out = reduce(lambda a, b: _join_keys(a, b, joined, "full"), parts)
    back = [F.col(n) if _windowed(names) else F.col("__key").getField(n).alias(n) for n in names]
    return out.select(*back, *[_filled(n, op) for n, op in ops])


def _filled(n: str, op: Aggregate) -> Column:
    return F.col(n) if getattr(op, "empty", None) is None else F.coalesce(F.col(n), literal(op.empty)).alias(n)


def co_group(inputs: Sequence[tuple[DataFrame, Sequence[Column]]], op: CoAggregate | Custom, name: str = "result") -> DataFrame:
    """Several inputs into one result column: a struct for composed operations, any type for a custom one."""
    if isinstance(op, CoAggregate):
        out = co_aggregate(inputs, op.ops)
        names = _names(*inputs[0])
        return out.select(*names, F.struct(*[n for n, _ in op.ops]).alias(name))
    return custom_many(inputs, op, name)


def custom(df: DataFrame, keys: Sequence[Column], op: Custom, name: str) -> DataFrame:
    return custom_many([(df, keys)], op, name)


def custom_many(inputs: Sequence[tuple[DataFrame, Sequence[Column]]], op: Custom, name: str) -> DataFrame:
    """A Python accumulator in two stages: per task, then per key. Accumulators travel pickled, rows don't travel.

    Without combine a key's rows go through one accumulator: they travel, and the group is read as a whole.
    """
    if len(op.accumulate) != len(inputs):
        raise ValueError(f"{len(op.accumulate)} accumulate functions for {len(inputs)} inputs")
    names = _names(*inputs[0])
    key_fields = inputs[0][0].select(*inputs[0][1]).schema.fields if names else []
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields), "__acc binary"])
    partial = []
    for i, (df, keys) in enumerate(inputs):
        own = [f"__k{j}" for j in range(len(keys))]
        slim = df.select("*", *[k.alias(o) for k, o in zip(keys, own, strict=True)])
        partial.append(slim.mapInPandas(_accumulate(op, i, own, names, op.combine is not None), ddl))
    merged = reduce(DataFrame.unionByName, partial)
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields), f"`{name}` {op.returns}"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        acc, started = op.create(), False
        for data in group["__acc"]:
            part = pickle.loads(data)
            if op.combine is None:
                acc = op.accumulate[part[0]](acc, part[1])
            else:
                acc = op.combine(acc, part) if started else part
                started = True
        row = {n: [group[n].iloc[0]] for n in names} | {name: [op.finish(acc)]}
        return pd.DataFrame(row)

    if names:
        return merged.groupBy(*names).applyInPandas(finish, out)
    gathered = merged.groupBy(F.lit(1)).applyInPandas(finish, out)
    return gathered


def _accumulate(op: Custom, i: int, own: list[str], names: list[str], combine: bool):
    def flush(held: dict) -> pd.DataFrame:
        rows = [(*k, pickle.dumps(a)) for k, a in held.items()]
        return pd.DataFrame(rows, columns=[*names, "__acc"])

    def run(batches):
        held: dict[tuple, object] = {}
        for batch in batches:
            keys = list(zip(*(batch[o] for o in own), strict=True)) if own else [()] * len(batch)
            for key, row in zip(keys, batch.drop(columns=own).to_dict("records"), strict=True):
                if not combine:
                    yield flush({key: (i, row)})
                    continue
                held[key] = op.accumulate[i](held[key] if key in held else op.create(), row)
            if len(held) > HELD_KEYS:
                yield flush(held)
                held = {}
        if held:
            yield flush(held)

    return run
