"""Connected components of a graph given as links, by hooking to the smallest neighbour and pointer jumping.

Links go from the larger node u to the smaller v. A round finds each node's smallest neighbour p (pre-aggregated), turns its other links (u, v)
into (v, p) and its own into one with p's smallest neighbour. A task first replaces the links that it holds by
a spanning forest of stars. Rounds end when one changes nothing; paths halve, so there are about log2 of the longest one.

A node may have a third of all links: both sides of every join are tables, which adaptive execution splits where a node is hot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch

ROUNDS = 100


def root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = up.get(y, y)
        x = y
    return x


def forest(batches):
    """The links of a task as stars: each node linked with the smallest of those it is connected with in this task."""
    up: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(up, u), root(up, v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    tops = [root(up, x) for x in nodes]
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000], pa.int64()), pa.array(tops[at : at + 100_000], pa.int64())], ["u", "v"])


def components(scratch: Scratch, links: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) for each node u but the smallest of its component, with v that smallest node.

    links has longs u, v in either order; loops and repeats are left out.
    """
    ordered = links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = scratch.table(ordered.mapInArrow(forest, "u long, v long"), f"{name}-0")
    for k in range(1, ROUNDS):
        least = scratch.table(now.groupBy("u").agg(F.min("v").alias("p")), f"{name}-{k}-least")
        above = least.select(F.col("u").alias("p"), F.col("p").alias("pp")).hint("merge")
        other = now.join(least.hint("merge"), "u").where(F.col("v") != F.col("p")).select(F.col("v").alias("u"), F.col("p").alias("v"), F.lit(True).alias("moved"))
        own = least.join(above, "p", "left").select("u", F.coalesce("pp", "p").alias("v"), F.col("pp").isNotNull().alias("moved"))
        seen = Observation()
        after = other.unionByName(own).observe(seen, F.count_if("moved").alias("moved")).select("u", "v").distinct()
        after = scratch.table(after.mapInArrow(forest, "u long, v long"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        if not seen.get["moved"]:
            scratch.drop(f"{name}-{k}")
            return least.select("u", F.col("p").alias("v"))
        scratch.drop(f"{name}-{k}-least")
        now = after
    raise RuntimeError("no end of rounds")
