"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Each source asks for its share of the budget by weight. A source whose share is over
``max_epochs`` times its size is clamped there and the excess goes to the others by weight, until
none is above. In closed form: sort sources by cap/weight; the water level is the first
``(budget - caps before) / (weights from here)`` that is at most this source's cap/weight.

A source's documents are then repeated ``floor(target / size)`` times, and the rest of the target
is one further, fractional repetition: the documents that come first in a seeded hash order, up to
the one in the middle of which the rest ends (it goes in if more than half of it fits). So the
words taken differ from the target by at most half a document.

Scale: texts are read once: sizes and draws are written to the shared folder (with the texts only if they are to be returned), and all else
works on that table. It shuffles once, by (source, hash bucket), so a source with a third of all rows lies
in ``BUCKETS`` groups; rows that share id and text share a bucket. Running sums go over buckets, then within a bucket. Per-source figures are
computed on pre-aggregated rows, one a source, which one task sorts.

Defined results: null text has size 0; the null source is a source of its own, last in order; an
empty table gives an empty table; repeated rows count as so many documents; rows of size 0 are
taken 0 times. The order is that of a hash over id and text, so rows of one id (or of none) are ordered alike in every run; rows
that have both in common are alike but for other columns. Columns that clash with those added are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, others

BUCKETS = 4096
ADDED = ["size", "source_size", "target", "copies", "taken"]
_OWN = ["__key", "__draw", "__bucket"]


def mix_sources(
    docs: DataFrame,
    *,
    share: float = 1.5,
    max_epochs: float = 2.0,
    weights: tuple[float, ...] = (5, 2, 1),
    seed: str = "tidewater-mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_text: bool = True,
) -> DataFrame:
    """docs (with_text: and its text) with size, source_size, target, copies (repetitions of the row) and taken (words)."""
    if share < 0 or max_epochs <= 0 or not weights or min(weights) <= 0:
        raise ValueError("share must be at least 0, max_epochs and every weight above 0")
    text = docs[f"`{text_col}`"]
    kept = others(docs, ADDED + _OWN) if with_text else others(docs, [*ADDED, *_OWN, text_col])
    mark = F.concat_ws(":", F.lit(seed), F.coalesce(docs[id_col].cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    base = docs.select(
        *kept,
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        # one text key, so that null sources meet and come last: code-point order is kept
        F.when(docs[source_col].isNull(), "1").otherwise(F.concat(F.lit("0"), docs[source_col].cast("string"))).alias("__key"),
        F.conv(F.substring(F.md5(mark), 1, 15), 16, 10).cast("long").alias("__draw"),
    ).withColumn("__bucket", F.shiftright("__draw", 48).cast("int"))
    base = Scratch(docs.sparkSession, "mix").table(base, "sizes")

    buckets = base.groupBy("__key", "__bucket").agg(F.sum("size").alias("__b_size"))
    every = W.partitionBy(F.lit(0))
    order = W.partitionBy(F.lit(0)).orderBy("__key")
    level = W.partitionBy(F.lit(0)).orderBy("__ratio", "__key")
    before = level.rowsBetween(W.unboundedPreceding, -1)
    rank = F.row_number().over(order) - 1
    sources = (
        buckets.groupBy("__key")
        .agg(F.sum("__b_size").alias("source_size"))
        .withColumn("__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
        .withColumn("__cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__budget", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn(
            "__level",
            (F.col("__budget") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0)))
            / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))),
        )
        .withColumn(
            "__level",
            F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__key", "__level"))).over(every)["__level"],
        )
        .select(
            "__key",
            "source_size",
            F.when(F.col("__level").isNull() | (F.col("__cap") < F.col("__level") * F.col("__w")), F.col("__cap"))
            .otherwise(F.col("__level") * F.col("__w"))
            .alias("target"),
        )
    )
    ahead = W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = buckets.select(
        "__key", "__bucket", F.coalesce(F.sum("__b_size").over(ahead), F.lit(0)).alias("__ahead")
    ).join(sources, "__key")

    within = W.partitionBy("__key", "__bucket").orderBy("__draw", "size").rowsBetween(W.unboundedPreceding, 0)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("__ahead") + F.col("__upto") - F.col("size") / F.lit(2.0)
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(whole + F.when(middle <= rest, 1).otherwise(0)).cast("long")
    return (
        base.repartition("__key", "__bucket").withColumn("__upto", F.sum("size").over(within))
        .join(offsets, ["__key", "__bucket"])
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[f"`{c}`" for c in base.columns if c not in {*_OWN, "size"}], *ADDED)
    )


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row once per repetition, numbered from 1 in ``copy``; rows taken 0 times go."""
    kept = mixed.where(F.col("copies") > 0)
    return kept.select(*others(kept, [*ADDED, "copy"]), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('tidewater-mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
  FROM documents),
s0 AS (SELECT k, sum(size)::BIGINT AS source_size,
    list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY encode(k)) - 1) % 3 + 1)::INT) AS w FROM d GROUP BY k),
s1 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio,
    1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, encode(k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, encode(k) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM s1),
l AS (SELECT arg_min(lev, ratio) AS lev FROM s2 WHERE lev <= ratio),
t AS (SELECT k, source_size, CASE WHEN l.lev IS NULL OR cap < l.lev * w THEN cap ELSE l.lev * w END AS target FROM s2, l),
c AS (SELECT d.*, t.source_size, t.target,
    sum(size) OVER (PARTITION BY d.k ORDER BY draw, size ROWS UNBOUNDED PRECEDING)::DOUBLE AS upto,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN t ON d.k = t.k)
SELECT doc_id, source, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
