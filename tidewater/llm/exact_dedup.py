"""Exact deduplication by two-pass Bloom filtering.

A digest of each row (hash of the normalised text, length, id) is written to the shared folder, so
the texts are read once. Pass 1 counts, for each bit of a Bloom filter, whether at least two rows
touch it: each batch sends the bit numbers it touches (once, or more often) to the block of the
filter that holds them, and blocks merge them as a stream. Pass 2 tests every row: one with a bit
that no other row touches is unique and passes straight through; only the rest shuffle.

The filter has ``BITS_PER_ROW`` bits a row and at most ``MAX_BITS`` (32 MB), which bounds what is
collected and broadcast. Past that it fills up: more rows shuffle, the result stays exact, and what
shuffles is the digest (about 60 bytes a row), never the text.

Group keepers come from a partial aggregation and are written before they meet the rows: both sides of that join are plain exchanges, which
adaptive execution splits where a group is large, so one group may hold a third of all rows.

Defined results: null text counts as empty; rows that repeat with the same id stay separate rows,
of which one is kept; a null id comes after all others; an empty table gives an empty table; other
columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import BLANKS, Scratch, mix64

BITS_PER_ROW = 16
MIN_BITS = 1 << 20
MAX_BITS = 1 << 28
BLOCK = 1 << 17
PROBES = 3


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit numbers for each 64-bit hash; bits is a power of two."""
    a = mix64(h.view(np.uint64))
    b = mix64(a) | np.uint64(1)
    i = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a[None, :] + i * b[None, :]) >> np.uint64(7)) & np.uint64(bits - 1)


def _touched(bits: int):
    def run(batches):
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            at, n = np.unique(_probes(h, bits), return_counts=True)
            code = (at << np.uint64(1) | (n > 1)).astype(np.uint64)
            block = at // np.uint64(BLOCK)
            edges = np.flatnonzero(np.diff(block)) + 1
            starts = np.concatenate(([0], edges))
            parts = np.split(code, edges)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block[starts].astype(np.int32)),
                    pa.array([(p - (p[0] >> np.uint64(1)) // np.uint64(BLOCK) * np.uint64(2 * BLOCK)).astype(np.uint32).tobytes() for p in parts], pa.binary()),
                ],
                ["block", "bits"],
            )

    return run


def _merged(batches):
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            code = np.frombuffer(data, np.uint32)
            at = code >> 1
            seen = once.setdefault(block, np.zeros(BLOCK, bool))
            more = twice.setdefault(block, np.zeros(BLOCK, bool))
            more[at[seen[at] | ((code & 1) == 1)]] = True
            seen[at] = True
    for block, more in twice.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], ["block", "bits"])


def _tested(bits: int, filter_):
    def run(batches):
        words = filter_.value
        for batch in batches:
            at = _probes(batch.column("h").to_numpy(zero_copy_only=False), bits)
            byte = words[(at >> np.uint64(3)).astype(np.int64)]
            hit = (byte >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.all(axis=0))], [*batch.schema.names, "maybe"])

    return run


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256 of the text without white space, n (code points of the text as it is)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(
        docs[id_col].alias("doc_id"),
        F.sha2(F.translate(text, BLANKS, ""), 256).alias("text_sha256"),
        F.char_length(text).cast("long").alias("n"),
    ).select("*", F.xxhash64("text_sha256").alias("h"), F.monotonically_increasing_id().alias("row"))


def repeated_hashes(spark, rows: DataFrame, n_rows: int) -> tuple[int, np.ndarray]:
    """The filter's size in bits, and its bits that at least two rows of rows.h touch."""
    bits = MIN_BITS
    while bits < min(MAX_BITS, n_rows * BITS_PER_ROW):
        bits *= 2
    merged = (
        rows.select("h").mapInArrow(_touched(bits), "block int, bits binary").repartition("block").mapInArrow(_merged, "block int, bits binary")
    )
    words = np.zeros(bits // 8, np.uint8)
    for block, data in merged.collect():  # at most MAX_BITS bits
        words[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(data, np.uint8)
    return bits, words


def exact_dedup(spark, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    scratch = Scratch(spark, "exact")
    rows = scratch.table(digest(docs, id_col, text_col), "digest")
    bits, words = repeated_hashes(spark, rows, rows.count())
    tested = rows.mapInArrow(_tested(bits, spark.sparkContext.broadcast(words)), rows._jdf.schema().toDDL() + ", maybe boolean")

    unique = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    again = tested.where("maybe").drop("h", "maybe")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = again.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
    keepers = groups.select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    joined = again.join(scratch.table(keepers, "keepers").hint("merge"), "text_sha256")
    return unique.unionByName(
        joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM r
"""
