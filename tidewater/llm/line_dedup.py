"""Line deduplication: a suffix array over line-ID sequences by distributed prefix doubling.

A text is the sequence of its lines that are not blank; a line's ID is a pair of hashes and the length of its content without white space
around it, and IDs are ordered by these numbers. Prefix doubling ranks the suffixes by their first 1, 2, ``MIN_LINES``, 2 * MIN_LINES,
4 * MIN_LINES, ... lines (a length that is no power of two takes two overlapping runs). One round sets the ranks of two runs side by side, groups the
pairs, range-partitions the pairs that repeat and sorts them: their order is the rank of the longer run, so ranks go by the lexicographic order
of line IDs. A run that occurs once is no prefix of a repeated one and is discarded; rounds end when no run is left. The suffixes of one rank
lie side by side in the suffix array: they are an interval whose longest common prefix has at least the lines of that round.

Each suffix that is not the first of its interval starts a repeated run; its longest interval tells how long and where the first one lies. Such
runs side by side, with first places side by side too, are one maximal run. Later copies are deleted: the lines of all maximal runs of at least
``MIN_LINES`` lines, and single lines of at least ``MIN_CHARS`` characters that came before.

Scale: lines travel as hashes and ranks; groups are pre-aggregated and written before they meet their lines, so that adaptive execution can split
a line or run that a third of all texts have. There are about log2(lines of the longest repeated run) rounds, over what still repeats.
Texts shuffle once, to meet their runs.

Defined results: null text stays null and has no lines; blank lines are kept and count for nothing; of repeated rows
the first stays; null ids come last; other columns stay as they are, whatever their names (n_lines and n_removed are replaced). Ids must
be integers.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.llm.common import BLANKS, Scratch, carried, numbered, slim

MIN_LINES = 3
MIN_CHARS = 60
_LINE = ["h1", "h2", "n"]


def _ranked(scratch: Scratch, rows: DataFrame, key: list[str], name: str) -> tuple[DataFrame, int]:
    """(the keys that repeat in rows with their rank by order of the key and the place of their first row, how many there are)."""
    groups = rows.groupBy(*key).agg(F.min(F.struct("ord", "rid", "q")).alias("first"), F.count("*").alias("times")).where(F.col("times") > 1)
    # ids go up with the partition and the row in it: ranks of the sorted keys, with gaps
    ordered = groups.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())
    seen = Observation()
    ordered = ordered.observe(seen, F.count(F.lit(1)).alias("n")).select(*key, "rank", F.col("first.rid").alias("fa"), F.col("first.q").alias("fb"))
    return scratch.table(ordered, name), seen.get["n"]


def _placed(scratch: Scratch, rows: DataFrame, groups: DataFrame, key: list[str], step: int, name: str, *more: str) -> DataFrame:
    """rows of repeated keys with their rank, the place (fa, fb) of its first row, whether theirs is a later one, and the rank ``step`` lines on."""
    later = (F.col("rid") != F.col("fa")) | (F.col("q") != F.col("fb"))
    joined = rows.join(groups.hint("merge"), key).select("ord", "rid", "q", F.col("rank").alias("r"), "fa", "fb", later.alias("later"), *more)
    there = W.partitionBy("rid").orderBy("q").rangeBetween(step, step)
    return scratch.table(joined.withColumn("r2", F.first("r").over(there)), name)


def intervals(scratch: Scratch, docs: DataFrame, min_lines: int = MIN_LINES):
    """(size, rows) for each length of runs: every place whose run of so many lines repeats, as _placed() has it. docs has ord, rid, text; q
    counts lines that are not blank."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != "")
    ids = docs.where(F.col("text").isNotNull()).select(
        "ord", "rid", F.posexplode(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), F.char_length(x).alias("n")))).alias("q", "line")
    )
    step_of = lambda size: size if size * 2 <= min_lines or size >= min_lines else min_lines - size
    rows = scratch.table(ids.select("ord", "rid", F.col("q").cast("long").alias("q"), "line.*"), "lines")
    key, more, size = _LINE, ["n"], 1
    groups, n = _ranked(scratch, rows, key, "rank1")
    while n:
        rows = _placed(scratch, rows, groups, key, step_of(size), f"run{size}", *more)
        scratch.drop(f"rank{size}")
        yield size, rows
        rows = rows.where(F.col("r2").isNotNull()).select("ord", "rid", "q", "r", "r2")
        size += step_of(size)
        key, more = ["r", "r2"], []
        groups, n = _ranked(scratch, rows, key, f"rank{size}")


def maximal_runs(tops: list[tuple[int, DataFrame]]) -> DataFrame:
    """(rid, q, n, fa, fb): maximal runs of n lines at q of rid that came before at fb of fa, out of the later places of intervals()."""
    every = None
    for size, rows in tops:
        part = rows.where("later").select("rid", "q", F.struct(F.lit(size).cast("long").alias("size"), "fa", "fb").alias("top"))
        every = part if every is None else every.unionByName(part)
    longest = every.groupBy("rid", "q").agg(F.max("top").alias("top")).select("rid", "q", "top.*")
    along = W.partitionBy("rid").orderBy("q")
    ahead = lambda c: F.lag(c).over(along)
    goes_on = (F.col("q") == ahead("q") + 1) & (F.col("fa") == ahead("fa")) & (F.col("fb") == ahead("fb") + 1)
    runs = longest.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(along))
    ends = F.max(F.col("q") + F.col("size")) - F.min("q")
    return runs.groupBy("rid", "run").agg(F.min("q").alias("q"), ends.alias("n"), F.min_by("fa", "q").alias("fa"), F.min("fb").alias("fb")).drop("run")


def repeated_lines(scratch: Scratch, docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(rid, q, n): runs of lines to delete, which may overlap; docs has ord, rid, text."""
    found = list(intervals(scratch, docs, min_lines))
    scratch.drop("lines")
    gone = docs.sparkSession.createDataFrame([], "rid long, q long, n long")
    for size, rows in found:
        if size == 1:
            gone = rows.where(F.col("later") & (F.col("n") >= min_chars)).select("rid", "q", F.lit(1).cast("long").alias("n"))
    tops = [(size, rows) for size, rows in found if size >= min_lines]
    return gone.unionByName(maximal_runs(tops).select("rid", "q", "n")) if tops else gone


def line_dedup(spark, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, counts: str | None = None) -> DataFrame:
    """docs with its texts less the deleted lines, and ``n_lines`` (not blank), ``n_removed`` beside, or both in a struct column of the name counts."""
    scratch = Scratch(spark, "lines")
    rows, _ = numbered(scratch, slim(docs, id_col, text_col, carry=True))
    gone = repeated_lines(scratch, rows.select("ord", "rid", "text"), min_lines, min_chars)
    by_row = gone.groupBy("rid").agg(F.collect_list(F.struct("q", "n")).alias("gone"))
    joined = rows.join(by_row, "rid", "left").select("row", "text", "gone")

    def run(batches):
        for batch in batches:
            runs = ([(x["q"], x["n"]) for x in g or ()] for g in batch.column(2).to_pylist())
            out = [strip_lines(t, g) for t, g in zip(batch.column(1).to_pylist(), runs, strict=True)]
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 3, kinds, strict=True))], ["row", "text", "n_lines", "n_removed"])

    kind = joined.schema["row"].dataType.simpleString()
    left = joined.mapInArrow(run, f"row {kind}, text string, n_lines long, n_removed long")
    own = [left["text"].alias(c) if c == text_col else x for c, x in zip(docs.columns, carried(left, docs), strict=True)]
    if counts:
        return left.select(*own, F.struct("n_lines", "n_removed").alias(counts))
    return left.select(*(x for c, x in zip(docs.columns, own, strict=True) if c.lower() not in ("n_lines", "n_removed")), "n_lines", "n_removed")


def strip_lines(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """(what is left without the runs (first line, lines), lines that were not blank, lines deleted)."""
    if text is None:
        return None, 0, 0
    out = {k for q, n in runs for k in range(q, q + n)}
    kept, q = [], 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if q not in out:
                kept.append(line)
            q += 1
        else:
            kept.append(line)
    return "\n".join(kept), q, len(out)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(spark, docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def oracle(min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, table: str = "documents") -> str:
    """The contract's rows in SQL, for ids without nulls or repeats."""
    blank = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {table}),
x AS (SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM s WHERE text IS NOT NULL),
l AS (SELECT doc_id, raw, i, trim(raw, {blank}) AS t FROM x),
n AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS q FROM l WHERE t <> ''),
r AS (SELECT *, {" || chr(10) || ".join(f"lead(t, {k}) OVER (PARTITION BY doc_id ORDER BY q)" for k in range(min_lines))} AS run FROM n),
f AS (SELECT doc_id, i, q, t, row_number() OVER (PARTITION BY t ORDER BY doc_id, q) > 1 AND length(t) >= {min_chars} AS again,
    run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, q) > 1 AS begins FROM r),
g AS (SELECT doc_id, i, again OR coalesce(bool_or(begins) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN {min_lines - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM f),
k AS (SELECT l.doc_id, count(g.i) AS n_lines, count(*) FILTER (g.gone) AS n_removed,
    coalesce(string_agg(l.raw, chr(10) ORDER BY l.i) FILTER (NOT coalesce(g.gone, false)), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT s.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS text_sha256
FROM s LEFT JOIN k ON s.doc_id = k.doc_id
"""


ORACLE = oracle()
