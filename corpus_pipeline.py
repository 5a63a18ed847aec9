"""A training-corpus pipeline over documents: quality, lines, near duplicates, benchmark leaks, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the shared folder and read again
as the next one's docs. All but the last return the columns of documents:

- quality: documents that the classifier (fitted on the contract's labelled rows) scores below 0.7 go;
- line dedup: later copies of repeated line runs are deleted; n_chars follows; a text of which nothing is left goes;
- near duplicates: of each class the first document stays;
- decontamination: documents that a benchmark window hits go;
- mixing: each document once per repetition that the mixture takes, numbered in ``copy``.

A null text is scored as an empty one, by the model's bias: it goes if that is below 0.7. One that stays passes all further stages but the last, which takes
it 0 times. Columns beside those of documents pass all stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, line_dedup, minhash, mixing, quality
from tidewater.llm.common import BLANKS, Scratch, short_lived


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.score_quality(spark, docs, quality.learned(spark, docs, sf_dir), keep=quality.KEEP)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.line_dedup(spark, docs, counts="__counts")
    counts = F.col("__counts.n_removed")
    left = left.where(F.col("text").isNull() | (counts == 0) | (F.btrim("text", F.lit(BLANKS)) != ""))
    out = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return left.withColumns(out).select(*[f"`{c}`" for c in docs.columns])


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_first(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_rows(mixing.mix_sources(docs))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each_class),
    ("decontaminate", without_benchmark),
    ("mix", mixture),
]

#: The stages train a model and sketch texts: SQL can't say it. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with short_lived():
            docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
