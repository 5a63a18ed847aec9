"""Every operator on an empty table, on one very long text, and on input in other orders."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.llm import decontaminate, exact_dedup, html_extract, langid, line_dedup, minhash, mixing, quality, secrets, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string"


def run(spark, name, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</article>")).alias("html"))
    return {
        "mix": lambda: mixing.mix_sources(docs),
        "quality": lambda: quality.score_quality(spark, docs, quality.fit_quality(docs, labels)),
        "lines": lambda: line_dedup.line_dedup(spark, docs),
        "near": lambda: minhash.near_classes(spark, docs),
        "bench": lambda: decontaminate.decontaminate(spark, docs, bench),
        "secrets": lambda: secrets.scan_secrets(docs),
        "html": lambda: html_extract.extract_pages(spark, pages),
        "lang": lambda: langid.identify(spark, docs, langid.fit_profiles(docs)),
        "suffix": lambda: suffix_dedup.remove_repeats(spark, docs),
        "exact": lambda: exact_dedup.exact_dedup(spark, docs),
    }[name]()


NAMES = ["mix", "quality", "lines", "near", "bench", "secrets", "html", "lang", "suffix", "exact"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables_give_empty_tables(spark, name):
    got = run(spark, name, spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and len(got.columns) > 3


WORDS = [f"word{random.Random(1).randrange(10**6) + k}" for k in range(3000)]
LONG = " ".join(random.Random(2).choices(WORDS, k=180_000)) + " one two three four five six seven eight nine ten api_key = abcdef123456"


@pytest.mark.parametrize("name", NAMES)
def test_very_long_texts_are_worked_on_whole(spark, name):
    """A text of some two million characters beside short ones and nulls; what counts lies at its end."""
    rows = [(1, LONG, "en", "a"), (2, "short text", "fr", "b"), (3, None, None, None), (None, LONG, "en", "a")]
    got = {tuple(r)[0]: r for r in run(spark, name, spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert set(got) == {1, 2, 3, None}
    long = got[1]
    n = len(LONG.split())
    assert {
        "mix": lambda: long.size == n and got[3].size == 0,
        "quality": lambda: 0 <= long.score <= 1 and long.score == got[None].score,
        "lines": lambda: long.n_lines == 1 and got[None].n_removed == 1 and got[3].text is None,
        "near": lambda: long.class_id == got[None].class_id == 1 and got[2].class_size == 1,
        "bench": lambda: (long.n_words, long.n_hit) == (n, 10) and not got[2].contaminated,
        "secrets": lambda: long.n_assign == 1 and long.spans == f"assign:{LONG.index('api_key')}:{len(LONG)}",
        "html": lambda: long.text == LONG and got[3].text == "",
        "lang": lambda: long.lang_pred == "en" and got[3].lang_pred == "und",
        "suffix": lambda: got[None].n_removed == len(LONG) and long.n_removed < 2000 and got[3].n_bytes == 0,
        "exact": lambda: long.group_size == 2 and long.kept and not got[None].kept and got[3].keep_id == 3,
    }[name]()


def test_reruns_of_a_mix_agree(spark):
    """Rows of one id, or of none, in two orders of input."""
    rows = [(None, "w x y z", None, "a"), (None, "p q r s", None, "a"), (None, "k l m n", None, "a"), (7, "a b", None, "a"), (7, "c d", None, "a"), (8, "e f g", None, "b")]
    taken = lambda order: sorted(((r.doc_id, r.text, r.taken) for r in mixing.mix_sources(spark.createDataFrame(order, SCHEMA).coalesce(1)).collect()), key=repr)
    assert taken(rows) == taken(rows[::-1])
