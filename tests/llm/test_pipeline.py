"""The pipeline against a version that goes over lists."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import decontaminate, line_dedup, minhash, mixing, quality
from tidewater.llm.common import Scratch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Odd rows beside those of the smallest tables."""
    path = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "Only a few words here.", "en", None, 22)], docs.schema)
    docs.unionByName(odd).coalesce(1).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        os.symlink(f"{SF}/{t}.parquet", f"{path}/{t}.parquet")
    return path


def test_stages_one_by_one(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet")
    columns = docs.columns
    model = quality.learned(spark, docs, inputs)
    rows = sorted((r.asDict() for r in docs.collect()), key=lambda r: r["doc_id"])

    # 1: quality
    scores = quality.score_texts([r["text"] for r in rows], *model)
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.7]
    got = spark.createDataFrame(corpus_pipeline.good_quality(spark, docs, inputs).collect(), docs.schema)
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == [r["doc_id"] for r in rows]

    # 2: lines
    seen_lines, seen_runs, left = set(), set(), []
    n = line_dedup.MIN_LINES
    for r in rows:
        if r["text"] is None:
            left.append(r)
            continue
        lines = r["text"].split("\n")
        solid = [(i, x.strip(line_dedup.BLANKS)) for i, x in enumerate(lines) if x.strip(line_dedup.BLANKS)]
        gone = set()
        for i, x in solid:
            if x in seen_lines and len(x) >= line_dedup.MIN_CHARS:
                gone.add(i)
            seen_lines.add(x)
        for k in range(len(solid) - n + 1):
            run = tuple(x for _, x in solid[k : k + n])
            if run in seen_runs:
                gone.update(i for i, _ in solid[k : k + n])
            seen_runs.add(run)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip(line_dedup.BLANKS):
            left.append(r | {"text": text, "n_chars": len(text)})
    got = corpus_pipeline.without_repeated_lines(spark, got, inputs)
    assert got.columns == columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in left), key=repr)

    # 3: near duplicates, by all pairs
    got = spark.createDataFrame(got.collect(), docs.schema).coalesce(1)
    weights = minhash.fit_weights(spark, Scratch(spark, "t"), got.selectExpr("doc_id AS rid", "text"))
    up = list(range(len(left)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(i, j) for i in range(len(left)) for j in range(i)]
    for k in range(0, len(pairs), 2000):
        part = pairs[k : k + 2000]
        sim = minhash.similarity([left[i]["text"] for i, _ in part], [left[j]["text"] for _, j in part], weights)
        for at in np.flatnonzero(sim >= 0.8 - 1e-9):
            a, b = root(part[at][0]), root(part[at][1])
            up[max(a, b)] = min(a, b)
    left = [r for i, r in enumerate(left) if root(i) == i]
    got = corpus_pipeline.one_of_each_class(spark, got, inputs)
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == [r["doc_id"] for r in left]

    # 4: benchmark windows, by search
    got = spark.createDataFrame(got.collect(), docs.schema)
    from tidewater.llm.common import word_bytes

    wins = set()
    for r in spark.read.parquet(f"{inputs}/benchmark.parquet").collect():
        wins |= decontaminate.windows(word_bytes(r.text), 10)
    clean = lambda t: not any(b" " + w + b" " in b" " + b" ".join(word_bytes(t)) + b" " for w in wins)
    left = [r for r in left if clean(r["text"])]
    got = corpus_pipeline.without_benchmark(spark, got, inputs)
    assert got.columns == columns and sorted(r.doc_id for r in got.collect()) == [r["doc_id"] for r in left]

    # 5: mixture, by its SQL
    got = spark.createDataFrame(got.collect(), docs.schema)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in left])
    rel = con.sql(mixing.ORACLE)
    want = {x[rel.columns.index("doc_id")]: x[rel.columns.index("taken")] // max(1, x[rel.columns.index("size")]) for x in rel.fetchall()}
    mixed = corpus_pipeline.mixture(spark, got, inputs)
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, n in want.items() if n}


def test_run_is_the_stages_in_turn(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, inputs)).collect(), out.schema)
    key = lambda df: sorted((r.doc_id, r["copy"], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect())
    before = len(Scratch.made)
    made = corpus_pipeline.run(spark, inputs)
    assert key(made) == key(docs)
    # what stages wrote on the way has gone, and so have all results but the last
    assert len(Scratch.made) == before + 1 and os.listdir(Scratch.made[-1].path.removeprefix("file:")) == ["mix"]


def test_every_stage_takes_an_empty_table(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, inputs).count() == 0


def test_stages_keep_columns_of_any_name(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet").selectExpr("*", "1 AS rid", "2 AS ord", "3 AS gone", "4 AS n_lines", "5 AS n_removed", "6 AS row", "7 AS key", "8 AS class_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = spark.createDataFrame((out := stage(spark, docs, inputs)).collect(), out.schema)
        assert docs.columns == columns
        assert docs.selectExpr("rid = 1 AND ord = 2 AND gone = 3 AND n_lines = 4 AND n_removed = 5 AND row = 6 AND key = 7 AND class_id = 8 AS good").where("NOT good").count() == 0


def test_a_null_text_is_scored_as_an_empty_one(spark, inputs):
    docs = spark.read.parquet(f"{inputs}/documents.parquet").where("doc_id > 9000")
    model = quality.learned(spark, spark.read.parquet(f"{inputs}/documents.parquet"), inputs)
    null, empty = quality.score_texts([None, ""], *model)
    kept = {r.doc_id for r in quality.score_quality(spark, docs, model, keep=quality.KEEP).collect()}
    assert null == empty and (9001 in kept) == (9002 in kept) == (null >= 0.7)
