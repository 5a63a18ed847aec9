"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document.

Features of a text, over all of it: each word, each pair of equal neighbouring words (as one sign: repetition), and
the character n-grams (n = 2..4) inside words, white space counting as a word's end. Each is hashed to one of ``BUCKETS`` learned vectors; their mean
goes through a softmax over two classes. Training is stochastic gradient descent in numpy on the driver.

The fit takes a bounded sample, about ``FIT_ROWS`` labelled documents of each class at any number of labels, chosen by a 64-bit hash of the id,
texts up to ``FIT_CHARS`` characters; of rows with one id the least text. With two classes the score of a mean is the mean of one number for
each bucket, so scoring is one table look-up per feature, in numpy over whole batches; the
table (1 MB) is what is broadcast.

Defined results: a null or empty text has no features and scores as the bias says; without labels of
both classes every score is 0.5; labels repeated for a document count once, conflicting ones as the
lower; null ids are neither learned from nor held out; repeated rows are rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import crc_mod, hash_limit, ngram_levels, text_pieces, tidy

BITS = 18
BUCKETS = 1 << BITS
DIM = 12
GRAMS = 4
FIT_ROWS = 1500
FIT_CHARS = 20_000
EPOCHS = 6
RATE = 0.4
KEEP = 0.7
SAME = 0  # the bucket of a word equal to the one before


def _gap(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(codes: np.ndarray):
    """(places, buckets) of the features of a piece, one kind after the other."""
    gap = _gap(codes)
    for n, h, good in ngram_levels(codes, gap, GRAMS):
        if n > 1:
            at = np.flatnonzero(good)
            yield at, _bucket(h[at])
    # words, by a polynomial hash from running sums
    edge = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return
    with np.errstate(over="ignore"):
        power = np.full(int((end - begin).max()), 0x9E3779B97F4A7C15, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        inside = np.flatnonzero(~gap)
        word = np.repeat(np.arange(len(begin)), end - begin)
        terms = (codes[inside].astype(np.uint64) + np.uint64(7)) * power[inside - begin[word]]
        h = np.add.reduceat(terms, np.concatenate(([0], np.cumsum(end - begin)[:-1])))
    yield begin, _bucket(h ^ np.uint64(0x5851F42D4C957F2D))
    same = np.flatnonzero(h[1:] == h[:-1]) + 1
    yield begin[same], np.full(len(same), SAME, np.int64)


def score_texts(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    """The probability of class 1 of each text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for codes, starts, rows in text_pieces(texts):
        for at, bucket in features(codes):
            if len(at):
                sums = np.concatenate(([0.0], np.cumsum(table[bucket], dtype=np.float64)))
                cut = np.searchsorted(at, starts)
                np.add.at(total, rows, np.diff(sums[cut]))
                np.add.at(count, rows, np.diff(cut))
    # 12 digits: what is left of the order of the sums goes
    return np.round(1 / (1 + np.exp(-(total / np.maximum(count, 1) + bias))), 9)


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """(a number for each bucket, bias) of the fitted two-class model."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), 0.0
    bags = []
    for text in texts:
        got = [b for codes, _, _ in text_pieces([text]) for _, b in features(codes)]
        u, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0))
        bags.append((u.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIM)) - 0.5) / DIM).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    out += ((rng.random((2, DIM)) - 0.5) / DIM).astype(np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        for i in rng.permutation(len(bags)):
            u, share = bags[i]
            mean = share @ vectors[u]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= np.float32(min(weight[y[i]], 3.0))
            back = p @ out
            out -= rate * np.outer(p, mean)
            bias -= rate * p
            # each vector's step in proportion to its share, larger for short shares as in bags of one
            vectors[u] -= (rate * 20) * share[:, None] * back
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def fit_quality(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The model, from a bounded sample of the labelled rows of docs."""
    own = labels.where(labels[label_col].isin(0, 1)).groupBy(labels[id_col].alias("id")).agg(F.min(label_col).alias("label"))
    sizes = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = F.lit(None).cast("long")
    for label, n in sizes.items():
        most = F.when(F.col("label") == label, F.lit(hash_limit(fit_rows, n))).otherwise(most)
    chosen = own.where(F.xxhash64(F.col("id").cast("string"), F.lit("fit")) <= most)
    rows = (
        docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        .where(F.col("text").isNotNull() & (F.char_length("text") <= fit_chars))
        .join(F.broadcast(chosen), "id")  # about two times fit_rows ids
        .groupBy("id", "label")
        .agg(F.min("text").alias("text"))  # an id may be on any number of rows
        .collect()
    )
    rows.sort(key=lambda r: (r.id, r.text))
    return train([r.text for r in rows], [r.label for r in rows])


def score_quality(spark, docs: DataFrame, model: tuple[np.ndarray, float], *, id_col: str = "doc_id", text_col: str = "text", keep: float | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted; with keep, the rows of docs that score as much, as they are."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = score_texts(batch.column(text_col).to_pylist(), *held.value)
            if keep is not None:
                yield batch.filter(pa.array(score >= keep))
                continue
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= KEEP).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    if keep is not None:
        return docs.mapInArrow(tidy(run), docs.schema)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias(text_col), F.coalesce(crc_mod(docs[id_col], 4) == 2, F.lit(False)).alias("held_out"))
    return slim.mapInArrow(tidy(run), f"doc_id {slim.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def learned(spark, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, float]:
    """The model that the contract's rows teach."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_quality(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(spark, docs, learned(spark, docs, sf_dir))
