"""Language ID by rank-order profiles.

A language's profile is its ``TOP`` most frequent character n-grams (n = 1..5, inside words, a word's
begin and end counting as a mark). A document's own most frequent n-grams, over its whole text, are held
against each profile: the out-of-place distance adds, for each n-gram, how far its rank is from
the profile's, or ``TOP`` if the profile lacks it. The least distance wins; ties go to the language that comes
first by code point. The score is ``1 - least / next`` (with one language: next is the largest possible).

Profiles are fitted on a bounded sample, ``FIT_ROWS`` labelled documents a language in expectation at any number of documents, chosen by a 64-bit
hash of the id; n-grams are counted in the executors, and the driver gets ``TOP`` rows a language. Prediction is a map. More than
``MAX_LANGS`` languages raise ValueError.

Defined results: null text, or one without a letter, is ``und`` with score 0; so is every text when
there is nothing to learn from; null ids are neither learned from nor held out; repeated rows are
rows of their own. Very long texts are counted in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import PIECE, crc_mod, hash_limit, ngram_levels, text_pieces, tidy

TOP = 300
MOST = 5
FIT_ROWS = 3000
#: More than there are language codes; what is collected and broadcast is TOP n-grams of each.
MAX_LANGS = 10_000
_letters: list[np.ndarray] = []


def _gap(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is no letter."""
    if not _letters:
        _letters.append(np.fromiter((not chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0][codes]


def gram_counts(texts: list[str | None], most: int = MOST):
    """For each text: (n-gram hashes, their counts); both empty without a letter."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts: dict[int, list] = {}
    lowered = [t.lower() if t else t for t in texts]
    for codes, starts, rows in text_pieces(lowered, PIECE // 4):
        gap = _gap(codes)
        levels = np.zeros((most, len(codes)), np.uint64)
        for n, h, good in ngram_levels(codes, gap, most):
            levels[n - 1, : len(h)] = np.where(good, h, np.uint64(0))
        for k, row in enumerate(rows):
            h, n = np.unique(levels[:, starts[k] : starts[k + 1]], return_counts=True)
            if len(h) and h[0] == 0:
                h, n = h[1:], n[1:]
            parts.setdefault(int(row), []).append((h, n))
    for row in range(len(texts)):
        got = parts.get(row, [none])
        if len(got) > 1:
            h, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
            got = [(h, np.bincount(at, np.concatenate([g[1] for g in got])).astype(np.int64))]
        yield got[0]


def ranked(h: np.ndarray, n: np.ndarray, top: int = TOP) -> np.ndarray:
    """The top hashes by count, ties by hash."""
    if len(h) > top:
        least = np.partition(n, len(n) - top)[len(n) - top]
        some = n >= least
        h, n = h[some], n[some]
    return h[np.lexsort((h, -n))][:top]


class Profiles:
    """Of each language the hashes in order of rank; places(h) sums the distances."""

    def __init__(self, by_lang: dict[str, list[int]], top: int = TOP):
        self.top, self.langs, self.tables = top, sorted(by_lang), []
        for lang in self.langs:
            h = np.array(by_lang[lang], np.int64).view(np.uint64)
            order = np.argsort(h)
            self.tables.append((h[order], order))

    def predict(self, h: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        own = ranked(h, n, self.top)
        if not len(own) or not self.langs:
            return "und", 0.0
        place, far = np.arange(len(own)), []
        for known, rank in self.tables:
            at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            hit = known[at] == own if len(known) else np.zeros(len(own), bool)
            far.append(int(np.where(hit, np.abs(rank[at] - place), self.top).sum()) if len(known) else self.top * len(own))
        order = sorted(range(len(far)), key=lambda i: (far[i], self.langs[i]))
        best, rest = far[order[0]], far[order[1]] if len(far) > 1 else self.top * len(own)
        return self.langs[order[0]], float(1 - best / rest) if rest else 0.0


def fit_profiles(docs: DataFrame, *, top: int = TOP, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the languages that docs names; about fit_rows documents of each are read."""
    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return Profiles({}, top)
    most = docs.sparkSession.createDataFrame([(lang, hash_limit(fit_rows, n)) for lang, n in sizes.items()], "lang string, most long")
    sample = known.join(F.broadcast(most), "lang").where(F.xxhash64(F.col("id").cast("string"), F.lit("fit")) <= F.col("most"))

    def count(batches):
        for batch in batches:
            by: dict[str, list] = {}
            for lang, got in zip(batch.column(1).to_pylist(), gram_counts(batch.column(0).to_pylist()), strict=True):
                by.setdefault(lang, []).append(got)
            for lang, got in by.items():
                h, at = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                n = np.bincount(at, np.concatenate([g[1] for g in got])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "h", "n"])

    grams = sample.select("text", "lang").mapInArrow(tidy(count), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    # unsigned order of hashes, as in ranked()
    order = (-F.col("n"), F.col("h") < 0, F.col("h"))
    out: dict[str, list[int]] = {lang: [] for lang in sizes}
    best = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("r") <= top)
    for r in sorted(best.collect(), key=lambda r: r.r):
        out[r.lang].append(r.h)
    return Profiles(out, top)


def identify(spark, docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = spark.sparkContext.broadcast(profiles)

    def run(batches):
        own = held.value
        for batch in batches:
            got = [own.predict(h, n) for h, n in gram_counts(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(crc_mod(docs[id_col], 5) == 0, F.lit(False)).alias("held_out"))
    return slim.mapInArrow(tidy(run), f"doc_id {slim.schema[0].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(spark, docs, fit_profiles(docs.where(crc_mod(F.col("doc_id"), 5) != 0)))
