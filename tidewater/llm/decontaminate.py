"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's windows.

Texts and benchmark items are normalised alike: UTF-8 bytes, A-Z lower-cased, every ASCII byte that is
no letter or digit made a space. That keeps one byte for one, so an offset in the normalised text is
one in the original. The automaton holds each window (``n`` consecutive words of an item; the whole item if
it has fewer). Its letters are codes of words: each word of the benchmark has a code of two or three letters, of which the first shows where a
code begins; all other words are one letter that no window has. Each text is read once.

Scale: documents are never shuffled. The benchmark is what is broadcast, and its size is checked: each worker builds one automaton and
keeps it (about 1 KB a window). A benchmark of over ``MAX_WORDS`` words or ``MAX_BYTES`` is taken in slices below that, each with an automaton and a
pass over the documents of its own, and the hits of all slices are put together by row.

Defined results: null and empty texts have no words and no hits; null, empty or wordless items have no
windows; items of one id are one item; repeated rows are rows of their own; with an empty benchmark nothing is hit. Columns of any name are kept
with keep=True. In slices ids must be integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import WORD_BYTES, Scratch, carried, numbered, slim, word_bytes

N = 10
#: Bounds of one automaton: words (and so windows) and bytes of benchmark text.
MAX_WORDS = 400_000
MAX_BYTES = 64 << 20
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"


def windows(words: list[bytes], n: int) -> set[bytes]:
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Codes(dict):
    """The code of each word that was asked for while open; others have the letter that no code has."""

    def __missing__(self, word: bytes) -> str:
        return "\0"


class Windows:
    """The automaton over the windows of items (id, text)."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        import ahocorasick

        bags = [word_bytes(text) for _, text in items]
        vocabulary = sorted({w for words in bags for w in words})
        # letters 1..127 begin a code, letters from 128 on go on with it
        wide = len(vocabulary) > 127 * 128
        code = lambda k: (chr(1 + k // 16384) if wide else "") + chr((128 if wide else 1) + k // 128 % 128) + chr(128 + k % 128)
        if len(vocabulary) > 127 * 16384:
            raise ValueError("more than two million words in one automaton")
        self.codes = Codes((w, code(k)) for k, w in enumerate(vocabulary))
        self.sizes: list[int] = []
        self.owners: list[set[int]] = []
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, words in enumerate(bags):
            for at in range(max(1, len(words) - n + 1) if words else 0):
                part = words[at : at + n]
                key = "".join(map(self.codes.__getitem__, part))
                k = self.auto.get(key, -1)
                if k < 0:
                    k = len(self.sizes)
                    self.auto.add_word(key, k)
                    self.sizes.append(len(part))
                    self.owners.append(set())
                self.owners[k].add(i)
        if self.sizes:
            self.auto.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[int]] | None:
        """Which words are hit, and by which items; None if none is."""
        if not self.sizes or not words:
            return None
        line = [self.codes[w] for w in words]
        ends, found = [], []
        for end, k in self.auto.iter("".join(line)):
            ends.append(end)
            found.append(k)
        if not found:
            return None
        last = np.searchsorted(np.cumsum([len(c) for c in line]), np.array(ends), "right") + 1
        steps = np.zeros(len(words) + 1, np.int64)
        np.add.at(steps, last - np.array([self.sizes[k] for k in found]), 1)
        np.add.at(steps, last, -1)
        return np.cumsum(steps)[:-1] > 0, set().union(*(self.owners[k] for k in set(found)))


_built: dict[str, Windows] = {}


def automaton(key: str, items: list[tuple[str, str]], n: int) -> Windows:
    """The worker's automaton, built at its first batch."""
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, n)
    return _built[key]


def _code_points(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Byte offsets of a UTF-8 text as code-point offsets."""
    b = np.frombuffer(raw, np.uint8)
    return np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))[at]


def normalised(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES) for t in texts]


_NOTHING = hashlib.sha256(b"").hexdigest()


def report(text: str | None, norm: bytes, n_words: int, hit: np.ndarray | None, names: set[str], n_items: int) -> tuple:
    """(n_words, n_hit, n_items, items_sha256, contaminated, spans) of a text."""
    if hit is None:
        return n_words, 0, 0, _NOTHING, False, ""
    solid = np.frombuffer(norm, np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    raw = (text or "").encode("utf-8", "surrogatepass")
    first = _code_points(raw, begins[np.flatnonzero(run == 1)])
    last = _code_points(raw, ends[np.flatnonzero(run == -1) - 1])
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return n_words, int(hit.sum()), n_items, digest, True, ",".join(f"{a}:{z}" for a, z in zip(first, last, strict=True))


def scan_texts(texts: list[str | None], auto: Windows, ids: list[str]) -> list[tuple]:
    """report() of each text; ids are those of the items, by number."""
    out = []
    for text, norm in zip(texts, normalised(texts), strict=True):
        words = norm.split()
        hit, owners = auto.hits(words) or (None, set())
        names = {ids[i] for i in owners}
        out.append(report(text, norm, len(words), hit, names, len(names)))
    return out


_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def _reported(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True))], _NAMES)


def decontaminate(
    spark, docs: DataFrame, benchmark: DataFrame, *, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: bool = False
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (hit runs, start:end in
    code points of the original). keep: the rows of docs that nothing hits, as they are, instead."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.coalesce(F.sum(F.regexp_count("t", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))), F.lit(0))).head()
    if size[0] > MAX_BYTES or size[1] > MAX_WORDS:
        return _in_slices(spark, docs, items, max(size[0] // MAX_BYTES, size[1] // MAX_WORDS) + 1, n, id_col, text_col, keep)
    pairs = sorted((r.i, r.t) for r in items.collect())
    ids = [i for i, _ in pairs]
    key = hashlib.sha256(repr((n, pairs)).encode()).hexdigest()
    held = spark.sparkContext.broadcast(pairs)

    def run(batches):
        for batch in batches:
            rows = scan_texts(batch.column(text_col).to_pylist(), automaton(key, held.value, n), ids)
            yield batch.filter(pa.array([not r[4] for r in rows], pa.bool_())) if keep else _reported(batch.column(id_col), rows)

    if keep:
        return docs.mapInArrow(run, docs.schema)
    few = docs.select(docs[id_col], docs[text_col])
    return few.mapInArrow(run, f"doc_id {few.schema[0].dataType.simpleString()}, {_RESULT}")


def _in_slices(spark, docs: DataFrame, items: DataFrame, slices: int, n: int, id_col: str, text_col: str, keep: bool) -> DataFrame:
    """decontaminate() for a benchmark too large for one automaton. Ids must be integers here."""
    scratch = Scratch(spark, "bench")
    rows, _ = numbered(scratch, slim(docs, id_col, text_col, carry=keep))
    found = None
    for k in range(slices):
        pairs = sorted((r.i, r.t) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k).collect())
        key = hashlib.sha256(repr((n, pairs)).encode()).hexdigest()
        part = rows.select("rid", "text").mapInArrow(_hits_of(key, spark.sparkContext.broadcast(pairs), n), "rid long, hits binary, items array<string>")
        part = scratch.table(part, f"slice{k}")
        found = part if found is None else found.unionByName(part)
    by_row = found.groupBy("rid").agg(F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = rows.join(by_row, "rid", "left")
    if keep:
        clean = joined.where(F.col("hits").isNull())
        return clean.select(*carried(clean, docs))

    def run(batches):
        for batch in batches:
            texts, hits, names = (batch.column(i).to_pylist() for i in (1, 2, 3))
            out = []
            for text, norm, runs, own in zip(texts, normalised(texts), hits, names, strict=True):
                n_words = len(norm.split())
                hit = np.logical_or.reduce([np.unpackbits(np.frombuffer(r, np.uint8), count=n_words).view(bool) for r in runs]) if runs else None
                out.append(report(text, norm, n_words, hit, set(own or ()), len(own or ())))
            yield _reported(batch.column(0), out)

    few = joined.select("doc_id", "text", "hits", "items")
    return few.mapInArrow(run, f"doc_id {few.schema[0].dataType.simpleString()}, {_RESULT}")


def _hits_of(key: str, held, n: int):
    def run(batches):
        for batch in batches:
            auto = automaton(key, held.value, n)
            rid, hits, items = [], [], []
            for row, norm in zip(batch.column(0).to_pylist(), normalised(batch.column(1).to_pylist()), strict=True):
                if got := auto.hits(norm.split()):
                    rid.append(row)
                    hits.append(np.packbits(got[0]).tobytes())
                    items.append(sorted({held.value[i][0] for i in got[1]}))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(hits, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["rid", "hits", "items"])

    return run


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


def oracle(n: int = N, docs: str = "documents", items: str = "benchmark") -> str:
    """The contract's rows in SQL, for documents without repeated ids: windows meet by their text, in as many lengths as items need."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

    def grams(table: str, key: str, of: str) -> str:
        ahead = ", ".join(f"lead(w, {k}) OVER ahead AS w{k}" for k in range(1, n))
        run = lambda k: " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, k))])
        sizes = " UNION ALL ".join(f"SELECT {key}, i, {k} AS k, {run(k)} AS g FROM {table}_ahead WHERE {of.format(k=k)}" for k in range(1, n + 1))
        return f"{table}_ahead AS (SELECT *, {ahead} FROM {table}_words WINDOW ahead AS (PARTITION BY {key} ORDER BY i)),\n{table} AS ({sizes})"

    last = f"w{n - 1}" if n > 1 else "w"
    return f"""
WITH doc_lists AS (SELECT doc_id, {words} AS ws FROM {docs}),
doc_words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM doc_lists),
item_lists AS (SELECT row_number() OVER () AS b, coalesce(item_id::VARCHAR, '') AS item, {words} AS ws FROM {items}),
item_words AS (SELECT b, unnest(ws) AS w, unnest(range(len(ws))) AS i, len(ws) AS size FROM item_lists),
{grams("item", "b", f"CASE WHEN {{k}} = {n} THEN {last} IS NOT NULL ELSE size = {{k}} AND i = 0 END")},
wanted AS (SELECT DISTINCT k, g, item FROM item JOIN item_lists USING (b)),
{grams("doc", "doc_id", "{k} IN (SELECT k FROM wanted)")},
hits AS (SELECT doc_id, i, k, item FROM doc JOIN wanted USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc_lists LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


ORACLE = oracle()
