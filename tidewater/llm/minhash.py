"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set of shingles (5 words; a text of fewer words is one shingle; words as in the decontamination
contract): times in the text by idf, log10((1 + n) / (1 + df)) + 1.

1. Document frequencies cover every shingle of every text that counts. A group of near copies counts as one text, so that its size says
   nothing about its members: a text follows another, and doesn't count, if plain MinHash puts both in one bucket, which the other leads (it
   has the smallest number), and their signatures agree (``FOLLOW``). Counts are kept in a sketch of ``DEPTH`` rows of ``WIDTH`` counters (12 MB):
   a frequency is never counted too low, and too high by about the mean number of shingles a text over WIDTH, as a part of all texts
   (0.05% for texts of 500 words), whatever the number of texts.
2. Texts with equal weighted sets are one class at once; the first stands for them (its set is the copies' too).
3. Each representative gets ``SAMPLES`` weighted samples. For weighted Jaccard similarity J two texts agree in a sample with
   probability J. ``ROWS`` samples are a band; texts that agree in a band meet in its bucket. Four bits of each sample are the text's signature.
4. Every text is compared with two leaders of each of its buckets, not with all: first by signature (``AGREE`` samples; at J = 0.8
   fewer agree once in 100,000 pairs), then by exact weighted Jaccard similarity of the whole texts, at least ``LEAST``.
5. Links make classes. In buckets that still hold texts of several classes the texts outside of the largest class are compared with all of
   other classes, each pair in the first bucket that it shares, again by signatures first; a task tells only the links that join classes. Large
   buckets are dealt out as pairs of blocks; pairs within a class need no comparison, and copies are never expanded.

Scale: shingles never shuffle; what does is signatures (100 bytes a text), bucket keys, and the texts of candidates. Leaders are pre-aggregated and
written, so that adaptive execution can split the joins with them where a bucket is hot.

Defined results: null, empty and wordless texts are classes of their own; repeated rows are copies; null ids come last; other
columns are not looked at, whatever their names. Ids must be integers. The class id is the smallest id of the class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.llm.common import WORD_BYTES, Scratch, carried, mix64, numbered, pieces_of, slim, tidy
from tidewater.llm.components import components, forest, root
from tidewater.llm.suffix_dedup import Hashes

SHINGLE = 5
LEAST = 0.8
BANDS = 10
ROWS = 3
SAMPLES = BANDS * ROWS
#: Samples of 30 that must agree in four bits (those of different samples do once in 16 times).
AGREE = 15
FOLLOW = 18
#: The sketch of document frequencies, merged by blocks of BLOCK_OF counters.
WIDTH_BITS = 20
WIDTH = 1 << WIDTH_BITS
DEPTH = 3
BLOCK_OF = 1 << 16
#: Partial sums of a block that are merged before the block's own sum.
MERGED = 16
BLOCK = 512
#: Rows of small buckets that a task takes together.
TOGETHER = 4000
PIECE = 1 << 20

_U = np.uint64
_OWNER = _U(48)
_SHINGLE_BITS = _U((1 << 48) - 1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order."""
    owners, hashes = [], []
    held: list[bytes] = []
    numbers: list[int] = []
    size = 0

    def flush():
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        gap = data == 32
        edge = np.diff(np.concatenate(([True], gap)).view(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        ends = np.cumsum([len(x) + 1 for x in held])
        owners.append(np.array(numbers)[np.searchsorted(ends, begin, "right")])
        hashes.append(Hashes(data).of(begin, end))

    for number, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)
        at = 0
        while at < len(raw):
            end = len(raw)
            if end - at > PIECE and (cut := raw.rfind(b" ", at, at + PIECE)) > at:
                end = cut
            if held and size + end - at > PIECE:
                flush()
                held, numbers, size = [], [], 0
            held.append(raw[at:end])
            numbers.append(number)
            size += end - at
            at = end
    if held:
        flush()
    return (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, np.int64), np.zeros(0, _U))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle, times), by text and shingle. At most 65,536 texts."""
    owner, words = word_hashes(texts)
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    n = max(len(words) - SHINGLE + 1, 0)
    h = np.zeros(n, _U)
    for i in range(SHINGLE):
        h = h * _U(0x9E3779B97F4A7C15) + words[i : i + n]
    whole = owner[:n] == owner[SHINGLE - 1 :] if n else np.zeros(0, bool)
    own, h = owner[:n][whole], mix64(h[whole])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        starts = np.cumsum(count) - count
        few = []
        for t in short:
            x = words[starts[t] : starts[t] + count[t]].copy()
            for i in range(1, len(x)):
                x[i:] += mix64(x[i - 1 : i] + _U(len(x)))
            few.append(mix64(x[-1:])[0])
        own, h = np.concatenate((own, short)), np.concatenate((h, np.array(few, _U)))
    key = np.sort(own.astype(_U) << _OWNER | h & _SHINGLE_BITS)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.concatenate((first, [len(key)])))
    key = key[first]
    return (key >> _OWNER).astype(np.int64), key & _SHINGLE_BITS, times


def _cells(shingles: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in each row of the sketch."""
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
    return [(shingles * _U(c) >> _U(64 - WIDTH_BITS)).astype(np.int64) for c in odd[:DEPTH]]


class Weights:
    """idf of shingles out of a sketch of their document frequencies (DEPTH by WIDTH) in n texts."""

    def __init__(self, counts: np.ndarray, n: int):
        self.n = n
        self.idf = (np.log10((1 + n) / (1 + np.maximum(counts, 1))) + 1).astype(np.float32)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return np.maximum.reduce([row[at] for row, at in zip(self.idf, _cells(shingles), strict=True)])  # the least count


_gamma: list[np.ndarray] = []


def _quantiles() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at 65,536 quantiles, and its logarithm."""
    if not _gamma:
        x = np.concatenate((np.geomspace(1e-6, 1, 200_000), np.linspace(1, 40, 400_000)[1:]))
        cdf = -np.expm1(-x) - x * np.exp(-x)
        g = np.interp((np.arange(65536) + 0.5) / 65536, cdf, x)
        _gamma.extend((g.astype(np.float32), np.log(g).astype(np.float32)))
    return _gamma[0], _gamma[1]


def weighted_samples(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES consistent samples of each text's set, as hashes (n by SAMPLES); texts without shingles have 0."""
    out = np.zeros((n, SAMPLES), _U)
    if not len(owner):
        return out
    gamma, log_gamma = _quantiles()
    step = 1 << 17  # stays in the processor's cache
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    cuts = [0]
    while cuts[-1] < len(begin):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin, begin[cuts[-1]] + step))))
    for a, z in zip(cuts, cuts[1:], strict=False):
        z = min(z, len(begin))
        low, high = begin[a], begin[z] if z < len(begin) else len(owner)
        starts = begin[a:z] - low
        sizes = np.diff(np.concatenate((starts, [high - low])))
        sh = shingles[low:high]
        log_w = np.log(weights[low:high])
        rows = owner[begin[a:z]]
        for k in range(SAMPLES):
            x = (sh + _U(k * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D & (1 << 64) - 1)) * _U(0xD6E8FEB86659FD93)
            x ^= x >> _U(32)
            x *= _U(0xD6E8FEB86659FD93)
            x ^= x >> _U(29)
            r = gamma[(x >> _U(48)).astype(np.int64)]
            beta = ((x & _U(0xFFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(65536)
            t = np.floor(log_w / r + beta)
            value = log_gamma[((x >> _U(24)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
            least = np.minimum.reduceat(value, starts)
            at = np.flatnonzero(value == np.repeat(least, sizes))
            seg = np.searchsorted(starts, at, "right") - 1
            first = np.concatenate(([True], seg[1:] != seg[:-1]))
            at = at[first]
            out[rows, k] = mix64(sh[at] * _U(0x9E3779B97F4A7C15) + t[at].astype(np.int64).view(_U))
    return out


def similarity(a: list[str | None], b: list[str | None], weights: Weights) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in pairs; 0 if one has no shingle."""
    sides = []
    for texts in (a, b):
        owner, sh, times = shingle_sets(texts)
        sides.append((owner.astype(_U) << _OWNER | sh, times * weights.of(sh).astype(np.float64)))
    (ka, wa), (kb, wb) = sides
    n = len(a)
    total = np.bincount((ka >> _OWNER).astype(np.int64), wa, n) + np.bincount((kb >> _OWNER).astype(np.int64), wb, n)
    if not len(ka) or not len(kb):
        return np.zeros(n)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    both = np.bincount((ka[hit] >> _OWNER).astype(np.int64), np.minimum(wa[hit], wb[at[hit]]), n)
    return np.divide(both, total - both, out=np.zeros(n), where=total > both) if n else np.zeros(0)


def _encode(counts: np.ndarray) -> bytes:
    """Counters of a block, all of them or with their places, in as few bytes each as the largest needs."""
    at = np.flatnonzero(counts)
    size = next(b for b in (1, 2, 4, 8) if b == 8 or counts.max(initial=0) < 1 << 8 * b)
    if len(at) * (2 + size) < len(counts) * size:
        return bytes([size, 1]) + len(at).to_bytes(4, "little") + at.astype("<u2").tobytes() + counts[at].astype(f"<u{size}").tobytes()
    return bytes([size, 0]) + counts.astype(f"<u{size}").tobytes()


def _add(counts: np.ndarray, data: bytes) -> None:
    size = data[0]
    if data[1]:
        n = int.from_bytes(data[2:6], "little")
        counts[np.frombuffer(data, "<u2", n, 6)] += np.frombuffer(data, f"<u{size}", n, 6 + 2 * n).astype(np.int64)
    else:
        counts += np.frombuffer(data, f"<u{size}", len(counts), 2).astype(np.int64)


_SUMS = ["block", "part", "texts", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_SUMS_DDL = "block int, part int, texts long, data binary"


def _block_rows(blocks: dict[int, np.ndarray], part: int, texts: int):
    """A row a block; block -1 tells the texts."""
    rows = [(-1, part, texts, b""), *((b, part, 0, _encode(c)) for b, c in blocks.items() if c.any())]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _SUMS[1], strict=True)], _SUMS[0])


def _counted(batches):
    """A task's sketch: on how many of its texts each shingle is."""
    from pyspark import TaskContext

    sums, texts = np.zeros((DEPTH, WIDTH), np.int64), 0
    for batch in batches:
        for part in pieces_of(batch, 0):
            owner, sh, _ = shingle_sets(part.column(0).to_pylist())
            texts += len(np.unique(owner))
            for row, at in zip(sums, _cells(sh), strict=True):
                row += np.bincount(at, minlength=WIDTH)
    if texts:
        context = TaskContext.get()
        yield from _block_rows(dict(enumerate(sums.reshape(-1, BLOCK_OF))), (context.partitionId() if context else 0) % MERGED, texts)


def _summed(batches):
    blocks: dict[int, np.ndarray] = {}
    texts = 0
    for batch in batches:
        for block, n, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            texts += n
            if block >= 0:
                _add(blocks.setdefault(block, np.zeros(BLOCK_OF, np.int64)), data)
    if blocks or texts:
        yield from _block_rows(blocks, 0, texts)


def plain_samples(owner: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """SAMPLES MinHash values of each text's set, times aside (n by SAMPLES); texts without shingles have 0."""
    out = np.zeros((n, SAMPLES), _U)
    if len(owner):
        begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for k in range(SAMPLES):
            x = (shingles + _U(k * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D & (1 << 64) - 1)) * _U(0xD6E8FEB86659FD93)
            x ^= x >> _U(32)
            x *= _U(0xD6E8FEB86659FD93)
            out[owner[begin], k] = np.minimum.reduceat(x, begin)
    return out


def signatures(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bits of each sample, as two numbers a text."""
    nibble = mix64(samples) & _U(15)
    shift = _U(4) * np.arange(16, dtype=_U)
    return tuple(np.bitwise_or.reduce(part << shift[: part.shape[1]], axis=1).view(np.int64) for part in (nibble[:, :16], nibble[:, 16:]))


def bands(samples: np.ndarray) -> np.ndarray:
    """Bucket keys of each text (n by BANDS)."""
    n = len(samples)
    s = samples.reshape(n, BANDS, ROWS)
    key = np.tile(np.arange(BANDS, dtype=_U) + _U(1), (n, 1))
    for i in range(ROWS):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + s[:, :, i])
    return key.view(np.int64)


def _lists(keys: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))


def agreeing(s1: str, s2: str, t1: str, t2: str) -> Column:
    """The samples of two signatures that agree in their four bits."""

    def differ(a, b):
        x = F.col(a).bitwiseXOR(F.col(b))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(SAMPLES) - differ(s1, t1) - differ(s2, t2)


def _plain(batches):
    for batch in batches:
        for part in pieces_of(batch, 1):
            owner, sh, _ = shingle_sets(part.column(1).to_pylist())
            samples = plain_samples(owner, sh, part.num_rows)
            some = pa.array(np.bincount(owner, minlength=part.num_rows) > 0)
            rows = pa.RecordBatch.from_arrays([part.column(0), _lists(bands(samples)), *map(pa.array, signatures(samples))], ["rid", "keys", "s1", "s2"])
            yield rows.filter(some)


def _buckets(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("rid", "s1", "s2", *more, F.posexplode("keys").alias("band", "key"))


def fit_weights(spark, scratch: Scratch, rows: DataFrame) -> Weights:
    """idf over rows of rid and text."""
    plain = scratch.table(rows.select("rid", "text").mapInArrow(tidy(_plain), "rid long, keys array<long>, s1 long, s2 long"), "plain")
    lead = _buckets(plain).groupBy("key").agg(F.min(F.struct("rid", "s1", "s2")).alias("of"), F.count("*").alias("n")).where(F.col("n") > 1)
    lead = scratch.table(lead.select("key", F.col("of.rid").alias("v"), F.col("of.s1").alias("t1"), F.col("of.s2").alias("t2")), "plain-lead")
    met = _buckets(plain).join(lead.hint("merge"), "key").where(F.col("rid") != F.col("v"))
    follow = met.where(agreeing("s1", "s2", "t1", "t2") >= FOLLOW).select("rid").distinct()
    heads = rows.select("rid", "text").join(follow.hint("merge"), "rid", "left_anti").select("text")
    sums = heads.mapInArrow(tidy(_counted), _SUMS_DDL).repartition("block", "part").mapInArrow(_summed, _SUMS_DDL).repartition("block").mapInArrow(_summed, _SUMS_DDL)
    counts, n = np.zeros((DEPTH * WIDTH // BLOCK_OF, BLOCK_OF), np.int64), 0
    for r in sums.collect():  # one row a block, and the texts of each task: at most DEPTH * WIDTH counters
        n += r.texts
        if r.block >= 0:
            _add(counts[r.block], r.data)
    for name in ("plain", "plain-lead"):
        scratch.drop(name)
    return Weights(counts.reshape(DEPTH, WIDTH), n)


_SKETCH = "ord long, rid long, f1 long, f2 long, keys array<long>, s1 long, s2 long, some boolean"


def _sketched(held):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 2):
                owner, sh, times = shingle_sets(part.column(2).to_pylist())
                n = part.num_rows
                samples = weighted_samples(owner, sh, times * held.value.of(sh), n)
                a, b = (mix64(mix64(sh + _U(s)) * times.astype(_U)) for s in (0x51ED2701, 0xA24BAED4))
                sums = [np.zeros(n, _U), np.zeros(n, _U)]
                if len(owner):
                    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    for s, x in zip(sums, (a, b), strict=True):
                        s[owner[begin]] = np.add.reduceat(x, begin)
                some = np.bincount(owner, minlength=n) > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *(pa.array(s.view(np.int64)) for s in sums), _lists(bands(samples)), *map(pa.array, signatures(samples)), pa.array(some)],
                    [c.split()[0] for c in _SKETCH.split(", ")],
                )

    return run


def _verified(held):
    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, 2, 1000):
                good = pa.array(similarity(part.column(2).to_pylist(), part.column(3).to_pylist(), held.value) >= LEAST - 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(good), part.column(1).filter(good)], ["u", "v"])

    return tidy(lambda batches: forest(run(batches)))


def unpacked(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """The four bits of each sample (n by SAMPLES)."""
    shift = _U(4) * np.arange(16, dtype=_U)
    both = [s.astype(np.int64).view(_U)[:, None] >> shift & _U(15) for s in (s1, s2)]
    return np.concatenate(both, axis=1)[:, :SAMPLES].astype(np.uint8)


def block_links(rid, label, band: int, left, right, keys, marks, owner_sets) -> list[tuple[int, int]]:
    """Links of a block pair that join classes. left and right say which side a text is on; -1: the block with itself. keys and marks are
    the texts' bucket keys and unpacked signatures."""
    starts, sizes, ids, weights = owner_sets
    total = np.add.reduceat(weights, starts)
    dense = np.zeros(int(ids.max()) + 1)
    one = left[0] == -1
    up: dict[int, int] = {}
    own = label.copy()
    found = []
    places = np.arange(len(rid))
    for i in np.flatnonzero(left != 0):
        other = np.flatnonzero((own != own[i]) & ((places > i) if one else (right != 0)))
        if not len(other):
            continue
        other = other[(marks[other] == marks[i]).sum(axis=1) >= AGREE]
        first = (keys[other] == keys[i]).argmax(axis=1)  # they share this band, so there is one
        other = other[first == band]
        if not len(other):
            continue
        mine = slice(starts[i], starts[i] + sizes[i])
        dense[ids[mine]] = weights[mine]
        n = sizes[other]
        at = np.repeat(starts[other], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.add.reduceat(np.minimum(dense[ids[at]], weights[at]), np.cumsum(n) - n)
        dense[ids[mine]] = 0
        joined = False
        for j in other[both / (total[i] + total[other] - both) >= LEAST - 1e-9]:
            a, b = root(up, int(label[i])), root(up, int(label[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                found.append((int(rid[i]), int(rid[j])))
                joined = True
        if joined:
            own = np.array([root(up, int(x)) for x in label])
    return found


def _across(held):
    def run(table: pa.Table) -> pa.Table:
        key, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
        rid, label, band, left, right, s1, s2 = (table.column(c).to_numpy() for c in ("rid", "label", "band", "left", "right", "s1", "s2"))
        keys = np.array(table.column("keys").to_pylist(), np.int64).reshape(len(rid), BANDS)
        marks = unpacked(s1, s2)
        texts = table.column("text").to_pylist()
        order = np.lexsort((rid, y, x, key))
        new = np.flatnonzero(np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))))
        out: list[tuple[int, int]] = []
        for part in np.split(order, new[1:]):
            owner, sh, times = shingle_sets([texts[i] for i in part])
            _, ids = np.unique(sh, return_inverse=True)
            starts = np.searchsorted(owner, np.arange(len(part)))
            sets = starts, np.diff(np.concatenate((starts, [len(owner)]))), ids, times * held.value.of(sh).astype(np.float64)
            out += block_links(rid[part], label[part], int(band[part[0]]), left[part], right[part], keys[part], marks[part], sets)
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return run


def near_classes(spark, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id of its class), class_size, kept (whether it is the row that stays)."""
    scratch = Scratch(spark, "near")
    rows, _ = numbered(scratch, slim(docs, id_col, text_col))
    return classes_of(spark, scratch, rows).drop("rid")


def classes_of(spark, scratch: Scratch, rows: DataFrame) -> DataFrame:
    """near_classes for rows as numbered() returns them, with rid beside."""
    weights = spark.sparkContext.broadcast(fit_weights(spark, scratch, rows))
    sketch, groups, label = _linked(scratch, rows, weights)

    # copies get the class of their representative; then the smallest id of each class, by order
    named = groups.select("f1", "f2", "copies", F.col("first.ord").alias("o"), F.col("first.rid").alias("r"))
    named = named.join(label.select(F.col("u").alias("r"), F.col("v").alias("l")).hint("merge"), "r", "left").withColumn("l", F.coalesce("l", "r"))
    named = scratch.table(named, "labels")
    heads = scratch.table(named.groupBy("l").agg(F.min(F.struct("o", "r")).alias("h"), F.sum("copies").alias("class_size")), "class-heads")
    of_group = named.join(heads.hint("merge"), "l").select("f1", "f2", F.col("h.r").alias("head"), F.col("h.o").alias("head_ord"), "class_size")
    member = sketch.where("some").select("ord", "rid", "f1", "f2").join(of_group.hint("merge"), ["f1", "f2"]).select("ord", "rid", "head", "head_ord", "class_size")
    alone = sketch.where("NOT some").select("ord", "rid", F.col("rid").alias("head"), F.col("ord").alias("head_ord"), F.lit(1).cast("long").alias("class_size"))
    null_id = (1 << 63) - 1
    back = lambda c: F.when(F.col(c) != null_id, F.col(c))
    return member.unionByName(alone).select(
        back("ord").alias("doc_id"), back("head_ord").alias("class_id"), "class_size", (F.col("rid") == F.col("head")).alias("kept"), "rid"
    )


def _linked(scratch: Scratch, rows: DataFrame, weights):
    """(sketch, groups of equal sets, label of the groups' first rows) by the broadcast weights."""
    texts = rows.select("rid", "text")
    sketch = scratch.table(rows.select("ord", "rid", "text").mapInArrow(tidy(_sketched(weights)), _SKETCH), "sketch")
    least = F.min(F.struct("ord", "rid", "keys", "s1", "s2"))
    groups = scratch.table(sketch.where("some").groupBy("f1", "f2").agg(least.alias("first"), F.count("*").alias("copies")), "groups")
    first = groups.select("first.rid", "first.keys", "first.s1", "first.s2")

    own = F.struct("rid", "s1", "s2")
    lead = _buckets(first).groupBy("key").agg(F.min(own).alias("a"), F.min(F.struct(F.xxhash64("rid", "key"), own.alias("of"))).alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
    lead = scratch.table(lead.select("key", F.array_distinct(F.array("a", "b.of")).alias("leads")), "lead")
    met = _buckets(first).join(lead.hint("merge"), "key").select("rid", "s1", "s2", F.explode("leads").alias("of"))
    met = met.select("rid", "s1", "s2", F.col("of.rid").alias("v"), F.col("of.s1").alias("t1"), F.col("of.s2").alias("t2")).where(F.col("rid") != F.col("v"))
    pairs = met.where(agreeing("s1", "s2", "t1", "t2") >= AGREE).select(F.greatest("rid", "v").alias("u"), F.least("rid", "v").alias("v")).distinct()
    a, b = (texts.select(F.col("rid").alias(c), F.col("text").alias("t" + c)) for c in "uv")
    both = scratch.table(pairs, "pairs").join(b.hint("merge"), "v").join(a.hint("merge"), "u").select("u", "v", "tu", "tv")
    label = components(scratch, both.mapInArrow(_verified(weights), "u long, v long"), "c0")

    named = first.join(label.select(F.col("u").alias("rid"), F.col("v").alias("l")).hint("merge"), "rid", "left").withColumn("label", F.coalesce("l", "rid")).drop("l")
    named = scratch.table(named, "named")
    mixed = _buckets(named, "label").groupBy("key", "label").count().groupBy("key")
    mixed = mixed.agg(F.max(F.struct("count", "label")).alias("big"), F.sum("count").alias("n"), F.count("*").alias("labels")).where(F.col("labels") > 1)
    seen = Observation()
    mixed = mixed.select("key", F.col("big.label").alias("big"), F.col("big.count").alias("n_big"), (F.col("n") - F.col("big.count")).alias("n_rest"))
    mixed = scratch.table(mixed.observe(seen, F.sum(F.col("n_big") + F.col("n_rest")).alias("n")), "mixed")
    if inside := seen.get["n"]:
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        member = _buckets(named, "label", "keys").join(mixed.hint("merge"), "key").withColumns({"nr": blocks("n_rest"), "nb": blocks("n_big"), "rest": F.col("label") != F.col("big")})
        # blocks 0..nr-1 hold the texts outside of the largest class, the next nb those in it, which are compared with the others only
        b = F.when(F.col("rest"), F.pmod(F.xxhash64("rid"), F.col("nr"))).otherwise(F.col("nr") + F.pmod(F.xxhash64("rid"), F.col("nb"))).cast("int")
        part = member.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.when(F.col("rest"), F.col("nr") + F.col("nb")).otherwise(F.col("nr")) - 1)))
        low, high = F.least("b", "o"), F.greatest("b", "o")
        part = part.select(
            "key", "band", "rid", "label", "keys", "s1", "s2", low.alias("x"), high.alias("y"),
            F.when(F.col("b") == F.col("o"), -1).when(F.col("b") < F.col("o"), 1).otherwise(0).alias("left"),
            F.when(F.col("b") > F.col("o"), 1).otherwise(0).alias("right"),
            F.when((F.col("nr") == 1) & (F.col("nb") == 1), F.pmod("key", F.lit(inside // TOGETHER + 1))).otherwise(F.xxhash64("key", low, high)).alias("g"),
        )
        whole = part.join(texts.hint("merge"), "rid").select("g", "key", "x", "y", "band", "rid", "label", "left", "right", "keys", "s1", "s2", "text")
        more = whole.groupBy("g").applyInArrow(_across(weights), "u long, v long")
        label = components(scratch, label.unionByName(more), "c1")
    for name in ("lead", "pairs", "mixed", "named"):
        scratch.drop(name)
    return sketch, groups, label


def keep_first(spark, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each class, the first."""
    scratch = Scratch(spark, "near")
    rows, _ = numbered(scratch, slim(docs, id_col, text_col, carry=True))
    kept = classes_of(spark, scratch, rows).where("kept").select("rid")
    kept = rows.join(kept.hint("merge"), "rid")
    return kept.select(*carried(kept, docs))


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_classes(spark, docs)
