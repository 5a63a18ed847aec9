"""Removal of repeated passages by a distributed, sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a row with a smaller id, or in
the same text. Strings are judged on the input.

Not every suffix is sorted. Of each window of LENGTH bytes the suffix at its *anchor* stands for it: the place
in the window whose ``GRAM`` bytes hash lowest, so equal windows have equal anchors. Windows in a row with one anchor are a
run (31 windows on average), and one suffix record (leading 8 bytes, hash of the GRAM bytes, hash of all the run's bytes) per run is enough:

1. Sampled splitters over these keys range-partition the records by leading tokens. A batch first keeps the
   first record of each run it holds (later ones are repeats already), so a passage that a third of all rows share is one record a batch.
   A bucket sorts by multikey quicksort, 8 bytes at a time. Equal runs: all but the first are repeats. Runs with equal anchors and different bytes may
   share some windows; so may the first and last anchors of a bucket with those of its neighbours, since
   splitters cut within an anchor's runs: these are compared across the boundary, in step 2.
2. Only such runs send their bytes. Those of one anchor meet in one bucket, or, where they are many or at a boundary, their
   windows are range-partitioned one by one. A bucket sorts windows; all but the first of equals are repeats.
3. Repeats come back to their texts by row; what they cover goes.

Bytes are compared by their first 8 and two 64-bit hashes. Texts shuffle twice (in 2 those with such runs only). Splitters, at most ``MAX_BUCKETS``,
are all that is broadcast. Ids that are null or repeated are replaced by row numbers written with the texts to the shared folder.

Defined results: null text is empty: nothing goes, and the hash is that of no bytes; a null id comes after all others, repeated rows
are rows of their own, of which the first stays; texts under LENGTH bytes stay whole; long texts are worked on in overlapping pieces.
Ids must be integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import Scratch, mix64, numbered, tidy

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
BUCKET_BYTES = 8 << 20
BUCKET_WINDOWS = 400_000
MAX_BUCKETS = 1 << 20
#: The splitters' sample: part of the text, in bytes within bounds, and keys of it that go to the driver, for each bucket and at most.
SAMPLE_SHARE = 0.01
SAMPLE_BYTES = (8 << 20, 4 << 30)
KEYS_A_BUCKET = 64
MAX_KEYS = 1 << 21
WIDE = 1000

_U = np.uint64
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict = {}


def _powers(which: int, size: int):
    """(value of each byte, powers of the base, powers of its inverse), grown as needed."""
    got = _tables.get(which)
    if got is None or len(got[1]) < size:
        base = _BASE[which]
        grow = lambda b: np.cumprod(np.concatenate((np.ones(1, _U), np.full(size - 1, b, _U))))
        values = mix64(np.arange(1, 257, dtype=_U) * _U(base)) | _U(1)
        got = _tables[which] = values, grow(base), grow(pow(base, -1, 1 << 64))
    return got


class Hashes:
    """Polynomial hashes of any range of some bytes."""

    def __init__(self, data: np.ndarray, which: int = 0):
        values, up, self.down = _powers(which, len(data) + 1)
        self.sums = np.concatenate((np.zeros(1, _U), np.cumsum(values[data] * up[: len(data)])))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as one big-endian number."""
    out = np.zeros(len(at), _U)
    for i in range(8):
        out = (out << _U(8)) | data[at + i].astype(_U)
    return out


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order by the keys in turn; each next key sorts only what is equal so far."""
    order = np.argsort(keys[0], kind="stable")
    equal = np.concatenate(([False], keys[0][order][1:] == keys[0][order][:-1]))
    for key in keys[1:]:
        tied = equal.copy()
        tied[:-1] |= equal[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        run = np.cumsum(~equal)[at]
        part = order[at]
        order[at] = part[np.lexsort((key[part], run))]
        k = key[order]
        equal[1:] &= k[1:] == k[:-1]
    return order


def place(splitters: tuple[np.ndarray, ...], keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """The number of splitters at or below each key, lexicographically."""
    low = np.searchsorted(splitters[0], keys[0], "left")
    high = np.searchsorted(splitters[0], keys[0], "right")
    if len(keys) == 1:
        return high
    at = np.flatnonzero(high > low)
    tied = low[at]
    for first in np.unique(tied):
        some = at[tied == first]
        z = high[some[0]]
        low[some] = first + place(tuple(s[first:z] for s in splitters[1:]), tuple(k[some] for k in keys[1:]))
    return low


def text_runs(texts: list[bytes]):
    """For pieces of the texts: (data, Hashes, text number, offset of data[0] seen from the text, first and last window, anchor), places in data."""
    held, numbers, offsets, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"".join(held), np.uint8)
        lens = np.array([len(x) for x in held])
        ends = np.cumsum(lens)
        hashes = Hashes(data)
        n = len(data) - GRAM + 1
        h = hashes.of(np.arange(n), np.arange(GRAM, len(data) + 1))
        # the lowest hash of each window, the first of equals
        m = (h >> _U(24) << _U(24)) | np.arange(n, dtype=_U)
        width, step = LENGTH - GRAM + 1, 1
        while step * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if width > step:
            m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        anchor = (m & _U(0xFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(held)), lens)[: len(anchor)]
        p = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= ends[owner])
        cut = np.flatnonzero((np.diff(anchor[p]) != 0) | (np.diff(owner[p]) != 0)) + 1
        lo = p[np.concatenate(([0], cut))]
        hi = p[np.concatenate((cut - 1, [len(p) - 1]))]
        own = owner[lo]
        return data, hashes, np.array(numbers)[own], (np.array(offsets) - (ends - lens))[own], lo, hi, anchor[lo]

    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), PIECE):
            part = text[at : at + PIECE + LENGTH - 1]
            if held and size + len(part) > PIECE + LENGTH:
                yield flush()
                held, numbers, offsets, size = [], [], [], 0
            held.append(part)
            numbers.append(number)
            offsets.append(at)
            size += len(part)
    if held:
        yield flush()


_RECORD = (("ord", np.int64), ("rid", np.int64), ("p", np.int64), ("n", np.uint8), ("k0", _U), ("k1", _U), ("k2", _U))


def _pack(cols: dict, pick: np.ndarray, kinds=_RECORD) -> bytes:
    return len(pick).to_bytes(8, "little") + b"".join(cols[k][pick].astype(t).tobytes() for k, t in kinds)


def _unpack(blobs: list[bytes], kinds=_RECORD) -> tuple[dict, list[bytes]]:
    """The columns of all blobs, and what follows the columns in each."""
    parts: dict[str, list] = {k: [] for k, _ in kinds}
    rests = []
    for b in blobs:
        n, at = int.from_bytes(b[:8], "little"), 8
        for k, t in kinds:
            parts[k].append(np.frombuffer(b, t, n, at))
            at += n * np.dtype(t).itemsize
        rests.append(b[at:])
    return {k: np.concatenate(v) if v else np.zeros(0, t) for (k, t), v in zip(kinds, parts.values(), strict=True)}, rests


_RUN = (("lo", np.int64), ("n", np.int64))
_ASK = (("lo", np.int64), ("n", np.int64), ("wide", np.uint8))


def _by_row(rid: np.ndarray, cols: dict, kinds):
    """(row, packed columns) for each row."""
    order = np.argsort(rid, kind="stable")
    r = rid[order]
    edges = np.flatnonzero(np.diff(r)) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(rid[part[0]]), _pack(cols, part, kinds)


def _firsts(keys: list[np.ndarray], order_keys: list[np.ndarray]):
    """(order, whether each place in it begins a group of equal keys), groups in the order of order_keys."""
    order = multikey_order([*keys, *order_keys])
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _records(ords: np.ndarray, rids: np.ndarray, texts: list[bytes]) -> dict:
    parts: dict[str, list] = {k: [] for k, _ in _RECORD}
    for data, hashes, number, shift, lo, hi, anchor in text_runs(texts):
        for k, v in (
            ("ord", ords[number]), ("rid", rids[number]), ("p", lo + shift), ("n", hi - lo + 1),
            ("k0", leading(data, anchor)), ("k1", hashes.of(anchor, anchor + GRAM)), ("k2", hashes.of(lo, hi + LENGTH)),
        ):
            parts[k].append(v)
    return {k: np.concatenate(parts[k]) if parts[k] else np.zeros(0, t) for k, t in _RECORD}


def _batch(batch):
    as_bytes = [x.encode("utf-8", "surrogatepass") if x else b"" for x in batch.column(2).to_pylist()]
    return batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), as_bytes


def _out(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


_SENT = ["bucket", "rid", "data"], [pa.int32(), pa.int64(), pa.binary()]
_SENT_DDL = "bucket int, rid long, data binary"


def _answer_rows(rid: np.ndarray, lo: np.ndarray, n: np.ndarray, buckets: int):
    """Repeats on their way through a shuffle of buckets, as buckets of their own."""
    for row, data in _by_row(rid, {"lo": lo, "n": n}, _RUN):
        yield buckets + row % buckets, row, data


def _split(cols: dict, splitters, pick: np.ndarray, kinds=_RECORD, extra=None):
    """(bucket, None, blob) of the picked records by range of their keys."""
    where = place(splitters, tuple(cols[k][pick] for k in ("k0", "k1", "k2")))
    order = np.argsort(where, kind="stable")
    edges = np.flatnonzero(np.diff(where[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            chosen = pick[part]
            yield int(where[part[0]]), None, _pack(cols, chosen, kinds) + (extra(chosen) if extra else b"")


def _send_runs(splitters):
    buckets = len(splitters[0]) + 1

    def run(batches):
        for batch in batches:
            c = _records(*_batch(batch))
            if not len(c["p"]):
                continue
            order, new = _firsts([c["k1"], c["k2"]], [c["ord"], c["rid"], c["p"]])
            again = order[~new]
            rows = list(_answer_rows(c["rid"][again], c["p"][again], c["n"][again], buckets))
            rows += _split(c, splitters, np.sort(order[new]))
            yield _out(rows, *_SENT)

    return run


_FOUND = ["rid", "asks", "windows", "data"], [pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
_FOUND_DDL = "rid long, asks boolean, windows long, data binary"


def _sort_runs(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() >= buckets:
            rows = [(r, False, 0, d) for r, d in zip(table.column("rid").to_pylist(), table.column("data").to_pylist(), strict=True)]
            return pa.Table.from_batches([_out(rows, *_FOUND)])
        c, _ = _unpack(table.column("data").to_pylist())
        order, new = _firsts([c["k0"], c["k1"], c["k2"]], [c["ord"], c["rid"], c["p"]])
        again = order[~new]
        rows = [(r, False, 0, d) for r, d in _by_row(c["rid"][again], {"lo": c["p"][again], "n": c["n"][again]}, _RUN)]
        first = order[new]
        k0, k1 = c["k0"][first], c["k1"][first]
        begins = np.concatenate(([True], (k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])))
        group = np.cumsum(begins) - 1
        size = np.bincount(group)
        edge = np.zeros(len(size), bool)
        edge[[0, -1]] = True
        wide = edge | (size > WIDE)
        ask = (size > 1) | edge
        some = ask[group]
        f = first[some]
        cols = {"lo": c["p"][f], "n": c["n"][f], "wide": wide[group][some]}
        rows += [(r, True, int(_unpack([d], _ASK)[0]["n"].sum()), d) for r, d in _by_row(c["rid"][f], cols, _ASK)]
        return pa.Table.from_batches([_out(rows, *_FOUND)])

    return run


#: Windows, and runs of which the bytes follow the columns.
_WINDOW = (("ord", np.int64), ("rid", np.int64), ("p", np.int64), ("k0", _U), ("k1", _U), ("k2", _U))


def _keys(data: np.ndarray, at: np.ndarray):
    a, b = Hashes(data, 0), Hashes(data, 1)
    return leading(data, at), a.of(at, at + LENGTH), b.of(at, at + LENGTH)


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of each place of ranges."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.repeat(start, n) + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _send_bytes(splitters):
    buckets = len(splitters[0]) + 1

    def run(batches):
        for batch in batches:
            ords, rids, texts = _batch(batch)
            narrow: list[tuple] = []
            windows: dict[str, list] = {k: [] for k, _ in _WINDOW}
            for ord_, rid, text, blobs in zip(ords, rids, texts, batch.column(3).to_pylist(), strict=True):
                c, _ = _unpack(blobs, _ASK)
                if (w := c["wide"] == 1).any():
                    for lo, n in zip(c["lo"][w], c["n"][w], strict=True):
                        data = np.frombuffer(text[lo : lo + n + LENGTH - 1], np.uint8)
                        at = np.arange(n)
                        for k, v in zip(("ord", "rid", "p", "k0", "k1", "k2"), (np.full(n, ord_), np.full(n, rid), at + lo, *_keys(data, at)), strict=True):
                            windows[k].append(v)
                narrow += [(ord_, rid, lo, n, text[lo : lo + n + LENGTH - 1]) for lo, n in zip(c["lo"][~w], c["n"][~w], strict=True)]
            rows = []
            if windows["p"]:
                c = {k: np.concatenate(v) for k, v in windows.items()}
                order, new = _firsts([c["k1"], c["k2"]], [c["ord"], c["rid"], c["p"]])
                again = order[~new]
                rows += _answer_rows(c["rid"][again], c["p"][again], np.ones(len(again)), 2 * buckets)
                rows += [(buckets + b, None, d) for b, _, d in _split(c, splitters, np.sort(order[new]), _WINDOW)]
            if narrow:
                c = {k: np.array([x[i] for x in narrow], np.int64) for i, k in enumerate(("ord", "rid", "p", "n"))}
                bodies = [x[4] for x in narrow]
                c |= {"k0": np.zeros(len(narrow), _U), "k1": np.zeros(len(narrow), _U), "k2": np.zeros(len(narrow), _U)}
                _anchors(c, bodies)
                rows += _split(c, splitters, np.arange(len(narrow)), extra=lambda chosen: b"".join(bodies[i] for i in chosen))
            yield _out(rows, *_SENT)

    return run


def _anchors(c: dict, bodies: list[bytes]) -> None:
    """Keys of the anchors that runs share; k2 stays 0, so that one anchor has one bucket."""
    at = 0
    while at < len(bodies):
        z, size = at, 0
        while z < len(bodies) and size < PIECE:
            size += len(bodies[z])
            z += 1
        data = np.frombuffer(b"".join(bodies[at:z]), np.uint8)
        lens = np.array([len(b) for b in bodies[at:z]])
        start = np.cumsum(lens) - lens
        h = Hashes(data)
        # all windows of a run have the anchor: it lies in its last window as in its first
        first, width = start + c["n"][at:z] - 1, LENGTH - GRAM + 2 - c["n"][at:z]
        owner, where = _spread(first, width)
        low = (h.of(where, where + GRAM) >> _U(24) << _U(24)) | (where - first[owner]).astype(_U)
        best = np.minimum.reduceat(low, np.cumsum(width) - width)
        anchor = first + (best & _U(0xFFFFFF)).astype(np.int64)
        c["k0"][at:z] = leading(data, anchor)
        c["k1"][at:z] = h.of(anchor, anchor + GRAM)
        at = z


def _sort_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        blobs = table.column("data").to_pylist()
        if bucket >= 2 * buckets:
            return pa.Table.from_batches([_out([(r, False, 0, d) for r, d in zip(table.column("rid").to_pylist(), blobs, strict=True)], *_FOUND)])
        if bucket >= buckets:
            c, _ = _unpack(blobs, _WINDOW)
        else:
            c = {k: [] for k, _ in _WINDOW}
            for blob in blobs:
                r, (body,) = _unpack([blob])
                n = r["n"].astype(np.int64)
                size = n + LENGTH - 1
                owner, at = _spread(np.cumsum(size) - size, n)
                data = np.frombuffer(body, np.uint8)
                p = np.repeat(r["p"], n) + (at - np.repeat(np.cumsum(size) - size, n))
                for k, v in zip(("ord", "rid", "p", "k0", "k1", "k2"), (r["ord"][owner], r["rid"][owner], p, *_keys(data, at)), strict=True):
                    c[k].append(v)
            c = {k: np.concatenate(v) for k, v in c.items()}
        order, new = _firsts([c["k0"], c["k1"], c["k2"]], [c["ord"], c["rid"], c["p"]])
        again = order[~new]
        rid, p = c["rid"][again], c["p"][again]
        o = np.lexsort((p, rid))
        rid, p = rid[o], p[o]
        begin = np.concatenate(([True], (np.diff(rid) != 0) | (np.diff(p) != 1))) if len(p) else np.zeros(0, bool)
        at = np.flatnonzero(begin)
        n = np.diff(np.concatenate((at, [len(p)])))
        rows = [(r, False, 0, d) for r, d in _by_row(rid[at], {"lo": p[at], "n": n}, _RUN)]
        return pa.Table.from_batches([_out(rows, *_FOUND)])

    return run


def removed_spans(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal byte runs that repeated windows cover."""
    if not blobs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c, _ = _unpack(blobs, _RUN)
    order = np.argsort(c["lo"], kind="stable")
    lo, end = c["lo"][order], np.maximum.accumulate((c["lo"] + c["n"] + LENGTH - 1)[order])
    new = np.concatenate(([True], lo[1:] > end[:-1]))
    at = np.flatnonzero(new)
    return lo[at], end[np.concatenate((at[1:] - 1, [len(lo) - 1]))]


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(texts_too: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for text, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass") if text else b""
                start, end = removed_spans(blobs)
                kept = b"".join(raw[a:z] for a, z in zip([0, *end], [*start, len(raw)], strict=True))
                rows.append((len(raw), int((end - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "replace")] if texts_too else [])))
            cols = list(zip(*rows, strict=True)) or [[]] * (4 + texts_too)
            kinds = [pa.int64()] * 3 + [pa.string()] * (1 + texts_too)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts_too,
            )

    return run


def _sampled(limit: int):
    """Keys of texts, those of which the hash is at most limit."""

    def run(batches):
        for batch in batches:
            c = _records(*_batch(batch))
            yield _out([(_pack(c, np.flatnonzero(mix64(c["k2"]) <= _U(limit)), _RECORD[4:]),)], ["data"], [pa.binary()])

    return run


def _sampled_keys(rows: DataFrame):
    """(some of the keys of sampled texts in order, buckets of about BUCKET_BYTES of text for all of them)."""
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    buckets = size // BUCKET_BYTES + 1
    read = min(size, max(size * SAMPLE_SHARE, SAMPLE_BYTES[0]), SAMPLE_BYTES[1])
    # a key for some 31 bytes; of all keys read, so many that the driver's part is bounded whatever the texts' lengths
    wanted = min(MAX_KEYS, KEYS_A_BUCKET * buckets + 1000) / max(read / 31, 1)
    limit = (1 << 64) - 1 if wanted >= 1 else int(wanted * (1 << 64))
    got = rows.sample(min(1.0, read / max(size, 1)), seed=11).mapInArrow(tidy(_sampled(limit)), "data binary").collect()
    c, _ = _unpack([bytes(r.data) for r in got], _RECORD[4:])
    order = multikey_order([c["k0"], c["k1"], c["k2"]]) if len(c["k0"]) else np.zeros(0, np.int64)
    return tuple(c[k][order] for k in ("k0", "k1", "k2")), buckets


def _cut(keys: tuple[np.ndarray, ...], buckets: int):
    """(splitters, number of buckets): every so manyth key, in at least 2 and at most MAX_BUCKETS buckets."""
    buckets = int(max(1, min(MAX_BUCKETS, max(2, buckets), len(keys[0]) + 1)))
    at = (np.arange(1, buckets) * len(keys[0])) // buckets
    return tuple(k[at] for k in keys), buckets


def remove_repeats(spark, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; with texts, what is left as ``kept``."""
    scratch = Scratch(spark, "suffix")
    slim, _ = numbered(scratch, docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "doc_id")
    rows = slim.select("ord", "rid", "text")
    keys, buckets = _sampled_keys(rows)
    splitters, buckets = _cut(keys, buckets)
    parts = max(2, min(buckets, 20_000))

    sent = rows.mapInArrow(tidy(_send_runs(splitters)), _SENT_DDL)
    found = scratch.table(sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_sort_runs(buckets), _FOUND_DDL), "found")
    # buckets for the runs that ask, by the windows they have
    windows = found.where("asks").agg(F.coalesce(F.sum("windows"), F.lit(0))).head()[0]
    splitters, buckets = _cut(keys, windows // BUCKET_WINDOWS + 1)
    parts = max(2, min(buckets, 20_000))
    asks = found.where("asks").groupBy("rid").agg(F.collect_list("data").alias("asks"))
    bodies = rows.join(asks, "rid").select("ord", "rid", "text", "asks").mapInArrow(tidy(_send_bytes(splitters)), _SENT_DDL)
    shared = bodies.repartition(parts, "bucket").groupBy("bucket").applyInArrow(_sort_windows(buckets), _FOUND_DDL)
    repeats = found.where("NOT asks").unionByName(shared).groupBy("rid").agg(F.collect_list("data").alias("runs"))
    return (
        slim.join(repeats, "rid", "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(tidy(_finish(texts)), "doc_id long, " + _RESULT + (", kept string" if texts else ""))
    )


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(length: int = LENGTH, table: str = "documents") -> str:
    """The contract's rows in SQL, for ids without nulls or repeats: every window of every text, by its MD5. Texts are cut in blocks first, as
    a substring's price grows with its place."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM {table}),
b AS (SELECT doc_id, b, substr(x, 2 * b + 1, {2 * (500 + length - 1)}) AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {length - 1}, 500)) AS b FROM d)),
w AS (SELECT doc_id, b + q AS p, md5_number(substr(y, 2 * q + 1, {2 * length})) AS g FROM (SELECT doc_id, b, y, unnest(range(0, len(y) // 2 - {length - 1})) AS q FROM b)),
a AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
r AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {length}, -1) AS starts FROM a),
k AS (SELECT doc_id, p, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r),
s AS (SELECT doc_id, min(p) AS lo, max(p) + {length} AS hi FROM k GROUP BY doc_id, run),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM s),
t AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS head
  FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""


ORACLE = oracle()
