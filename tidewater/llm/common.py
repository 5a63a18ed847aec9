"""What the training-data operators share: scratch tables, words, column names."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes to words: A-Z lower-cased, ASCII that is neither letter nor digit to a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: White space as the contracts have it.
BLANKS = " \t\n\x0b\x0c\r"


def word_bytes(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir: without that setting a ValueError is raised there. Only a local master
    (one process, as in tests) gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        path = tempfile.mkdtemp(prefix="tidewater-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone: its owner clears the folder
        pass


class Scratch:
    """Tables written in the shared folder, so that a lost executor costs no more than its tasks.

    The folder goes when the session's Python process ends, on close(), or at the end of the short_lived() block that it was made in.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        Scratch.made.append(self)
        self.path = f"{scratch_dir(spark)}/tidewater-{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.path)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        if self in Scratch.made:
            Scratch.made.remove(self)
        _delete(self.spark, self.path)


@contextmanager
def short_lived():
    """Deletes the tables that operators have written on the way inside of the block: write their result, or collect it, before it ends."""
    before = list(Scratch.made)
    try:
        yield
    finally:
        for scratch in [s for s in Scratch.made if s not in before]:
            scratch.close()


LAST = (1 << 63) - 1


def slim(docs: DataFrame, id_col: str, text_col: str, *, carry: bool = False) -> DataFrame:
    """doc_id and text of docs; with carry, ``row`` beside: all columns of docs as one struct, so that no name of theirs can clash with one of ours."""
    own = [docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text")]
    return docs.select(*own, *([F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []))


def carried(rows: DataFrame, docs: DataFrame) -> list[Column]:
    """The columns of docs out of ``row``."""
    return [rows["row"].getField(c).alias(c) for c in docs.columns]


def numbered(scratch: Scratch, docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """docs (of slim()) with ``ord`` (the id, null as the largest) and ``rid`` (unique), and the number of rows.

    rid is the id where ids are unique; else the rows are numbered and written to the shared folder, so
    that every later read sees the same numbers.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be integers, {id_col} is {kind}")
    own = docs[id_col].cast("long")
    counted = docs.select(own.alias("i")).groupBy("i").count()
    n, most, nulls = counted.agg(F.coalesce(F.sum("count"), F.lit(0)), F.max("count"), F.count_if(F.col("i").isNull())).head()
    if n and (most > 1 or nulls):
        docs = scratch.table(docs.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    else:
        docs = docs.withColumn("rid", own)
    return docs.withColumn("ord", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))), n


def hash_limit(rows: int, n: int) -> int:
    """The largest 64-bit hash that an expected sample of ``rows`` out of n may have: compared with all 64 bits, so that it holds at any n."""
    return (1 << 63) - 1 if rows >= n else max((1 << 64) * rows // n - (1 << 63) - 1, -(1 << 63))


def tidy(run):
    """A function over Arrow batches that gives freed memory back to the system when its task ends: workers live on, and what they hold counts as their
    executor's."""

    def tidied(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return tidied


def pieces_of(batch, column: int, rows: int = 2000, most: int = 4 << 20):
    """Slices of an Arrow batch with at most ``rows`` rows and, but for one long text, ``most`` bytes of text in a column."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, base + most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def others(df: DataFrame, taken: list[str]) -> list[Column]:
    """The columns of df whose names, in any case, are not among those that an operator adds."""
    own = {c.lower() for c in taken}
    return [df[f"`{c}`"] for c in df.columns if c.lower() not in own]


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of a value as text, modulo mod; null stays null."""
    return F.crc32(col.cast("string")) % mod


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, over uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Code points worked on at once: bounds the memory of one step, also for one very long text.
PIECE = 1 << 20


def text_pieces(texts: list[str | None], piece: int = PIECE):
    """Whole texts as code points, in pieces: (codes, starts, rows).

    codes (uint32) begins and ends with a line feed and has one between texts; text k of the piece
    lies at starts[k] + 1 up to the line feed at starts[k + 1]; rows[k] is its number in texts. A text
    longer than a piece comes in parts that are cut at white space where there is any.
    """
    held: list[str] = []
    rows: list[int] = []
    size = 0

    def flush():
        lens = np.fromiter(map(len, held), np.int64, len(held)) + 1
        codes = np.frombuffer(("\n" + "\n".join(held) + "\n").encode("utf-32-le", "surrogatepass"), np.dtype("<u4"))
        return codes, np.concatenate(([0], np.cumsum(lens))), np.array(rows, np.int64)

    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            end = len(text)
            if end - at > piece:
                end = at + piece
                cut = max(text.rfind(" ", at + piece // 2, end), text.rfind("\n", at + piece // 2, end))
                end = cut if cut > at else end
            if held and size + end - at > piece:
                yield flush()
                held, rows, size = [], [], 0
            held.append(text[at:end])
            rows.append(row)
            size += end - at
            at = end
            if at >= len(text):
                break
    if held:
        yield flush()


def ngram_levels(codes: np.ndarray, gap: np.ndarray, most: int):
    """For n = 1..most: (n, hash of the n-gram at each place, whether it lies in one word).

    gap marks separators. An n-gram counts if it has a separator at its ends only, as the mark of a
    word's begin or end, and is not separators alone. Arrays get shorter by one with each n.
    """
    mult = np.uint64(0x9E3779B97F4A7C15)
    c = np.where(gap, np.uint64(1), codes.astype(np.uint64) + np.uint64(2))
    h = c * mult
    yield 1, h, ~gap
    inner = np.ones(len(codes), bool)
    for n in range(2, most + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * mult + c[n - 1 :]
        inner = inner[:-1] & ~gap[n - 2 : -1] if n > 2 else inner[:-1]
        yield n, h, inner if n > 2 else ~(gap[:-1] & gap[1:])
