"""Small helpers shared by the operators."""

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def whole_text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lowered_words(text: bytes) -> list[bytes]:
    """Runs of characters other than ASCII white space, A-Z in lower case."""
    return text.lower().split()


def by_value(spark: SparkSession, thing: object) -> Callable[[], object]:
    """A function that gives `thing` in a task; its classes go along, so executors need no copy of the package.

    A task unpickles it once.
    """
    sent, held = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), []

    def value() -> object:
        if not held:
            held.append(pickle.loads(sent.value))
        return held[0]

    return value


def small_arrow(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Spark hand rows to Python in batches of this many: of texts, its default holds much memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def releasing(run: Callable) -> Callable:
    """The task function `run`, after which freed memory goes back to the system.

    Python workers stay between tasks; what `run` held is free once it has ended, but the
    allocators keep it.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold about `most` bytes at most; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        if lengths.sum() <= most:
            yield batch
            continue
        part = np.cumsum(lengths) // most
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(part)]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()  # idle workers hold on to little


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges start, start + 1, ... one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.diff(np.r_[first, len(keys)])


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values`; an empty stretch sums to 0."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def bounded_sample(df: DataFrame, key: list[Column], rows: int) -> DataFrame:
    """At most `rows` rows, those first by a hash of `key`; the same ones in every run.

    A threshold on the hash leaves little more than `rows` before they are ordered.
    """
    total = df.count()
    hashed = F.xxhash64(F.lit(11), *key)
    share = min(1.0, (1.2 * rows + 200) / max(1, total))
    few = df if share == 1.0 else df.where(F.shiftright(hashed, 11) < int((share - 0.5) * (1 << 53)))
    return few.orderBy(hashed, *key).limit(rows)


#: Keys with at least one row in so many are hot; there are no more of them than this.
MOST_HOT = 1_000


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, most: int = MOST_HOT) -> DataFrame:
    """`rows` with the columns of the group of their key; a null key is a key like others.

    `groups` has every key of `rows` once, with its number of rows in `size`; `total` is the
    number of rows. Keys with at least total / most rows, at most `most` of them, are sent
    to all tasks; all other rows meet their group in a shuffle, where no key is larger.
    """
    least = max(2, -(-total // most))
    named = groups.withColumnRenamed(key, "_group")
    hot = F.broadcast(named.where(F.col(size) >= least))
    same = F.col(key).eqNullSafe(F.col("_group"))
    large = rows.join(hot, same)
    small = rows.join(hot.select("_group"), same, "left_anti").join(named.where(F.col(size) < least), same)
    return large.unionByName(small).drop("_group")
