"""Vector codes: product quantisation with exact integer distances from float64 matrix products.

Components become integers, vectors are cut into equal parts, and each part position has
a codebook. The nearest entry needs dot products of integers; these are split into limbs
so small that every product and sum of a float64 matrix product stays below 2^53, where
float64 is exact, and put together again in int64. Of equal distances the first entry
counts. A round of fitting sums the parts of each entry inside the tasks; Spark adds the
sums up. Only the codebooks, of a size set by their parameters and the vector length,
reach the driver and go out to the tasks.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm.common import with_groups
from gable.session import staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Rows whose distances to all entries are held at once.
TILE = 2_048
EXACT = 53


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as integers floor(SCALE * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    if (lengths != width).any():
        raise ValueError(f"vectors of {width} and of {int(lengths[lengths != width][0])} components")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() > reach(width):
        raise ValueError(f"a component beyond {reach(width) // SCALE}: its squared distances don't fit a long")
    return scaled.astype(np.int64).reshape(-1, width)


def reach(width: int) -> int:
    """The largest integer component whose squared distances, summed over a vector, surely fit 63 bits."""
    return 1 << ((62 - (max(1, width) - 1).bit_length()) // 2 - 1)


def limb_bits(depth: int) -> int:
    """Bits of a limb such that sums of `depth` products of two limbs stay below 2^53."""
    return (EXACT - 1 - max(0, (depth - 1).bit_length())) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs, lowest first, with values = sum of limb * 2^(bits * place); only the last is signed."""
    out, rest = [], values
    while True:
        if not rest.size or np.abs(rest).max() < 1 << bits:
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits


def exact_products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """one @ other.T for int64 matrices, exact as long as the results fit int64."""
    bits = limb_bits(one.shape[1])
    total = np.zeros((len(one), len(other)), np.int64)
    right = limbs(other, bits)
    for i, a in enumerate(limbs(one, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def nearest(rows: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance, for each row and part.

    `rows` is (row, part, position), `books` is (part, entry, position).
    """
    index, error = np.zeros(rows.shape[:2], np.int64), np.zeros(rows.shape[:2], np.int64)
    for part in range(len(books)):
        book = books[part]
        norms = (book * book).sum(1)
        for a in range(0, len(rows), TILE):
            x = np.ascontiguousarray(rows[a : a + TILE, part])
            far = norms - 2 * exact_products(x, book)
            at = far.argmin(1)
            index[a : a + TILE, part] = at
            error[a : a + TILE, part] = far[np.arange(len(x)), at] + (x * x).sum(1)
    return index, error


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks from the vectors of the smallest ids; ties by the vector, null ids last."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return None
    width = len(first[0]["embedding"])
    if not width or width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    found = integers(pa.array([r["embedding"] for r in first], pa.list_(pa.float64())), width)
    return np.ascontiguousarray(found.reshape(len(first), parts, -1).transpose(1, 0, 2))


def improved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every used entry replaced by the floor of the mean of its parts."""
    parts, entries, depth = books.shape
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent.value
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, depth), np.int64)
        for batch in batches:
            rows = integers(batch.column("embedding"), parts * depth).reshape(-1, parts, depth)
            index, _ = nearest(rows, books)
            for part in range(parts):
                counts[part] += np.bincount(index[:, part], minlength=entries)
                np.add.at(sums[part], index[:, part], rows[:, part])
        part, entry = np.nonzero(counts)
        if len(part):
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(part, pa.int32()),
                "entry": pa.array(entry, pa.int32()),
                "n": pa.array(counts[part, entry], pa.int64()),
                "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64())),
            })

    found = vectors.select("embedding").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    placed = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    books = books.copy()
    for row in placed.groupBy("part", "entry", "place").agg(wide("n"), wide("value")).toLocalIterator():
        books[row["part"], row["entry"], row["place"]] = int(row["value"]) // int(row["n"])
    return books


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) after the given rounds; none for a table without usable vectors.

    `vectors` has vec_id and embedding, usable ones only. With fewer vectors than
    entries the codebooks are smaller.
    """
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books is not None else 0):
        books = improved(vectors, books)
    return books


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all components as decimals, by part, entry and position."""
    flat = [] if books is None else books.reshape(-1).tolist()
    return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


CODED = "vec_id bigint, label int, codes binary, error bigint"


def encoded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (a byte a part) and error, the squared distance to the coded vector."""
    parts, entries, depth = books.shape
    if entries > 256:
        raise ValueError("a code is one byte; use at most 256 entries")
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = integers(batch.column("embedding"), parts * depth).reshape(-1, parts, depth)
            index, error = nearest(rows, sent.value)
            codes = pa.array([x.tobytes() for x in index.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), codes, pa.array(error.sum(1), pa.int64())],
                names=["vec_id", "label", "codes", "error"],
            )

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, CODED)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, codes, error, label_error and codebooks_sha256 of every usable row.

    Rows whose embedding is null or holds a null or non-finite component are left out;
    none usable gives no rows. Repeated rows stay and get equal codes; null ids and null
    labels are values like others, labels adding up together. Vectors of unequal length,
    of a length that can't be cut, or with components too large for exact longs raise an
    error. Other columns are not looked at.
    """
    kept = vectors.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("bigint"), F.col("label").cast("int"), "embedding")
    books = train(kept, parts, entries, rounds)
    if books is None:
        none = {"codes": "binary", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
        return kept.select("vec_id", "label", *[F.lit(None).cast(t).alias(c) for c, t in none.items()]).limit(0)
    rows = staged(encoded(kept, books), "codes")
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_size"))
    return with_groups(rows, by_label, "label", "_size", rows.count()).drop("_size").withColumn("codebooks_sha256", F.lit(digest(books)))


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of `encoded` with `vector`, the coded vector as doubles."""
    sent = codes.sparkSession.sparkContext.broadcast(books)
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            vectors = sent.value[np.arange(parts), index].reshape(len(index), -1) / SCALE
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(vectors), pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    return codes.select("vec_id", "label", "codes", "error").mapInArrow(run, f"{CODED}, vector array<double>")
