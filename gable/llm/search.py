"""Ranked lexical search by dense blocked matrix products.

Only terms of the items can score, so every document is reduced once to the item terms
it holds, with their occurrences, and its number of terms. A term's weight and a
document's impact of a term are integers; a score is the sum of their products. Weights
of a tile of items over a tile of terms, and impacts of those terms in a tile of
documents, are made dense float64 matrices. A tile of terms is so small that the
partial sums of the product stay below 2^53, where float64 is exact; tiles are added up
in int64. Each task keeps the best documents of every item, ties at the edge decided by
the id, and Spark ranks what the tasks kept.

Items are taken in blocks of bounded size, each a pass over the documents.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gable.llm.common import LOWER, UPPER, distinct, small_batches, utf8
from gable.session import staged

TOP = 50
#: Rows and columns of the dense tiles.
ITEMS, TERMS, DOCUMENTS = 256, 2_048, 512
#: Bytes of terms in a block of items, about.
BLOCK_BYTES = 1 << 20
#: A weight is less than 1000 * ln(2^64), an impact is less than 10^6.
LARGEST_WEIGHT, LARGEST_IMPACT = 44_400, 10**6
assert TERMS * LARGEST_WEIGHT * LARGEST_IMPACT < 1 << 53
#: Each task thins its candidates when it holds so many.
PENDING = 1 << 18
FIRST_RANKING = 64

_KEPT = b"0123456789" + LOWER.encode() + bytes(range(0x80, 0x100))
TABLE = bytes(c if c in _KEPT else ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, A-Z in lower case."""
    return text.translate(TABLE).split()


def item_terms(benchmark: DataFrame) -> DataFrame:
    """For each row of `benchmark` its number `item`, item_id and its distinct terms, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [sorted(set(terms_of(text))) for text in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(found, pa.list_(pa.binary()))], names=["item", "terms"])

    rows = staged(benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text"), "items")
    found = rows.select("item", "text").mapInArrow(run, "item bigint, terms array<binary>")
    return staged(found.join(rows.select("item", "item_id"), "item"), "item-terms")


class Places(dict):
    """Terms to their places in the vocabulary; other terms are at -1."""

    def __missing__(self, term: bytes) -> int:
        return -1


def counted(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), places and tf of the vocabulary's terms, of texts with a term; written once."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Places((t, i) for i, t in enumerate(sent.value))
        size = max(1, len(place))
        for batch in small_batches(batches, "text"):
            found = [list(map(place.__getitem__, terms_of(text))) for text in utf8(batch.column("text"))]
            n = np.array([len(x) for x in found], np.int64)
            at = np.concatenate([np.array(x, np.int64) for x in found])
            row = np.repeat(np.arange(len(found)), n)
            keys, tf = distinct((row * size + at)[at >= 0])
            ends = np.r_[0, np.cumsum(np.bincount(keys // size, minlength=len(found)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (keys % size, tf)]
            whole = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], names=["doc_id", "n", "places", "tf"])
            yield whole.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(run, "doc_id bigint, n bigint, places array<int>, tf array<int>"), "term-counts")


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column("places").flatten().to_numpy(), minlength=size)
        place = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "df": pa.array(found[place])})

    out = np.zeros(size, np.int64)
    for row in counts.select("places").mapInArrow(run, "place int, df bigint").groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator():
        out[row["place"]] = row["df"]
    return out


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The candidates of each item that may still be among its best."""

    def __init__(self, items: int, top: int):
        self.top, self.held = top, 0
        self.edge = np.zeros(items, np.int64)  # a candidate needs more than 0, or at least the edge
        self.parts: list[tuple] = []

    def add(self, first_item: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        """Scores of a tile (item, document); ids and whether they are null."""
        edge = self.edge[first_item : first_item + len(scores)]
        item, row = np.nonzero((scores > 0) & (scores >= edge[:, None]))
        self.parts.append((item + first_item, scores[item, row], ids[row], none[row]))
        self.held += len(item)
        if self.held > PENDING:
            self.thin()

    def thin(self) -> tuple:
        item, score, ids, none = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((ids, none, -score, item))
        item, score, ids, none = (x[order] for x in (item, score, ids, none))
        start = np.searchsorted(item, item)  # where its item begins
        rank = np.arange(len(item)) - start
        keep = rank < self.top
        last = rank == self.top - 1
        self.edge[item[last]] = score[last]
        self.parts = [tuple(x[keep] for x in (item, score, ids, none))]
        self.held = int(keep.sum())
        return self.parts[0]


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Impact of each occurrence count `tf` in a document of `n` terms, in whole numbers."""
    m = 100 - 50 + (50 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def scored(counts: DataFrame, item_places: list[np.ndarray], weights: np.ndarray, documents: int, length: int, top: int = TOP) -> DataFrame:
    """item (an index), doc_id, score: the best documents of each task for each item."""
    lengths = np.array([len(x) for x in item_places], np.int64)
    flat = np.concatenate([*item_places, np.zeros(0, np.int64)]).astype(np.int64)
    sent = counts.sparkSession.sparkContext.broadcast((lengths, flat, weights.astype(np.float64)))

    def tiles(lengths: np.ndarray, flat: np.ndarray) -> list[tuple]:
        """(first item, items, their terms, entries): each tile of items with a vocabulary of its own."""
        ends, out = np.r_[0, np.cumsum(lengths)], []
        for a in range(0, len(lengths), ITEMS):
            b = min(len(lengths), a + ITEMS)
            own = flat[ends[a] : ends[b]]
            terms = np.unique(own)
            out.append((a, b - a, terms, (np.repeat(np.arange(b - a), lengths[a:b]), np.searchsorted(terms, own))))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, flat, weights = sent.value
        best, item_tiles = Best(len(lengths), top), tiles(lengths, flat)
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(at, DOCUMENTS)
                ids = batch.column("doc_id").fill_null(0).to_numpy()
                none = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
                held = np.diff(np.asarray(batch.column("places").offsets))
                place, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("places", "tf"))
                row = np.repeat(np.arange(batch.num_rows), held)
                value = impacts(tf, np.repeat(batch.column("n").to_numpy(), held), documents, length).astype(np.float64)
                for first, items, terms, (item, column) in item_tiles:
                    scores = np.zeros((items, batch.num_rows), np.int64)
                    mine = np.minimum(np.searchsorted(terms, place), max(0, len(terms) - 1))
                    there = np.flatnonzero(terms[mine] == place) if len(terms) else np.zeros(0, np.int64)
                    for t in range(0, len(terms), TERMS):
                        width = min(TERMS, len(terms) - t)
                        left, right = np.zeros((items, width)), np.zeros((width, batch.num_rows))
                        inside = (column >= t) & (column < t + width)
                        left[item[inside], column[inside] - t] = weights[terms[column[inside]]]
                        here = there[(mine[there] >= t) & (mine[there] < t + width)]
                        right[mine[here] - t, row[here]] = value[here]
                        scores += (left @ right).astype(np.int64)
                    best.add(first, scores, ids, none)
        item, score, ids, none = best.thin()
        for a in range(0, len(item), 1 << 16):
            part = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item[part], pa.int64()), "doc_id": pa.array(ids[part], pa.int64(), mask=none[part].astype(bool)), "score": pa.array(score[part], pa.int64()),
            })

    return counts.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def ranked(found: DataFrame, top: int = TOP) -> DataFrame:
    """The best of each item with `rank` from 1, first among parts of the tasks, then among what these kept."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item", "_part").orderBy(*order)
    few = found.withColumn("_part", F.spark_partition_id() % FIRST_RANKING).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return few.drop("_part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` documents of highest score above 0 for each row of `benchmark`.

    Equal scores go by ascending id, a null id last; repeated documents rank one by one.
    Every row of `benchmark` is an item of its own, whether its id is null or repeated.
    Null texts and texts without a term have no terms: such items find nothing, such
    documents are not found and don't count. Empty tables give no rows. Other columns are
    not looked at; columns of the result have fixed types.
    """
    spark = docs.sparkSession
    items = item_terms(benchmark)
    size = F.aggregate("terms", F.lit(0).cast("bigint"), lambda n, t: n + F.octet_length(t) + 8)
    blocks = max(1, math.ceil((items.agg(F.sum(size)).first()[0] or 0) / block_bytes))
    results = []
    for block in range(blocks):
        rows = items.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)).select("item", "terms").orderBy("item").collect()
        vocabulary = sorted({bytes(t) for r in rows for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        counts = counted(docs, vocabulary, text)
        whole = counts.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        if not rows or not whole["documents"]:
            continue
        df = frequencies(counts, len(vocabulary))
        weights = np.array([weight(whole["documents"], int(x)) for x in df], np.int64)
        places = [np.array([place[bytes(t)] for t in r["terms"]], np.int64) for r in rows]
        found = ranked(scored(counts, places, weights, whole["documents"], whole["length"], top), top)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], "at bigint, number bigint")
        results.append(found.join(names, found["item"] == names["at"]).select(F.col("number").alias("item"), "rank", "doc_id", "score"))
    if not results:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score")).limit(0)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.join(items.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
