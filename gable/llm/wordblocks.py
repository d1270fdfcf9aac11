"""Distinct words of blocks of documents, exchanged once per block instead of once per occurrence.

A block is a run of documents inside one task with about `BLOCK_TOKENS` tokens. It
keeps its token sequence as numbers of its own distinct words, and sends each distinct
word, with its count, to the bucket that the word hashes to. A bucket thus sees each
word once per block, however frequent the word is, works out what is asked about each
distinct word, and answers every block. Blocks are named by their content. They are
either written to the shared folder or cut anew from the same rows for the questions
and for the join; if the rows came in another order then, the join fails.

Rows are (block, bucket, data): bucket -1 is the block itself, others are its words in
that bucket in the order of their numbers.
"""

import hashlib
import pickle
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import ranges, releasing, small_batches
from gable.session import staged

BLOCK_TOKENS = 1 << 20
BUCKET_BYTES = 4 << 20
LEAST_BUCKETS = 64
ROW = "block bigint, bucket int, data binary"
_NAMES = ["block", "bucket", "data"]


def pack(value) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, 5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned integers below 2^32 as four byte planes, which compress well for small numbers."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def rows_of(block: int, bucket: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block] * len(bucket), pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=_NAMES)


def cut(
    docs: DataFrame,
    text: str,
    tokens_of: Callable[[pa.Array], list[list[bytes]]] | None = None,
    counted: str | None = None,
    block_tokens: int = BLOCK_TOKENS,
    written: bool = True,
    parts_of: Callable[[pa.Array], tuple[list, np.ndarray, np.ndarray]] | None = None,
    words_of: Callable[[object], list[bytes]] | None = None,
) -> DataFrame:
    """The blocks of `docs`; columns other than `text` travel with the block.

    `tokens_of` turns a column of texts into tokens, and `counted` names a boolean
    column: occurrences in its true rows are counted for each word. Where texts fall into
    parts that repeat and can be split alone, `parts_of` gives a column's distinct parts,
    the part at each place and the places of each text, and `words_of` the tokens of a
    part, which is then split once in a block.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        tokens: list[np.ndarray] = []
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        known: dict[object, int] = {}
        pool, bounds = array("q"), array("q", [0])

        def numbered(column: pa.Array) -> list[np.ndarray]:
            if parts_of is None:
                return [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in tokens_of(column)]
            parts, at, places = parts_of(column)
            for part in parts:
                if part not in known:
                    known[part] = len(known)
                    pool.extend(map(number.__getitem__, words_of(part)))
                    bounds.append(len(pool))
            of = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))[at]
            ends = np.array(bounds, np.int64)
            sizes = np.diff(ends)[of]
            flat = np.array(pool, np.int64)[ranges(ends[of], sizes)]
            return np.split(flat, np.r_[0, np.cumsum(sizes)][np.cumsum(places)[:-1]])

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            sizes = np.array([len(x) for x in tokens], np.int64)
            flat, vocabulary = np.concatenate(tokens), list(number)
            # Frequent words get small numbers.
            order = np.argsort(-np.bincount(flat, minlength=len(vocabulary)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            flat, words = rank[flat], [vocabulary[i] for i in order.tolist()]
            counts = np.zeros(len(words), np.int64)
            if counted:
                mask = np.repeat(table.column(counted).to_numpy(), sizes)
                counts = np.bincount(flat[mask], minlength=len(words))
            bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            stream = sink.getvalue().to_pybytes()
            digest = hashlib.blake2b(stream + sizes.tobytes() + flat.tobytes() + b" ".join(words), digest_size=8)
            block = int.from_bytes(digest.digest(), "little", signed=True)
            yield rows_of(block, [-1], [pack((stream, sizes, planes(flat), planes(bucket)))])
            by = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[by], return_index=True)
            parts = np.split(by, first[1:]) if words else []
            for a in range(0, len(parts), 2000):
                data = [pack(([words[i] for i in p.tolist()], counts[p].astype(np.int32) if counted else None)) for p in parts[a : a + 2000]]
                yield rows_of(block, present[a : a + 2000].tolist(), data)

        for batch in small_batches(batches, text, 4 << 20):
            tokens += numbered(batch.column(text))
            held.append(batch.drop_columns([text]))
            if sum(map(len, tokens)) >= block_tokens:
                yield from flush()
                held, tokens = [], []
                number.clear()
                known.clear()
                del pool[:], bounds[1:]
        if held:
            yield from flush()

    blocks = docs.mapInArrow(releasing(run), ROW)
    return staged(blocks, "words") if written else blocks


def answer(blocks: DataFrame, about: Callable[[list[bytes], np.ndarray], list], summary: Callable[[list[bytes], np.ndarray], bytes] | None = None) -> DataFrame:
    """For each word of each block what `about` says of it, once per distinct word and bucket.

    `about` takes distinct words and their total counts, and returns a list of answers.
    `summary` may add one row for each bucket, with -2 in place of the bucket.
    """

    def run(rows: pa.Table) -> pa.Table:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        totals, asked = np.zeros(0, np.int64), []
        for data in rows.column("data"):
            words, counts = unpack(data.as_py())
            at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            totals = np.pad(totals, (0, len(number) - len(totals)))
            if counts is not None:
                totals[at] += counts  # a block has each word once
            asked.append(at)
        words = list(number)
        answers = about(words, totals)
        block, bucket = rows.column("block").to_pylist(), rows.column("bucket").to_pylist()
        data = [pack([answers[i] for i in at.tolist()]) for at in asked]
        if summary:
            block, bucket, data = [*block, 0], [*bucket, -2], [*data, summary(words, totals)]
        return pa.table([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=_NAMES)

    return blocks.where("bucket >= 0").groupBy("bucket").applyInArrow(run, ROW)


def join_back(blocks: DataFrame, answers: DataFrame, schema, finish: Callable[[pa.Table, np.ndarray, np.ndarray, list], pa.Table]) -> DataFrame:
    """Each block with the answers for its words: `finish` takes the rows that travelled,
    tokens per row, all tokens as numbers, and the answer of each number."""

    def run(rows: pa.Table) -> pa.Table:
        told, bodies, out = {}, [], []
        for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("data")):
            if bucket < 0:
                bodies.append(data.as_py())
            else:
                told[bucket] = data.as_py()
        for body in bodies:
            stream, sizes, flat, bucket = unpack(body)
            bucket = from_planes(bucket)
            found: list = [None] * len(bucket)
            by = np.argsort(bucket, kind="stable")
            present, first = np.unique(bucket[by], return_index=True)
            for b, part in zip(present.tolist(), np.split(by, first[1:])):
                for i, x in zip(part.tolist(), unpack(told[b])):
                    found[i] = x
            out.append(finish(pa.ipc.open_stream(stream).read_all(), sizes, from_planes(flat), found))
        return pa.concat_tables(out)

    return blocks.where("bucket < 0").unionByName(answers).groupBy("block").applyInArrow(run, schema)
