"""Byte-level BPE over the distinct words of the corpus.

Texts are split into pre-tokens by the pattern, each distinct piece of a block that
begins with a space once; pre-tokens with their positions stay
in blocks of documents while each block's distinct words go to the bucket of their
hash (`wordblocks`). There every distinct word is encoded once by the merge ranks, its
ids go back to the blocks that hold it, and the blocks put the ids in the place of
each position. Decoding looks ids up in the table of token bytes, whose size is fixed
by the vocabulary.
"""

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm import wordblocks
from gable.llm.common import ranges, whole_text

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: White space as the rank files' library has it, whatever the regular expression module takes it for.
PATTERN = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
#: A space behind other white space.
SPACE_BEHIND = r"[\p{Z}\t-\r\x{85}] "


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pretokens(text: str) -> list[str]:
    return regex.findall(PATTERN, text)


def pieces(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of a column of texts, the piece at each place, and the places of each text.

    No pre-token holds a space behind a character that is not white space, and none looks
    back, so a text is cut before its spaces and each piece split alone. A text with a
    space behind other white space is one piece.
    """
    split = pa.compute.split_pattern(column, " ")
    coded = split.flatten().dictionary_encode()
    words, at, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy()
    starts, places = ends[:-1], np.diff(ends).astype(np.int64)
    # The first piece of a text has no space before it.
    heads, of_head = np.unique(at[starts], return_inverse=True)
    at[starts] = len(words) + of_head
    found = [*[" " + w for w in words], *[words[i] for i in heads]]
    uncut = np.flatnonzero(pa.compute.match_substring_regex(column, SPACE_BEHIND).to_numpy(zero_copy_only=False))
    if len(uncut):
        at[starts[uncut]] = len(found) + np.arange(len(uncut))
        found += column.take(pa.array(uncut)).to_pylist()
        stays = np.ones(len(at), bool)
        stays[ranges(starts[uncut] + 1, places[uncut] - 1)] = False
        at, places[uncut] = at[stays], 1
    used = np.bincount(at, minlength=len(found)) > 0
    return [w for w, u in zip(found, used.tolist()) if u], (np.cumsum(used) - 1)[at], places


def whole_words(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    """Encodes what it is given as one pre-token."""
    return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", block_tokens: int = wordblocks.BLOCK_TOKENS) -> DataFrame:
    """All rows of `docs` with `n_tokens` and `ids` (array) in place of the text.

    Null and empty texts have no ids. Repeated rows stay; columns of the input called
    like the new ones are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_tokens", "ids")]).withColumn(text, whole_text(F.col(text)))
    kept = docs.drop(text)
    schema = kept.select("*", F.lit(0).cast("bigint").alias("n_tokens"), F.expr("cast(null as array<int>)").alias("ids")).schema
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    made: list[tiktoken.Encoding] = []

    split: list = []

    def words_of(piece: str) -> list[bytes]:
        if not split:
            split.append(regex.compile(PATTERN).findall)
        return [w.encode() for w in split[0](piece)]

    def about(words: list[bytes], _: np.ndarray) -> list[list[int]]:
        if not made:
            made.append(whole_words(sent.value))
        return [made[0].encode_ordinary(w.decode()) for w in words]

    def finish(rows: pa.Table, sizes: np.ndarray, flat: np.ndarray, found: list) -> pa.Table:
        n = np.fromiter(map(len, found), np.int64, len(found))
        pool = np.fromiter((i for x in found for i in x), np.int32, int(n.sum()))
        starts = np.cumsum(n) - n
        ids = pool[ranges(starts[flat], n[flat])]
        ends = np.r_[0, np.cumsum(n[flat])][np.r_[0, np.cumsum(sizes)]]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        return rows.append_column("n_tokens", pa.array(np.diff(ends))).append_column("ids", lists)

    blocks = wordblocks.cut(docs, text, block_tokens=block_tokens, written=False, parts_of=pieces, words_of=words_of)
    return wordblocks.join_back(blocks, wordblocks.answer(blocks, about), schema, finish)


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def bodies(lists: pa.ListArray, table: list[bytes]) -> Iterator[tuple[np.ndarray, bytes]]:
    """Ids of each row, as little-endian 32-bit integers, and their bytes."""
    flat, at, of = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy(), table.__getitem__
    for a, b in zip(at[:-1], at[1:]):
        yield flat[a:b], b"".join(map(of, flat[a:b].tolist()))


def decode(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The rows with `decoded`, the bytes of their `ids` one after the other."""
    sent = rows.sparkSession.sparkContext.broadcast(token_table(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = pa.array([body for _, body in bodies(batch.column("ids"), sent.value)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, rows.select("*", F.lit(b"").alias("decoded")).schema)


def digests(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """`ids_sha256` and `decoded_sha256` in place of the ids: of them as integers, and of the bytes they decode to."""
    sent = rows.sparkSession.sparkContext.broadcast(token_table(ranks))
    kept = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(hashlib.sha256(ids).hexdigest(), hashlib.sha256(body).hexdigest()) for ids, body in bodies(batch.column("ids"), sent.value)]
            columns = [pa.array([s[i] for s in sums], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, rows.select(*kept, F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")).schema)
