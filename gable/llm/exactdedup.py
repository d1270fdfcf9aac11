"""Exact deduplication by a minimal perfect hash over the digests seen before.

Texts count as equal when they are the same without ASCII white space; a text is told by
the SHA-256 of what is left. The distinct digests of the history are dealt into shards
by their first bytes. Each shard has a minimal perfect hash: levels of bits, in each of
which a digest that meets no other has its bit, while the rest goes on to the next
level; the rank of its bit is its slot. The slot holds the whole digest and the locator
of the row that stays. A new digest is looked up in its shard, compared with the slot
byte by byte, and joins that group if equal; others are groups of their own.

Rows of one digest are combined before they are shuffled, both for the index and for the
lookup, so a text with very many copies is one row there. Shards are hashed by digest and
their number follows the number of rows, so each stays small.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm.common import whole_text, with_groups
from gable.session import staged

#: So many digests go to one shard, on average, or are looked up in it at a time.
PER_SHARD = 50_000
#: Bits of a level for each digest that is left.
GAMMA = 2
MOST_LEVELS = 64
WHITE = " \t\n\x0b\x0c\r"
WIDTH = 32


# The function: plain numpy over the digests of one shard.


def words_of(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of four 64-bit words."""
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, WIDTH // 8)


def places(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Places in a level; every level mixes two words of the digest in its own way."""
    turned = (words[:, 2] + np.uint64(2 * level + 1) * words[:, 3]) * np.uint64(0x9E3779B97F4A7C15)
    return ((turned ^ (turned >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


def build(words: np.ndarray) -> list[np.ndarray]:
    """The levels, as arrays of booleans, of a minimal perfect hash over distinct digests."""
    levels, left = [], words
    while len(left):
        if len(levels) == MOST_LEVELS:
            raise ValueError("digests that are not distinct have no minimal perfect hash")
        at = places(left, len(levels), 64 * -(-GAMMA * len(left) // 64))
        counts = np.bincount(at, minlength=64 * -(-GAMMA * len(left) // 64))
        levels.append(counts == 1)
        left = left[counts[at] > 1]
    return levels


def slots_of(levels: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """The slot of each digest; a digest that was not indexed gets any slot or -1."""
    found, base = np.full(len(words), -1, np.int64), 0
    left = np.arange(len(words))
    for i, bits in enumerate(levels):
        at = places(words[left], i, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits)
        found[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        left = left[~hit]
    return found


def packed(levels: list[np.ndarray]) -> bytes:
    head = np.array([len(levels), *[len(x) for x in levels]], "<i8").tobytes()
    return head + b"".join(np.packbits(x, bitorder="little").tobytes() for x in levels)


def unpacked(data: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(data, "<i8", 1)[0])
    sizes, at, levels = np.frombuffer(data, "<i8", count, 8), 8 * (count + 1), []
    for size in sizes.tolist():
        levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at), bitorder="little").astype(bool))
        at += size // 8
    return levels


# Tables.


def digested(docs: DataFrame, text: str = "text", history: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """For each row doc_id, digest, n_chars, `row` (its number), `old` and `carried` columns, written once."""
    body = whole_text(F.col(text))
    digest = F.unhex(F.sha2(F.translate(body, WHITE, ""), 256))
    old = F.lit(False) if history is None else F.coalesce(history, F.lit(False))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    rows = docs.select(F.col("doc_id"), digest.alias("digest"), F.length(body).cast("bigint").alias("n_chars"), F.monotonically_increasing_id().alias("row"), old.alias("old"), *kept)
    return staged(rows, "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """digest, size and the locator (n_chars, doc_id, row) of the row that stays, for each distinct digest."""
    rank = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    found = rows.groupBy("digest").agg(F.count("*").alias("size"), F.min(rank).alias("first"))
    return found.select("digest", "size", (-F.col("first.less")).alias("n_chars"), F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))


def number(digest: str, first: int) -> Column:
    """Four bytes of the digest as an integer."""
    return F.conv(F.hex(F.substring(digest, first, 4)), 16, 10).cast("bigint")


GROUP = ("digest", "size", "n_chars", "doc_id", "row")


def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The index: one row a slot, ordered inside its shard; the shard's function is in slot 0."""
    id_type = groups.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        words = words_of(rows.column("digest"))
        levels = build(words)
        at = slots_of(levels, words)
        ordered = rows.take(pa.array(np.argsort(at)))
        function = pa.array([packed(levels), *[None] * (len(at) - 1)], pa.binary())
        return ordered.append_column("slot", pa.array(np.arange(len(at)), pa.int64())).append_column("function", function)

    dealt = groups.select((number("digest", 1) % shards).cast("int").alias("shard"), *GROUP)
    schema = f"shard int, digest binary, size bigint, n_chars bigint, doc_id {id_type}, row bigint, slot bigint, function binary"
    return dealt.groupBy("shard").applyInArrow(run, schema)


def looked_up(groups: DataFrame, index: DataFrame, shards: int, cuts: int = 1) -> DataFrame:
    """All groups of the index and of `groups`, those of equal digests as one, with `known`: in the index.

    The digests asked of a shard are taken in `cuts` parts, each with the shard's slots.
    """
    id_type = groups.schema["doc_id"].dataType.simpleString()

    def run(key, asked: pa.Table, slots: pa.Table) -> pa.Table:
        cut = key[1].as_py()
        slots = slots.sort_by("slot")
        asked, known = asked.select(GROUP), slots.select(GROUP)
        if slots.num_rows:
            words = words_of(asked.column("digest"))
            at = slots_of(unpacked(slots.column("function")[0].as_py()), words)
            own = words_of(known.column("digest"))
            same = (at >= 0) & (own[np.maximum(at, 0)] == words).all(1)
        else:
            at = same = np.zeros(asked.num_rows, bool)
        # Members: the better locator of slot and row stays, the sizes add up.
        group = np.r_[np.arange(slots.num_rows), at[same]].astype(np.int64)
        both = pa.concat_tables([known, asked.filter(pa.array(same))]).append_column("group", pa.array(group))
        order = pc.sort_indices(both, sort_keys=[("group", "ascending"), ("n_chars", "descending"), ("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end")
        best = both.take(order)
        first = np.flatnonzero(np.r_[True, np.diff(best.column("group").to_numpy()) > 0][: best.num_rows])
        size = np.zeros(slots.num_rows, np.int64)
        np.add.at(size, group, both.column("size").to_numpy())
        merged = best.take(pa.array(first)).drop_columns(["group"]).set_column(1, "size", pa.array(size))
        if cuts > 1 and slots.num_rows:
            merged = merged.filter(pa.array((words_of(merged.column("digest"))[:, 0] >> np.uint64(32)) % np.uint64(cuts) == cut))
        alone = asked.filter(pa.array(~same))
        flags = pa.array(np.r_[np.ones(merged.num_rows, bool), np.zeros(alone.num_rows, bool)])
        return pa.concat_tables([merged, alone]).append_column("known", flags)

    # Bytes 5 to 8, lowest first, as the upper half of the first word.
    turned = F.concat(*[F.substring("digest", i, 1) for i in (8, 7, 6, 5)])
    cut = (F.conv(F.hex(turned), 16, 10).cast("bigint") % cuts).cast("int").alias("cut")
    dealt = groups.select((number("digest", 1) % shards).cast("int").alias("shard"), cut, *GROUP)
    sent = index.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1))))
    schema = f"digest binary, size bigint, n_chars bigint, doc_id {id_type}, row bigint, known boolean"
    return dealt.groupBy("shard", "cut").cogroup(sent.groupBy("shard", "cut")).applyInArrow(run, schema)


def classes(docs: DataFrame, history: Column | None = None, text: str = "text", carry: list[str] = (), per_shard: int = PER_SHARD) -> DataFrame:
    """For each row doc_id, keep_id, group_size, kept, known and digest, with `carried` if asked for.

    Of rows with equal texts the one with the most code points stays, then the one with
    the smallest id; a null id comes last, and of rows that are alike in both one stays.
    Rows where `history` holds are indexed first and the others looked up, which changes
    `known` (the digest was in the history) and nothing else. Null texts count as empty,
    and texts of white space only are equal to them. An empty table gives no rows. Of
    other columns only those to carry are looked at.
    """
    rows = digested(docs, text, history, carry)
    counts = {r["old"]: r["count"] for r in rows.groupBy("old").count().collect()}
    before, after = counts.get(True, 0), counts.get(False, 0)
    shards = max(1, math.ceil(before / per_shard))
    cuts = max(1, math.ceil(after / (per_shard * shards)))
    index = staged(build_index(grouped(rows.where("old")), shards), "digest-index")
    found = staged(looked_up(grouped(rows.where("NOT old")), index, shards, cuts), "digest-groups")
    of_group = found.select("digest", F.col("size").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("row").alias("_winner"), "known")
    joined = with_groups(rows, of_group, "digest", "group_size", before + after)
    kept = (F.col("row") == F.col("_winner")).alias("kept")
    return joined.select("doc_id", "keep_id", "group_size", kept, "known", "digest", *[c for c in rows.columns if c == "carried"])


def deduplicated(docs: DataFrame, history: Column | None = None, text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return classes(docs, history, text, carry=docs.columns).where("kept").select("carried.*")
