"""N-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct runs of `N` words; equal sets are one
node. Shingles are hashed into `GROUPS` groups, and the counts of the groups are the
node's point. The summed minima of two points bound the overlap of the sets from above.

Two sets at the threshold share one of their rarest shingles: with any order of all
shingles, the first floor((1 - t) n) + 1 of both. The order puts shingles that are
frequent in a bounded sample last, so passages that many documents share don't bring
their documents together. The join then runs in two rounds. First each node meets the
smallest and the largest node of every shingle in its prefix (no task holds a whole
shingle: both are combined before they are shuffled). Links found so join nodes into components.
What is left are pairs in different components that share a prefix shingle; the nodes
of such a shingle are indexed in an R-tree and each searches it. A shingle with very
many nodes is cut into blocks, and each pair of blocks is a search of its own. A pair is
made at one of the shingles it shares: each node knows some of its shingles that come
before, and a pair that shares one of these was met there. Pairs
that pass the bound, and then a second one over finer groups, are verified on whole sets. Pairs inside one component can add
nothing to the result and are not made.

Sets, nodes and shingles are told apart by 64-bit hashes.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import lowered_words, releasing, small_batches, utf8, whole_text
from gable.session import discard, staged

N = 5
#: Similarity of at least PART / WHOLE.
PART, WHOLE = 80, 100
GROUPS = 160
#: Groups of the second bound, which is taken before whole sets are compared.
FINE = 2048
#: So many documents, those first by a hash of the text, say which shingles are frequent.
SAMPLE_ROWS = 4_000
FREQUENT = 50_000
#: So many nodes of one shingle are searched in one tree.
BLOCK = 2_000
LEAF = 16
#: So many points are asked for in a tree, and so many bounds are worked out, in one go; any number gives the same pairs.
ASKED, AT_ONCE = 128, 1 << 11
#: Each node of a shingle knows so many of its shingles before that one.
BEFORE = 8
BITMAP_BUCKETS = 256
_TURNS = np.random.default_rng(7).integers(1, 1 << 63, N + 2, dtype=np.uint64) | np.uint64(1)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:  # bounded memory
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def sets_of(texts: list[bytes], hashes: Hashes, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts have one of all their words, empty ones none."""
    out = []
    for text in texts:
        words = lowered_words(text)
        h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        if len(h) < n:
            found = np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))] if len(h) else [], np.uint64)
        else:
            found = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                found = (found ^ h[k : len(h) - n + 1 + k]) * _TURNS[k]
                found ^= found >> np.uint64(31)
            found = np.sort(found)
            found = found[np.r_[True, found[1:] != found[:-1]]]
        out.append(found)
    return out


def point_of(found: np.ndarray) -> np.ndarray:
    return np.bincount((found >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)


def fine_of(found: np.ndarray) -> bytes | None:
    """Counts of `FINE` groups, packed; null where a count doesn't fit a byte."""
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) % FINE, minlength=FINE)
    return zlib.compress(counts.astype(np.uint8).tobytes(), 1) if counts.max() < 256 else None


def node_of(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63)


def signed(found: np.ndarray) -> np.ndarray:
    return found.view(np.int64)


def similar(overlap, one, other):
    """Whether sets of these sizes and this overlap reach the threshold, in whole numbers."""
    return overlap * (PART + WHOLE) >= PART * (one + other)


class RTree:
    """Points bulk-loaded by size and then by the widest coordinates; boxes of `LEAF` children each."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._tiled(points, sizes, np.lexsort((points.argmax(1), sizes)))
        p, s = points[self.order], sizes[self.order]
        self.levels = [(p, s, s)]  # upper corners, least and largest sizes
        while len(self.levels[-1][0]) > 1:
            high, least, largest = self.levels[-1]
            at = np.arange(0, len(high), LEAF)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(largest, at)))

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Slabs of equal size, each sorted along the coordinate in which it is widest, down to leaves."""
        if len(order) <= LEAF * LEAF:
            if len(order) > LEAF:
                widest = np.ptp(points[order], axis=0).argmax()
                order = order[np.argsort(points[order, widest], kind="stable")]
            return order
        slab = -(-len(order) // LEAF)
        return np.concatenate([RTree._tiled(points, sizes, order[a : a + slab]) for a in range(0, len(order), slab)])

    def search(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, point) whose summed coordinate minima allow the threshold."""
        query, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, least, largest = self.levels[depth]
            if depth < len(self.levels) - 1:
                first = node * LEAF
                count = np.minimum(first + LEAF, len(high)) - first
                query = np.repeat(query, count)
                node = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
            near = (least[node] * PART <= sizes[query] * WHOLE) & (largest[node] * WHOLE >= sizes[query] * PART)
            query, node = query[near], node[near]
            keep = np.zeros(len(query), bool)
            for a in range(0, len(query), AT_ONCE):
                q, o = query[a : a + AT_ONCE], node[a : a + AT_ONCE]
                bound = np.minimum(points[q], high[o]).sum(1)
                keep[a : a + AT_ONCE] = similar(bound, sizes[q], least[o])
            query, node = query[keep], node[keep]
        return query, self.order[node]


# Passes over the documents.

LOOKS = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, point binary, prefix array<bigint>"


def frequent_shingles(docs: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of shingles that occur in several texts of a bounded sample."""
    total = docs.count()
    share = min(1.0, (1.2 * rows + 200) / max(1, total))
    picked = docs.where(F.pmod("text_hash", F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["text_hash"]).orderBy("text_hash").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches, "text"):
            found = sets_of(utf8(batch.column("text")), hashes)
            yield pa.RecordBatch.from_pydict({"s": signed(np.concatenate(found))})

    several = picked.select("text").repartition(8).mapInArrow(releasing(run), "s bigint").groupBy("s").count().where("count > 2")
    top = several.orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    top.sort(key=lambda r: r["s"])
    return np.array([r["s"] for r in top], np.int64), np.array([r["count"] for r in top], np.int64)


def look(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """For each document its node, and for a node's first document in a task its point and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        hashes, seen = Hashes(), set()
        for batch in small_batches(batches, "text"):
            nodes, points, prefixes, sizes = [], [], [], []
            for found in sets_of(utf8(batch.column("text")), hashes):
                node = node_of(found) if len(found) else None
                nodes.append(node)
                sizes.append(len(found))
                if node is None or node in seen:
                    points.append(None)
                    prefixes.append(None)
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                s = signed(found)
                at = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
                often = np.where(keys[at] == s, counts[at], 0) if len(keys) else np.zeros(len(s), np.int64)
                length = len(s) - -(-PART * len(s) // WHOLE) + 1
                points.append(point_of(found).tobytes())
                prefixes.append(s[np.lexsort((s, often))[:length]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "node", "point", "prefix"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(releasing(run), LOOKS)


def flagged(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """The rows with `flag`: false only where the long column `key` is surely not among `keys`.

    A bitmap over hashes of the keys, of one size for any input, is sent to all tasks.
    """
    bits = 8 * 4096
    slot = F.pmod(F.xxhash64(F.lit(3), key), F.lit(BITMAP_BUCKETS * bits))
    places = keys.select(slot.alias("_slot")).select(F.floor(F.col("_slot") / bits).alias("_bucket"), (F.col("_slot") % bits).alias("_bit"))
    bitmaps = places.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    place = F.col("_slot") % bits
    byte = F.conv(F.hex(F.substring("_bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    rows = df.withColumn("_slot", slot).withColumn("_bucket", F.floor(F.col("_slot") / bits)).join(F.broadcast(bitmaps), "_bucket", "left")
    return rows.withColumn(flag, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("_slot", "_bucket", "_bitmap")


def sets_for(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, elements) of the nodes given as (node, text_hash); other texts are not shuffled."""
    few = flagged(docs.select("text", "text_hash"), "text_hash", nodes, "_asked").where("_asked")
    texts = few.select("text_hash", "text").join(nodes.select("text_hash").distinct(), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in small_batches(batches, "text"):
            found = sets_of(utf8(batch.column("text")), hashes)
            columns = {
                "node": pa.array([node_of(x) for x in found], pa.int64()),
                "size": pa.array([len(x) for x in found], pa.int64()),
                "fine": pa.array([fine_of(x) for x in found], pa.binary()),
                "elements": pa.array([x.tobytes() for x in found], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return staged(texts.select("text").mapInArrow(releasing(run), "node bigint, size bigint, fine binary, elements binary").dropDuplicates(["node"]), "sets")


# Pairs.


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose points allow the threshold."""
    side = lambda x: points.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("point").alias(f"p{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32).reshape(-1, GROUPS) for c in ("pa", "pb"))
            bound = np.minimum(one, other).sum(1)
            keep = similar(bound, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    near = (F.col("na") * PART <= F.col("nb") * WHOLE) & (F.col("nb") * PART <= F.col("na") * WHOLE)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "na", "nb", "pa", "pb").mapInArrow(releasing(run), "a bigint, b bigint")


def finely_bounded(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that finer groups allow; of a set much less is sent than all its elements."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, m, n in zip(*(batch.column(c).to_pylist() for c in ("fa", "fb", "na", "nb"))):
                if x is None or y is None:
                    keep.append(True)
                    continue
                one, other = (np.frombuffer(zlib.decompress(z), np.uint8) for z in (x, y))
                keep.append(bool(similar(int(np.minimum(one, other).sum(dtype=np.int64)), m, n)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "fa", "fb").mapInArrow(releasing(run), "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(iter([whole]), "sa"):
                keep = []
                for x, y in zip(batch.column("sa"), batch.column("sb")):
                    one, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if len(one) > len(other):
                        one, other = other, one
                    at = np.minimum(np.searchsorted(other, one), len(other) - 1)
                    keep.append(bool(similar(int((other[at] == one).sum()), len(one), len(other))))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(releasing(run), "a bigint, b bigint")


def block_pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (a, b) of one pair of blocks of a shingle, see `tree_pairs`.

    Every pair of two blocks can pass the bound, so points are asked for `ASKED` at a time, and
    only pairs that are new are kept.
    """
    i, j, own = rows.column("i")[0].as_py(), rows.column("j")[0].as_py(), rows.column("own").to_numpy()
    node, root, size = (rows.column(c).to_numpy() for c in ("node", "root", "n_shingles"))
    points = np.frombuffer(b"".join(rows.column("point").to_pylist()), np.int32).reshape(-1, GROUPS)
    index, asking = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(index) or not len(asking):
        return
    before = rows.column("before").combine_chunks()
    lengths = before.value_lengths().to_numpy()
    known = np.arange(BEFORE) < lengths[:, None]
    keys = np.zeros((len(lengths), BEFORE), np.int64)
    keys[known] = before.flatten().to_numpy()
    names, rank = np.unique(node, return_inverse=True)
    tree, pairs = RTree(points[index], size[index]), []
    for at in range(0, len(asking), ASKED):
        ask = asking[at : at + ASKED]
        q, p = tree.search(points[ask], size[ask])
        a, b = ask[q], index[p]
        new = root[a] != root[b]
        a, b = a[new], b[new]
        met = np.zeros(len(a), bool)
        for k in range(BEFORE):
            met |= known[a, k] & ((keys[a, k][:, None] == keys[b]) & known[b]).any(1)
        a, b = rank[a[~met]], rank[b[~met]]
        pairs.append(np.minimum(a, b) * len(names) + np.maximum(a, b))
    once = np.unique(np.concatenate(pairs))
    for at in range(0, len(once), 1 << 16):
        part = once[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pydict({"a": names[part // len(names)], "b": names[part % len(names)]})


def tree_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs in different components among the nodes of each shingle, from R-trees.

    `members` has key, node, root, n_shingles, point and before: the last keys of the node that
    are less than this one. A pair that has one of these in common meets there, so it is not
    made again here; at the least key it shares it is. The nodes of a key are cut into
    blocks of about `BLOCK`; each pair of blocks is searched on its own.
    """
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        members.join(counts, "key")
        .withColumn("own", own)
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), "own", "node", "root", "n_shingles", "point", "before")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                yield from block_pairs(pa.Table.from_batches(held))
                held.clear()

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)]):
                if last != tuple(keys[a]):
                    yield from flush()
                    last = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        yield from flush()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_.mapInArrow(releasing(run), "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), by contraction.

    In each round a node goes to the neighbour, or itself, that comes first in the order
    of a hash, and links are drawn between what nodes went to, until none is left: a
    star is gone after two rounds, a chain loses a share of its nodes in each.
    Each round is written to the shared folder.
    """
    rounds, edges = [], links
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("x"))
        step = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("m")).select(F.col("a").alias("node"), F.col("m.x").alias("parent"))
        step = staged(step, "components")
        rounds.append(step)
        moved = edges.join(step.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a").join(step.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        before = edges
        edges = staged(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        if before is not links:
            discard(before)
        if edges.isEmpty():
            break
    found = rounds[0].select("node", F.col("parent").alias("root"))
    for step in rounds[1:]:
        found = found.join(step.select(F.col("node").alias("root"), "parent"), "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
    roots = staged(found, "roots")
    discard(edges, *rounds)
    return roots


def rooted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `join` and `root`, the node that stands for the component, null for an empty set.

    A component is told by its root: components of null or repeated ids can share a component_id.
    """
    body = whole_text(F.col(text))
    docs = docs.select("doc_id", body.alias("text"), F.xxhash64(body).alias("text_hash"))
    looks = staged(look(docs, frequent_shingles(docs)), "shingles")
    rows = looks.select("node", F.explode("prefix").alias("key"))
    heads = rows.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last")
    members = staged(rows.join(heads, "key").where("node != head"), "members")
    asked = members.select("node").union(members.select("head")).distinct()
    points = looks.where("point IS NOT NULL").select("node", "n_shingles", "point", "text_hash")
    points = staged(points.join(asked, "node", "left_semi").dropDuplicates(["node"]), "points")

    def linked(pairs: DataFrame) -> DataFrame:
        """Verified pairs; only sets of nodes in pairs that passed the bound are fetched. Uses the pairs up."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = sets_for(docs, points.join(nodes, "node", "left_semi").select("node", "text_hash"))
        few = staged(finely_bounded(pairs, sets), "candidates")
        discard(pairs)
        links = staged(verified(few, sets), "links")
        discard(few, sets)
        return links

    ends = members.select(F.explode(F.array("head", "last")).alias("a"), F.col("node").alias("b"))
    stars = ends.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = linked(staged(bounded(stars, points), "candidates"))
    roots = components(links)
    placed = members.select("key", "node").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    listed = placed.join(open_, "key", "left_semi").groupBy("node", "root").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    rest = listed.join(points.drop("text_hash"), "node").select("*", F.posexplode("keys").alias("at", "key"))
    before = F.slice("keys", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    left = staged(tree_pairs(rest.withColumn("before", before).drop("keys", "at")), "candidates")
    discard(members)
    if not left.isEmpty():
        more = linked(left)
        discard(roots)
        roots = components(links.union(more))
        discard(more)
    discard(links, points)
    named = looks.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.select("node", "root").join(least, "root").select("node", "root", "component")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return looks.select("doc_id", "text_hash", "n_shingles", "node").join(of_node, "node", "left").select("doc_id", "text_hash", "n_shingles", own.alias("component_id"), "root")


def join(docs: DataFrame, text: str = "text") -> DataFrame:
    """For each document doc_id, text_hash, n_shingles and component_id, the least id reachable by links.

    Texts without words, null texts among them, have an empty set and no links. Null
    ids are ordinary documents; their component has the least id that is not null, or
    null if there is none. Repeated rows stay and share a component. Other columns are
    not looked at.
    """
    return rooted(docs, text).drop("root")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` without all but one of each component: the least id, then the least text hash.

    Documents with an empty set are components of their own; of repeated rows with the
    same id and text one stays.
    """
    found = staged(rooted(docs, text), "classes")
    bare = F.col("root").isNull()
    chosen = (
        found.groupBy("root", F.when(bare, F.col("doc_id")).alias("own"), F.when(bare, F.col("text_hash")).alias("empty"))
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
        .select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
        .distinct()
        .withColumn("_stays", F.lit(True))
    )
    rows = found.groupBy("doc_id", F.col("text_hash").alias("_text_hash")).agg(F.count("*").alias("_rows"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash"))
    tag = F.xxhash64("doc_id", "_text_hash").alias("_tag")
    doubtful = rows.join(chosen, same, "left").where("_stays IS NULL OR _rows > 1").select(tag)
    names = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.select(*names, F.xxhash64(whole_text(F.col(text))).alias("_text_hash")).select("*", tag)
    marked = flagged(marked, "_tag", staged(doubtful, "doubtful"), "_doubtful")
    # Rows that surely stay are not shuffled.
    kept = marked.where("_doubtful").join(chosen, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return marked.where("NOT _doubtful").select(*names).unionByName(kept.select(*names))
