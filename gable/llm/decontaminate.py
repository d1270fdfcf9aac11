"""Benchmark decontamination by an FM-index per shard of the documents.

A shard is a stretch of the word sequences of some documents. Words that no
benchmark window holds cannot be part of an occurrence; they end the stretches of
words that the index stores. Over those stretches the shard keeps the
Burrows-Wheeler transform in a wavelet tree. All windows are searched backwards at
once, word by word, through wavelet-tree ranks; occurrences are located by walking
to the next sampled suffix position. Word spans of all shards are merged per document.

Work is one pass over the documents: shards live inside a task, a long document
continues in the next shard with an overlap of a window, and nothing is shuffled.
The benchmark is taken in blocks of bounded size; each block is one pass.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gable.llm.common import by_value, ranges, releasing, small_batches, utf8
from gable.session import staged

WINDOW = 13
SHARD_WORDS = 1 << 20
#: Benchmark texts of so many bytes are searched in one pass; indexed they take some 60 times as much memory.
BLOCK_BYTES = 1 << 20
SAMPLED = 8

#: A-Z to lower case; bytes that are not a letter, a digit or part of a non-ASCII character to blanks.
_FOLDED = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLDED).split()


def windows_of(words: list, window: int = WINDOW) -> list[tuple]:
    """All runs of `window` words; the whole item if it has fewer; nothing without words."""
    if len(words) <= window:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]


class Phrases:
    """The distinct windows of one block of benchmark items, as word numbers from 1."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = {}
        for item, text in items:
            for w in windows_of(words_of(text), window):
                key = tuple(self.number.setdefault(x, len(self.number) + 1) for x in w)
                found.setdefault(key, set()).add(item)
        self.phrases = sorted(found)
        self.items = [sorted(found[p]) for p in self.phrases]
        self.lengths = np.array([len(p) for p in self.phrases], np.int64)
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.longest = int(self.lengths.max()) if len(self.lengths) else 0
        #: backwards[k] holds the k-th word from the end of each phrase, 0 where it has fewer.
        self.backwards = np.zeros((self.longest, len(self.phrases)), np.int64)
        for i, p in enumerate(self.phrases):
            self.backwards[: len(p), i] = p[::-1]


class WaveletTree:
    """Ranks over a sequence of symbols: one bit vector per bit of the symbol, each stably sorted by the bits above."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in range(bits - 1, -1, -1):
            one = (symbols >> b) & 1
            zeros_before = np.r_[0, np.cumsum(1 - one)].astype(np.int32)
            self.levels.append((zeros_before, int(zeros_before[-1])))
            symbols = np.concatenate([symbols[one == 0], symbols[one == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start, end = np.zeros_like(end), end.copy()
        for level, (zeros, total) in enumerate(self.levels):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            start = np.where(one, total + start - zeros[start], zeros[start])
            end = np.where(one, total + end - zeros[end], zeros[end])
        return end - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, by doubling the sorted prefix; zeros in `text` differ by position."""
    n = len(text)
    # Each end mark gets a rank of its own, so that no comparison runs over it.
    ends = np.flatnonzero(text == 0)
    rank = text + len(ends)
    rank[ends] = np.arange(len(ends))
    step = 1
    while True:
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over stretches of words, each closed by a 0."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_array(text)
        bwt = text[order - 1]  # before the first stands the last, an end mark
        self.tree = WaveletTree(bwt, max(1, int(symbols).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=symbols + 1))]
        self.bwt = bwt
        # Sampled are every eighth position and each start of a stretch: no walk crosses an end mark.
        sampled = (order % SAMPLED == 0) | (bwt == 0)
        self.sampled, self.place = sampled, np.where(sampled, order, -1)

    def search(self, backwards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase; empty where low >= high."""
        n = backwards.shape[1]
        low, high = np.zeros(n, np.int64), np.full(n, len(self.bwt), np.int64)
        alive = np.arange(n)
        for words in backwards:
            alive = alive[(words[alive] > 0) & (low[alive] < high[alive])]
            if not len(alive):
                break
            w = words[alive]
            both = self.before[np.r_[w, w]] + self.tree.rank(np.r_[w, w], np.r_[low[alive], high[alive]])
            low[alive], high[alive] = both[: len(w)], both[len(w) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by steps to the left until a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            symbol = self.bwt[at]
            rows[walking] = self.before[symbol] + self.tree.rank(symbol, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.place[rows] + steps


def occurrences(numbers: np.ndarray, first_of_doc: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """Start word and phrase of all occurrences in one shard; `first_of_doc` has the first word of each document."""
    known = numbers > 0
    breaks = np.zeros(len(numbers) + 1, bool)
    breaks[first_of_doc] = True
    # Stretches of known words inside one document, long enough for the shortest window.
    starts = np.flatnonzero(known & (np.r_[True, ~known[:-1]] | breaks[:-1]))
    ends = np.flatnonzero(known & (np.r_[~known[1:], True] | breaks[1:])) + 1
    long = ends - starts >= phrases.shortest
    starts, lengths = starts[long], (ends - starts)[long]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = ranges(starts, lengths + 1)  # one place more for the end mark
    last = np.cumsum(lengths + 1) - 1
    where[last] = 0
    text = numbers[where]
    text[last] = 0
    index = FMIndex(text, len(phrases.number))
    low, high = index.search(phrases.backwards)
    count = np.maximum(high - low, 0)
    hit = np.flatnonzero(count)
    places = index.locate(ranges(low[hit], count[hit]))
    return where[places], np.repeat(hit, count[hit])


def _hits(lists: list[list[bytes]], phrases: Phrases, shard_words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hit words as a mask, phrases found) of each document, shard by shard."""
    masks = [np.zeros(len(words), bool) for words in lists]
    found: list[set[int]] = [set() for _ in lists]
    overlap = max(0, phrases.longest - 1)
    pending: list[tuple[int, int, list]] = []  # document, offset, numbers
    size = 0

    def flush() -> None:
        nonlocal size
        if not pending:
            return
        sizes = np.array([len(p[2]) for p in pending], np.int64)
        offsets = np.cumsum(sizes) - sizes
        at, phrase = occurrences(np.fromiter((x for p in pending for x in p[2]), np.int64, int(sizes.sum())), offsets, phrases)
        part = np.searchsorted(offsets, at, side="right") - 1
        for i in np.unique(part) if len(part) else ():
            doc, offset, _ = pending[i]
            mine = part == i
            begin, of = at[mine] - offsets[i] + offset, phrase[mine]
            masks[doc][ranges(begin, phrases.lengths[of])] = True
            found[doc].update(of.tolist())
        pending.clear()
        size = 0

    get = phrases.number.get
    for doc, words in enumerate(lists):
        begin = 0
        while begin < len(words):
            piece = [get(w, 0) for w in words[begin : begin + max(shard_words - size, 2 * overlap + 1)]]
            pending.append((doc, begin, piece))
            size += len(piece)
            if begin + len(piece) >= len(words):
                begin = len(words)
            else:
                begin += len(piece) - overlap
            if size >= shard_words:
                flush()
    flush()
    return zip(masks, found)


def word_spans(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as (first, end)."""
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about `block_bytes`; items are dealt by a hash, equal ids together."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("body")).where("body IS NOT NULL AND item IS NOT NULL")
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    n = 1 + total // block_bytes
    return [rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == i) for i in range(n)]


def find_occurrences(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """All rows of `docs`, the columns `carry` (all if None), `n_words`, `spans` (runs of hit words, end exclusive) and `items`.

    `items` holds the ids of the benchmark items with a window in the document, sorted
    as strings. Null and empty texts have no words and no hits, and so have items of
    null id or text and an empty benchmark. Repeated rows stay repeated; an id that
    several items share counts once. Columns of `docs` called like the new ones are
    replaced. Texts are searched whole, however long.
    """
    new = ("n_words", "spans", "items")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new])
    carry = docs.columns if carry is None else carry
    more = [
        F.lit(0).cast("bigint").alias("n_words"),
        F.expr("cast(null as array<struct<first:bigint,end:bigint>>)").alias("spans"),
        F.expr("cast(null as array<string>)").alias("items"),
    ]
    span_type = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
    blocks = _blocks(benchmark, block_bytes)
    spark = docs.sparkSession

    def search(phrases_of, carried):
        def run(batches):
            phrases = phrases_of()
            for whole in batches:
                for batch in small_batches(iter([whole]), text, 1 << 20):
                    lists = [words_of(t) for t in utf8(batch.column(text))]
                    earlier = "spans" in batch.schema.names
                    spans, items = [], []
                    results = _hits(lists, phrases, shard_words) if phrases.phrases else ((np.zeros(len(x), bool), set()) for x in lists)
                    for i, (mask, found) in enumerate(results):
                        names = {x for p in found for x in phrases.items[p]}
                        if earlier:
                            for s in batch.column("spans")[i].as_py():
                                mask[s["first"] : s["end"]] = True
                            names.update(batch.column("items")[i].as_py())
                        spans.append([{"first": a, "end": b} for a, b in word_spans(mask)])
                        items.append(sorted(names))
                    columns = [batch.column(c) for c in carried]
                    columns += [pa.array([len(x) for x in lists], pa.int64()), pa.array(spans, span_type), pa.array(items, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names=[*carried, *new])

        return run

    found = docs
    for i, block in enumerate(blocks):
        phrases = by_value(spark, Phrases([(r["item"], r["body"].encode()) for r in block.toLocalIterator()], window))
        last = i + 1 == len(blocks)
        carried = carry if last else docs.columns
        found = found.mapInArrow(releasing(search(phrases, carried)), docs.select(*[F.col(f"`{c}`") for c in carried], *more).schema)
        if not last:
            found = staged(found, "decontaminate")
    return found


def removed(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut the spans of hit words out of the texts and drop `n_words`, `spans` and `items`."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    for batch in batches:
        kept = []
        for body, spans in zip(batch.column(text).cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            if spans:
                at = [m.span() for m in word.finditer(body)]
                pieces, begin = [], 0
                for s in spans:
                    pieces.append(body[begin : at[s["first"]][0]])
                    begin = at[s["end"] - 1][1]
                body = b"".join([*pieces, body[begin:]])
            kept.append(body)
        names = [n for n in batch.schema.names if n not in ("n_words", "spans", "items")]
        columns = [pa.array(kept, pa.binary()).cast(pa.string()) if n == text else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_spans(found: DataFrame, text: str = "text") -> DataFrame:
    """The documents of `find_occurrences` without the benchmark passages; a null text stays null."""
    kept = found.drop("n_words", "spans", "items")
    return found.mapInArrow(releasing(lambda batches: removed(batches, text)), kept.schema)

