"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Word counts of all learnable documents come from the buckets of `wordblocks`: each
bucket adds up its distinct words and answers every block. The vocabulary is all words
that occur often enough for the size of the text, and at least the most frequent ones. The
most frequent are told apart at once; all others by a tree of three levels: the class by
how the word ends, a cell of the class by a hash, and the word in the cell, where the
words outside the vocabulary share one leaf. Every node and word has vectors of its own,
also as context. The model predicts the next word's
vector as a sum of the two words before it, each weighted by its place; it is trained
in numpy against noise words (shared by the batch, and drawn among the siblings in the tree),
first on a bounded sample, then over all learnable
documents, in each task on its own part, and the parameters are averaged by tokens.
Scores use the exact normaliser: over the heads, one dot product per distinct context, as the
exponential of a score is a product of a part of each context word; and one matrix product per
group of siblings. A word outside the vocabulary has the probability of its cell's leaf times
its share of the counts there, so all words and one unseen word a cell add up to 1.
"""

import heapq
import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm import wordblocks
from gable.llm.common import bounded_sample, by_value, lowered_words, small_batches, utf8, whole_text
from gable.llm.wordblocks import pack, unpack  # by name: a task function must not refer to the module
from gable.session import staged

#: So many of the most frequent words are told apart without the tree.
VOCABULARY = 448
#: Words are of the vocabulary from this many occurrences in a byte of learnable text, and from `LEAST` on.
SHARE = 2.0**-21
LEAST = 4
CLASSES = 64
#: Each class has so many cells.
CELLS = 64
WIDTH = 24
NOISE = 64
#: Noise words for each word and level of the tree.
NOISE_AMONG = 4
#: What squared gradients of the tree's vectors start from.
RARE = 1e-6
#: At most so many documents are used to train the first parameters.
FIT_ROWS = 1_000
#: Each bucket names its most frequent words as candidates for the vocabulary.
PROPOSED = 64
#: Parameters travel in parts of so many.
#: Learnable text of so many bytes is learned from in one shard, by a hash of the document.
SHARD_BYTES = 16 << 20
PART = 1 << 12
#: Nodes are drawn by a table of so many places.
DRAWN_BY = 1 << 18
#: Parts of so many context words are held at once where heads are normalised.
WORDS_AT_ONCE = 1 << 14
END = b""


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % CLASSES


def cell_of(word: bytes) -> int:
    return class_of(word) * CELLS + (zlib.crc32(word) >> 16) % CELLS


def cells_of(words: list[bytes]) -> np.ndarray:
    """`cell_of` many words."""
    ends, whole = (np.fromiter(map(zlib.crc32, x), np.int64, len(words)) for x in ([w[-2:] for w in words], words))
    return ends % CLASSES * CELLS + (whole >> 16) % CELLS


class Numbers(dict):
    """Numbers of the vocabulary's words; any other word has that of its cell's leaf."""

    def __init__(self, words: dict[bytes, int], others: list[int]):
        super().__init__(words)
        self.others = others

    def __missing__(self, word: bytes) -> int:
        return self.others[cell_of(word)]

    def of(self, words: list[bytes]) -> np.ndarray:
        """The numbers of many words."""
        found = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(found < 0)
        found[rare] = np.array(self.others, np.int64)[cells_of([words[i] for i in rare.tolist()])]
        return found

    def __reduce__(self):
        return Numbers, (dict(self), self.others)


def tokens_of(text: bytes) -> list[bytes]:
    return [*lowered_words(text), END]


def sigmoid(x: np.ndarray) -> np.ndarray:
    y = np.negative(x)
    np.minimum(y, np.float32(80), out=y)
    np.exp(y, out=y)
    y += 1
    return np.reciprocal(y, out=y)


def product(rows: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product, taken over full sixteens of rows, so that a row's result doesn't depend on how many there are."""
    if not len(rows) % 16:
        return rows @ b
    more = np.zeros((-len(rows) % 16, rows.shape[1]), rows.dtype)
    return (np.concatenate([rows, more]) @ b)[: len(rows)]


def placed(at: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, all of them below `total`, and for each entry the number of its place among them."""
    there, number = np.zeros(total, bool), np.empty(total, np.int64)
    there[at] = True
    places = np.flatnonzero(there)
    number[places] = np.arange(len(places))
    return places, number[at]


def in_order(key: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys, equal ones as they come, and the keys in it; keys from 0 on, less than `below`."""
    n = len(key)
    if below * n >= 1 << 63:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key * n + np.arange(n))  # much faster than to sort places
    return both % max(n, 1), both // max(n, 1)


def summed(of: np.ndarray, columns: Iterable[np.ndarray], n: int) -> np.ndarray:
    """Sums of the rows that go to each of `n` places, given as columns; `of` has the number of each row's place."""
    rows = np.ascontiguousarray(np.asarray(columns, np.float32).T)
    out = np.zeros((n, rows.shape[1]), np.float32)
    kind = np.float32 if rows.shape[1] % 2 else np.complex64  # two sums at a time
    rows, sums = rows.view(kind), out.view(kind)
    at = np.arange(sums.size).reshape(sums.shape).take(of, 0)
    np.add.at(sums.reshape(-1), at.reshape(-1), rows.reshape(-1))
    return out


def put(x: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Puts rows at distinct places of `x`, each row as one value, which is faster than by an index."""
    kind = np.dtype((np.void, x[:1].nbytes))
    np.put(x.view(kind), at, np.ascontiguousarray(rows).view(kind))


def log_softmax(s: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities of the scores `s`, a distribution a row, at the places (row, at); `s` is used up."""
    s -= s.max(1, keepdims=True)
    found = s[row, at]
    np.exp(s, out=s)
    return found - np.log(s.sum(1))[row]


class Tree:
    """Nodes below the classes, siblings side by side: first the cells of all classes, then the leaves of all cells."""

    def __init__(self, sizes: np.ndarray, mass: np.ndarray):
        """`sizes` has the leaves of each cell, `mass` the tokens of each leaf."""
        cells = len(sizes)
        mass = np.r_[np.add.reduceat(mass, np.cumsum(sizes) - sizes), mass] if cells else np.zeros(0)
        self.first = np.r_[np.arange(0, cells, CELLS), cells + np.r_[0, np.cumsum(sizes)]].astype(np.int64)
        self.parent = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.sums = np.r_[0.0, np.cumsum(mass)]
        self.share = mass / np.diff(self.sums[self.first])[self.parent]
        self.cells, self.leaves = cells, int(np.sum(sizes))
        self.below, self.among = self.sums[self.first[self.parent]], np.diff(self.sums[self.first])[self.parent]
        # The node at each place of the table; where more than one node falls into a place, most draws still have the first.
        self.places = DRAWN_BY / self.sums[-1] if cells else 0.0
        self.at_place = (np.searchsorted(self.sums, np.arange(DRAWN_BY) / (self.places or 1), side="right") - 1).clip(0, max(0, len(mass) - 1)).astype(np.int32)

    def path(self, leaf: np.ndarray) -> np.ndarray:
        """The cells of the leaves, then the leaves, as nodes."""
        node = leaf + self.cells
        return np.r_[self.parent[node] - self.cells // CELLS, node]

    def siblings(self, node: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
        """`n` nodes drawn among the siblings of each node, itself too, by their shares."""
        up = self.parent.take(node)
        at = rng.random((n, len(node)))
        at *= self.among.take(node)
        at += self.below.take(node)
        found = self.at_place.take((at * self.places).astype(np.int64), mode="clip").astype(np.int64)
        other = np.flatnonzero((self.sums.take(found) > at) | (self.sums.take(found + 1) <= at))
        found.reshape(-1)[other] = np.searchsorted(self.sums, at.reshape(-1)[other], side="right") - 1
        return found.clip(self.first.take(up), self.first.take(up + 1) - 1).T


class Bilinear:
    """Parameters in one dictionary; heads are the classes and the words told apart at once, then come the
    leaves of the tree, and one context more stands before each text."""

    def __init__(self, noise: np.ndarray, seed: int = 3, tree: Tree | None = None):
        rng, v = np.random.default_rng(seed), len(noise)
        self.tree = tree or Tree(np.zeros(0, np.int64), np.zeros(0))
        self.start = v + self.tree.leaves
        cell = self.tree.parent[self.tree.cells :] - self.tree.cells // CELLS
        self.head = np.r_[np.arange(v), cell // CELLS, self.start]
        self.above = np.where(self.head == np.arange(self.start + 1), v, self.head)  # v where there is none
        self.noise, self.sums = noise, np.cumsum(noise)
        self.offset = (np.log(NOISE) + np.log(noise)).astype(np.float32)
        self.offset_among = (np.log(NOISE_AMONG) + np.log(self.tree.share)).astype(np.float32)
        self.p = {
            "r": rng.normal(0, 0.1, (self.start + 1, WIDTH)).astype(np.float32),
            "q": rng.normal(0, 0.1, (v, WIDTH)).astype(np.float32),
            "c": np.ones((2, WIDTH), np.float32),
            "b": np.log(noise).astype(np.float32),
            "t": np.zeros((len(self.tree.share), WIDTH), np.float32),
            "u": np.log(self.tree.share).astype(np.float32),
        }
        self.p["r"][v : self.start] = 0
        self.past = {k: np.full(x.shape, 1e-3, np.float32) for k, x in self.p.items()}
        # Rare words get few and small gradients.
        for x in (self.past["r"][v : self.start], self.past["t"], self.past["u"]):
            x[:] = RARE
        self.rng = rng

    def among(self, expected: np.ndarray, leaf: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, tuple, tuple]:
        """Gradients of noise-contrastive estimation among siblings: of what is expected, of vectors and of biases."""
        node, p, n = self.tree.path(leaf), self.p, len(leaf)
        drawn = self.tree.siblings(node, NOISE_AMONG, self.rng)
        at = np.column_stack([node, drawn])
        t = p["t"].take(at.ravel(), 0).reshape(*at.shape, -1)  # much faster than by an index of two dimensions
        g = sigmoid(np.einsum("ij,ikj->ik", np.concatenate([expected, expected]), t) + (p["u"] - self.offset_among).take(at))
        g[:, 0] -= 1
        g *= np.concatenate([share, share])[:, None]
        d = np.einsum("ik,ikj->ij", g, t)
        places, of = placed(at.ravel(), len(p["u"]))
        rows = np.einsum("lik,ij->likj", g.reshape(2, n, -1), expected, out=t.reshape(2, n, *t.shape[1:])).reshape(g.size, -1)
        return d[:n] + d[n:], (places, summed(of, rows.T, len(places))), (places, np.bincount(of, g.ravel(), len(places)).astype(np.float32))

    def step(self, first: np.ndarray, second: np.ndarray, word: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step of noise-contrastive estimation with noise words shared by the batch; `second` is the nearer context."""
        p, share = self.p, (weight / weight.sum()).astype(np.float32)
        drawn = np.searchsorted(self.sums, self.rng.random(NOISE)).clip(0, len(self.noise) - 1)
        tail = np.flatnonzero(word >= len(self.noise))
        leaf, word = word[tail] - len(self.noise), self.head[word]
        r1, r2, q = self.vectors(first), self.vectors(second), p["q"].take(word, 0)
        expected = r1 * p["c"][0] + r2 * p["c"][1]
        true = np.einsum("ij,ij->i", expected, q) + (p["b"] - self.offset)[word]
        false = expected @ p["q"][drawn].T
        false += (p["b"] - self.offset)[drawn]
        g_true = -share * sigmoid(-true)
        g_false = sigmoid(false)
        g_false *= share[:, None]
        d_expected = g_true[:, None] * q + g_false @ p["q"][drawn]
        heads, of = placed(np.r_[word, drawn], len(p["b"]))
        grads = {
            "q": (heads, summed(of, np.concatenate([g_true[:, None] * expected, g_false.T @ expected]).T, len(heads))),
            "b": (heads, np.bincount(of, np.concatenate([g_true, g_false.sum(0)]), len(heads)).astype(np.float32)),
        }
        if len(tail):
            d, grads["t"], grads["u"] = self.among(expected[tail], leaf, share[tail])
            d_expected[tail] += d
        at = np.r_[first, second]
        above = self.above.take(at)
        up = np.flatnonzero(above < len(self.noise))
        words, of = placed(np.concatenate([at, above[up]]), self.start + 1)
        rows, n = np.empty((len(of), WIDTH), np.float32), len(at)
        np.multiply(d_expected, p["c"][:, None], out=rows[:n].reshape(2, -1, WIDTH))
        rows[:n].take(up, 0, out=rows[n:], mode="clip")
        grads["r"] = (words, summed(of, rows.T, len(words)))
        grads["c"] = (np.arange(2), np.stack([np.einsum("ij,ij->j", d_expected, r1), np.einsum("ij,ij->j", d_expected, r2)]))
        for k, (at, g) in grads.items():
            past = self.past[k].take(at, 0)
            past += g * g
            put(self.past[k], at, past)
            g *= np.float32(rate)
            g /= np.sqrt(past, out=past)
            put(p[k], at, p[k].take(at, 0) - g)

    def learn(self, first: np.ndarray, second: np.ndarray, word: np.ndarray, rate: float, batch: int = 4096) -> None:
        """Steps over distinct trigrams, weighted by how often they occur."""
        v = self.start + 1
        key = np.sort((first * v + second) * v + word)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        weight = np.diff(np.r_[new, len(key)]).astype(np.float32)
        key = key[new]
        order = self.rng.permutation(len(key))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            k = key[pick]
            self.step(k // (v * v), k // v % v, k % v, weight[pick], rate)

    def vectors(self, at: np.ndarray) -> np.ndarray:
        """Vectors of contexts; a word of the tree has its class's and its own."""
        heads = np.concatenate([self.p["r"][: len(self.noise)], np.zeros((1, WIDTH), np.float32)])
        out = self.p["r"].take(at, 0)
        out += heads.take(self.above.take(at), 0)
        return out

    def expected(self, first: np.ndarray, second: np.ndarray, r: np.ndarray) -> np.ndarray:
        return r.take(first, 0) * self.p["c"][0] + r.take(second, 0) * self.p["c"][1]

    def heads(self, first: np.ndarray, second: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Scores of all heads after each pair of contexts; `r` are the vectors of all contexts."""
        s = product(self.expected(first, second, r), self.p["q"].T)
        s += self.p["b"]
        return s

    def log_normalised(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Log probabilities of all heads after each pair of contexts."""
        s = self.heads(first, second, self.vectors(np.arange(self.start + 1)))
        row, at = np.indices(s.shape)
        return log_softmax(s, row, at)

    def score(self, first: np.ndarray, second: np.ndarray, word: np.ndarray, at_once: int = 512) -> np.ndarray:
        """Log probability of each word in its context; each distinct context is normalised once."""
        v = self.start + 1
        key = first * v + second
        order, key = in_order(key, v * v)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        r, out = self.vectors(np.arange(v)), np.empty(len(key), np.float32)
        total = self.log_totals(key[new] // v, key[new] % v, r, at_once)
        out[order] = np.repeat(-total, np.diff(np.r_[new, len(key)]))
        for a in range(0, len(out), 1 << 14):
            of = slice(a, a + (1 << 14))
            head = self.head.take(word[of])
            out[of] += np.einsum("ij,ij->i", self.expected(first[of], second[of], r), self.p["q"].take(head, 0)) + self.p["b"].take(head)
        self.add_among(out, first, second, word, r, at_once)
        return out

    def log_totals(self, first: np.ndarray, second: np.ndarray, r: np.ndarray, at_once: int) -> np.ndarray:
        """Logs of the sums over all heads of e to the score, after each of the distinct contexts, which are in order.

        A score is a sum of a part from each context word, so each word's part is raised once.
        """
        p, out = self.p, np.empty(len(first), np.float32)

        def raised(words: np.ndarray, place: np.ndarray, bias: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
            s = product(r.take(words, 0) * place, p["q"].T)
            s += bias
            top = s.max(1)
            s -= top[:, None]
            return np.exp(s, out=s), top

        words, of = placed(second, self.start + 1)
        for low in range(0, len(words), WORDS_AT_ONCE):
            mine = np.flatnonzero((of >= low) & (of < low + WORDS_AT_ONCE)) if len(words) > WORDS_AT_ONCE else np.arange(len(of))
            some = words[low : low + WORDS_AT_ONCE]
            nearer, top = np.empty((len(some), len(p["b"])), np.float32), np.empty(len(some), np.float32)
            for a in range(0, len(some), at_once):
                nearer[a : a + at_once], top[a : a + at_once] = raised(some[a : a + at_once], p["c"][1], p["b"])
            one, at = first[mine], of[mine] - low
            new = np.flatnonzero(np.r_[True, one[1:] != one[:-1]][: len(one)])
            ends = np.r_[new, len(one)]
            for a in range(0, len(new), at_once):
                b = min(a + at_once, len(new))
                other, most = raised(one[new[a:b]], p["c"][0], 0.0)
                number = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                for x in range(ends[a], ends[b], 128):
                    y = min(x + 128, ends[b])
                    n = number[x - ends[a] : y - ends[a]]
                    out[mine[x:y]] = np.vecdot(other.take(n, 0), nearer.take(at[x:y], 0))
                here = mine[ends[a] : ends[b]]
                total = out[here]
                few = np.flatnonzero(total < 1e-20)  # parts so far apart that products were lost
                with np.errstate(divide="ignore"):
                    out[here] = np.log(total) + most[number] + top[at[ends[a] : ends[b]]]
                for x in range(0, len(few), at_once):
                    lost = here[few[x : x + at_once]]
                    s = self.heads(first[lost], second[lost], r)
                    out[lost] = s[:, 0] - log_softmax(s.copy(), np.arange(len(s)), np.zeros(len(s), np.int64))
        return out

    def add_among(self, out: np.ndarray, first: np.ndarray, second: np.ndarray, word: np.ndarray, r: np.ndarray, at_once: int) -> None:
        """Adds the log probabilities in the tree: of the cell in its class and the leaf in its cell; all rows with the same siblings at once."""
        tail = np.flatnonzero(word >= len(self.noise))
        tail = tail[in_order(word[tail], self.start)[0]]
        path = self.tree.path(word[tail] - len(self.noise)).reshape(2, -1)
        for a in range(0, len(tail), 1 << 16):
            rows = tail[a : a + (1 << 16)]
            e, found = self.expected(first[rows], second[rows], r), np.zeros(len(rows), np.float32)
            for node in path[:, a : a + (1 << 16)]:
                up = self.tree.parent[node]
                new = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
                ends = [*new[1:].tolist(), len(up)]
                for x, y, low, high in zip(new.tolist(), ends, self.tree.first[up[new]].tolist(), self.tree.first[up[new] + 1].tolist()):
                    t, u = self.p["t"][low:high].T, self.p["u"][low:high]
                    for i in range(x, y, at_once):
                        j = min(i + at_once, y)
                        s = product(e[i:j], t)
                        s += u
                        found[i:j] += log_softmax(s, np.arange(j - i), node[i:j] - low)
            out[rows] += found


def contexts(words: np.ndarray, sizes: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The two words before each word of consecutive texts; `before` stands before a text."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    second = np.where(place >= 1, np.r_[before, words[:-1]][: len(words)], before)
    first = np.where(place >= 2, np.r_[before, before, words[:-2]][: len(words)], before)
    return first, second


def numbered(texts: list[bytes], number: Numbers) -> tuple[np.ndarray, np.ndarray]:
    words, ends = [], [0]
    for text in texts:
        words += lowered_words(text)
        words.append(END)
        ends.append(len(words))
    return number.of(words), np.diff(ends)


class Model:
    """Counts of the whole corpus, the vocabulary, and the parameters."""

    def __init__(self, by_cell: np.ndarray, words: list[tuple[bytes, int]]):
        """`by_cell` has tokens and distinct words of each cell, `words` the vocabulary with counts, the most frequent first."""
        self.total, self.kinds = (int(x) for x in by_cell.sum(0))
        self.rest = by_cell.copy()
        for w, n in words:
            self.rest[cell_of(w)] -= (n, 1)
        heads, tail = words[:VOCABULARY], sorted((cell_of(w), -n, w) for w, n in words[VOCABULARY:])
        cells = np.array([c for c, _, _ in tail], np.int64)
        sizes = np.bincount(cells, minlength=len(by_cell)) + 1
        # The last leaf of each cell is for all words outside the vocabulary.
        others = np.cumsum(sizes) - 1
        mass = np.zeros(int(sizes.sum()))
        mass[others] = np.maximum(self.rest[:, 0], 1)
        leaf = np.arange(len(tail)) + cells  # one leaf more in each cell before
        mass[leaf] = [-n for _, n, _ in tail]
        of_class = np.add.reduceat(mass, others[::CELLS] + 1 - sizes[::CELLS])
        first = CLASSES + len(heads)
        self.others = others + first
        self.cell = np.full(first + len(mass), -1)
        self.cell[self.others] = np.arange(len(others))
        number = {w: CLASSES + i for i, (w, _) in enumerate(heads)}
        number.update((w, first + i) for i, (_, _, w) in zip(leaf.tolist(), tail))
        self.number = Numbers(number, self.others.tolist())
        shares = np.array([*of_class, *[n for _, n in heads]], float)
        self.net = Bilinear(shares / shares.sum(), tree=Tree(sizes, mass))


def own_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches, none of them empty: each from its own values alone, whatever stands around."""
    values = np.asarray(values)
    return np.add.reduceat(values, np.cumsum(lengths) - lengths, dtype=np.float64) if len(lengths) else np.zeros(0)


def learn_over(docs: DataFrame, model: Model, rate: float) -> dict[str, np.ndarray]:
    """Parameters after every shard has learned from its documents, averaged by tokens.

    `docs` has text, `_shard` and `_order`, which follow from the documents alone, and so
    does the result, however the rows are dealt to tasks.
    """
    sent = by_value(docs.sparkSession, (model.net, model.number))
    schema = "shard bigint, at int, value binary, weight double"

    def run(rows: pa.Table) -> pa.Table:
        start, number = sent()
        net, seen, shard = Bilinear(start.noise, tree=start.tree), 0, rows.column("_shard")[0].as_py()
        net.p = {k: x.copy() for k, x in start.p.items()}
        ordered = rows.sort_by([("_order", "ascending"), ("text", "ascending")]).combine_chunks()
        for batch in small_batches(iter(ordered.to_batches()), "text", 4 << 20):
            words, sizes = numbered(utf8(batch.column("text")), number)
            first, second = contexts(words, sizes, net.start)
            net.learn(first, second, words, rate)
            seen += len(words)
        flat = np.concatenate([net.p[k].ravel() for k in sorted(net.p)])
        parts = [flat[a : a + PART].tobytes() for a in range(0, len(flat), PART)]
        return pa.table({"shard": np.full(len(parts), shard), "at": np.arange(len(parts), dtype=np.int32), "value": pa.array(parts, pa.binary()), "weight": np.full(len(parts), float(seen))})

    def averaged(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")  # sums of floats depend on their order
        weight = rows.column("weight").to_numpy()
        value = sum(np.frombuffer(x.as_py(), np.float32) * w for x, w in zip(rows.column("value"), weight)) / weight.sum()
        return pa.table({"at": rows.column("at")[:1], "value": pa.array([value.astype(np.float32).tobytes()], pa.binary())})

    found = docs.select("text", "_shard", "_order").groupBy("_shard").applyInArrow(run, schema).groupBy("at").applyInArrow(averaged, "at int, value binary")
    rows = sorted(found.collect())  # together as large as the model's parameters
    if not rows:
        return model.net.p
    flat = np.frombuffer(b"".join(r["value"] for r in rows), np.float32)
    out, at = {}, 0
    for k in sorted(model.net.p):
        x = model.net.p[k]
        out[k] = flat[at : at + x.size].reshape(x.shape).copy()
        at += x.size
    return out


def most_frequent(words: list[bytes], totals: np.ndarray, least: int) -> list[tuple[int, bytes]]:
    """Words that occur `least` times or more, and `PROPOSED` words in any case."""
    often = [(-n, w) for n, w in zip(totals.tolist(), words) if n >= least]
    return often if len(often) >= PROPOSED else heapq.nsmallest(PROPOSED, ((-n, w) for n, w in zip(totals.tolist(), words) if n))


def counts_of(blocks: DataFrame, least: int) -> tuple[DataFrame, Model]:
    """Answers for every block, (count, cell or the word itself where it is proposed), and the model's counts."""

    def about(words: list[bytes], totals: np.ndarray) -> list[tuple[int, int | bytes]]:
        proposed = {w for _, w in most_frequent(words, totals, least)}
        return [(n, w if w in proposed else c) for w, n, c in zip(words, totals.tolist(), cells_of(words).tolist())]

    def summary(words: list[bytes], totals: np.ndarray) -> bytes:
        of = cells_of(words)
        sums = np.column_stack([np.bincount(of, totals, CLASSES * CELLS), np.bincount(of, totals > 0, CLASSES * CELLS)])
        return pack((sums, [(w, -n) for n, w in most_frequent(words, totals, least)]))

    answers = staged(wordblocks.answer(blocks, about, summary), "counts")

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                sums, top = unpack(data.as_py())
                n, kinds = sums.astype(np.int64).T.tolist()
                rows = {
                    "cell": pa.array([*range(len(n)), *[None] * len(top)], pa.int32()),
                    "word": pa.array([*[None] * len(n), *[w for w, _ in top]], pa.binary()),
                    "n": pa.array([*n, *[k for _, k in top]], pa.int64()),
                    "kinds": pa.array([*kinds, *[0] * len(top)], pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(rows)

    said = answers.where("bucket = -2").select("data").mapInArrow(unfold, "cell int, word binary, n bigint, kinds bigint")
    by_cell = np.zeros((CLASSES * CELLS, 2), np.int64)
    for r in said.where("word IS NULL").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        by_cell[r["cell"]] = r["n"], r["kinds"]
    proposed = said.where("word IS NOT NULL")
    often = proposed.where(F.col("n") >= least)
    few = often.limit(VOCABULARY).count() < VOCABULARY
    top = (proposed.orderBy(F.desc("n"), "word").limit(VOCABULARY) if few else often).collect()  # bounded by the share
    top = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda x: (-x[1], x[0]))
    return answers.where("bucket >= 0"), Model(by_cell, top)


def score(docs: DataFrame, learnable: Column, text: str = "text", rows: int = FIT_ROWS, block_tokens: int = wordblocks.BLOCK_TOKENS) -> DataFrame:
    """All rows with `n_tokens`, `n_known`, `train_tokens`, `base_score` and `score` in place of the text.

    Tokens are words with A-Z in lower case and one end; null texts are empty and have
    the end alone. The model learns from the rows that are `learnable`; without any,
    counts are 0 and the base score is 0. Logarithms are to the base 10. Equal texts
    score the same, and scores follow from the set of rows, not from how they are dealt to
    tasks, both up to the rounding of float32 products (some 1e-7 a token). Columns of the input called like the new ones are replaced.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]).withColumn(text, whole_text(F.col(text)))
    kept = docs.drop(text)
    marked = docs.withColumn("_learn", learnable)
    blocks = wordblocks.cut(marked, text, lambda column: [tokens_of(t) for t in utf8(column)], "_learn", block_tokens)
    order = F.xxhash64(F.lit(5), F.col(text), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c.lower() == "doc_id"])
    learn = marked.where("_learn").select(F.col(text).alias("text"), order.alias("_order"))
    size = learn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers, model = counts_of(blocks, max(LEAST, math.ceil(size * SHARE)))
    if model.total:
        first = bounded_sample(learn, [F.col("text"), F.col("_order")], rows).withColumn("_shard", F.lit(0).cast("bigint"))
        model.net.p = learn_over(first, model, 0.1)
        shards = math.ceil(size / SHARD_BYTES)
        model.net.p = learn_over(learn.withColumn("_shard", F.pmod(F.xxhash64("_order"), F.lit(shards))), model, 0.05)
    sent = by_value(docs.sparkSession, model)
    names = kept.columns

    def finish(rows: pa.Table, sizes: np.ndarray, flat: np.ndarray, found: list) -> pa.Table:
        m = sent()
        count = np.array([n for n, _ in found], float)
        word = np.array([m.others[w] if isinstance(w, int) else m.number[w] for _, w in found], np.int64)
        base = np.log10((count + 0.1) / (m.total + 0.1 * (m.kinds + 1)))
        cell = m.cell[word]
        n, kinds = m.rest[cell].T
        share = np.where(cell >= 0, np.log10((count + 0.1) / (n + 0.1 * (kinds + 1))), 0.0)
        first, second = contexts(word[flat], sizes, m.net.start)
        own = m.net.score(first, second, word[flat]).astype(float) / np.log(10) + share[flat]
        out = rows.select(names)
        columns = (sizes, own_sums(count[flat] > 0, sizes).astype(np.int64), np.full(len(sizes), m.total), own_sums(base[flat], sizes), own_sums(own, sizes))
        for name, values in zip(new, columns):
            out = out.append_column(name, pa.array(values))
        return out

    more = [F.lit(0).cast("bigint").alias(c) for c in new[:3]] + [F.lit(0.0).alias(c) for c in new[3:]]
    return wordblocks.join_back(blocks, answers, kept.select("*", *more).schema, finish)
