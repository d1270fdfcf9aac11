"""Toxicity by weak supervision.

Many voters look at a document: lexicon voters ask whether a stem, or any stem of the
lexicon, occurs, recurs or is dense; pattern voters look at case, marks and masked
words. Stems are taken from a bounded sample of labelled documents, beside a short
fixed list. A generative label model, with the given label as one more noisy voter,
estimates by EM how often each voter fires under either class and how voters
correlate; correlated voters share their weight. A linear classifier is trained on
the posterior labels and scores every document in one pass without a shuffle.
"""

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable.llm.common import releasing, small_batches

#: At most so many labelled documents are used to fit the model, those first by a hash of the id.
FIT_ROWS = 12_000
STEM_VOTERS = 64
LONGEST_STEM = 12
SEEDS = (
    "idiot", "moron", "stupid", "trash", "loser", "scum", "clown", "pathetic", "worthless", "disgusting",
    "dumb", "imbecile", "bastard", "asshole", "bitch", "fuck", "shit", "cunt", "retard", "vermin", "filth",
)
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"\b\w\*{2,}\w?")
_CAPITALS = str.maketrans("", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: When a stem voter fires: at so many occurrences, or at this share of all words.
KINDS = (("count", 1), ("count", 2), ("count", 3), ("share", 0.003), ("share", 0.01))
#: The same over all stems of the lexicon together.
TOTALS = (("count", 1), ("count", 2), ("count", 4), ("count", 8), ("share", 0.002), ("share", 0.005), ("share", 0.01), ("share", 0.03))
PATTERNS = 3


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in range(3, min(len(word), LONGEST_STEM) + 1)] or [word]


class Stems:
    """Counts, per document, the words that begin with each of some stems."""

    def __init__(self, stems: Iterable[str]):
        self.number = {s: i for i, s in enumerate(stems)}
        self.hits: dict[str, tuple[int, ...]] = {}
        self.seen: set[str] = set()

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > 150_000:  # bounded memory; words are simply looked at again
            self.seen, self.hits = set(), {}
        new = words - self.seen
        for w in new:
            found = tuple(self.number[s] for s in stems_of(w) if s in self.number)
            if found:
                self.hits[w] = found
        self.seen |= new

    def count(self, words: list[str]) -> tuple[Counter, int]:
        """Occurrences of each stem, and of words with any stem."""
        found, total = Counter(), 0
        for w in filter(self.hits.__contains__, words):
            total += 1
            found.update(self.hits[w])
        return found, total


def fires(kind: tuple[str, float], count: np.ndarray, words: np.ndarray) -> np.ndarray:
    name, least = kind
    return count >= least if name == "count" else (count > 0) & (count >= least * words)


def patterns(text: str) -> tuple[bool, bool, bool]:
    letters = len(text) or 1
    shouted = len(text) - len(text.translate(_CAPITALS))
    return shouted > 0.3 * letters, text.count("!") > 0.01 * letters, bool("**" in text and _MASKED.search(text))


def choose_stems(texts: list[str], toxic: np.ndarray) -> list[tuple[str, int]]:
    """Stem and kind of the voters that tell the classes apart best."""
    tox, clean = int(toxic.sum()), int((1 - toxic).sum())
    if not tox or not clean:
        return []
    support = Counter()
    for text, y in zip(texts, toxic):
        if y:
            support.update({s for w in set(words_of(text)) for s in stems_of(w)})
    least = max(3, tox // 100)
    # Of stems with the same documents only the longest stands for them.
    longer = {s[:-1]: n for s, n in sorted(support.items(), key=lambda x: x[1]) if n >= least}
    names = sorted(s for s, n in support.items() if n >= least and longer.get(s, 0) < n)
    counter = Stems(names)
    counts = np.zeros((2, len(names), len(KINDS)))
    for text, y in zip(texts, toxic):
        words = words_of(text)
        counter.learn(set(words))
        found, _ = counter.count(words)
        if found:
            at, n = np.array(list(found)), np.array(list(found.values()))
            for k, kind in enumerate(KINDS):
                counts[int(y), at, k] += fires(kind, n, len(words))
    a, b = (counts[1] + 0.5) / (tox + 1), (counts[0] + 0.5) / (clean + 1)
    p = (counts[1] + counts[0] + 1) / (tox + clean + 2)
    z = np.where(a > 2 * b, (a - b) / np.sqrt(p * (1 - p) * (1 / tox + 1 / clean)), 0.0)
    chosen, used = [], Counter()
    for i in np.argsort(-z, axis=None, kind="stable"):
        s, k = divmod(int(i), len(KINDS))
        if z[s, k] < 5 or len(chosen) >= STEM_VOTERS:
            break
        if used[names[s]] < 2:
            used[names[s]] += 1
            chosen.append((names[s], k))
    return chosen


class Voters:
    """Votes and measures of documents; `chosen` are stem voters as (stem, kind)."""

    def __init__(self, chosen: list[tuple[str, int]]):
        self.chosen = chosen
        self.lexicon = sorted({s for s, _ in chosen} | set(SEEDS))
        self.stems = Stems(self.lexicon)
        self.size = len(chosen) + len(TOTALS) + PATTERNS

    def look(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Votes (0 or 1), and the measures log count and share of lexicon words."""
        lists = [words_of(t) for t in texts]
        self.stems.learn(set().union(*lists))
        n = np.array([len(x) for x in lists], float)
        by_stem, total = np.zeros((len(texts), len(self.lexicon))), np.zeros(len(texts))
        for i, words in enumerate(lists):
            found, total[i] = self.stems.count(words)
            for s, c in found.items():
                by_stem[i, s] = c
        column = self.stems.number
        votes = [fires(KINDS[k], by_stem[:, column[s]], n) for s, k in self.chosen]
        votes += [fires(kind, total, n) for kind in TOTALS]
        shape = np.array([patterns(t) for t in texts], bool).reshape(-1, PATTERNS)
        votes = np.column_stack([*votes, shape]).astype(float) if len(texts) else np.zeros((0, self.size))
        return votes, np.column_stack([np.log1p(total), np.minimum(50.0, 1000 * total / np.maximum(n, 20))])


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of class 1 for each document, and the weight of each voter after correlations."""
    n, m = votes.shape
    q = np.where(labels == 1, 0.9, 0.03)
    weight = np.ones(m)
    for _ in range(rounds):
        prior = (q.sum() + 1) / (n + 2)
        high = (votes.T @ q + 0.5) / (q.sum() + 1)
        low = (votes.T @ (1 - q) + 0.5) / ((1 - q).sum() + 1)
        # What the classes don't explain and two voters share is one opinion, not two.
        rest = votes - np.outer(q, high) - np.outer(1 - q, low)
        scale = np.sqrt((rest * rest).sum(0)) + 1e-9
        together = np.clip((rest.T @ rest) / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + together.sum(0))
        given_high, given_low = (labels @ q + 1) / (q.sum() + 2), (labels @ (1 - q) + 1) / ((1 - q).sum() + 2)
        odds = math.log(prior / (1 - prior)) + votes @ (weight * np.log(high / low)) + (1 - votes) @ (weight * np.log((1 - high) / (1 - low)))
        odds += np.where(labels == 1, math.log(given_high / given_low), math.log((1 - given_high) / (1 - given_low)))
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return q, weight


def logistic(x: np.ndarray, q: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear classifier on soft labels, the last for the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, penalty), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (q - p) - keep * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(texts: list[str], toxic: list[int]) -> tuple[list[tuple[str, int]], np.ndarray]:
    """Stem voters, and the weights of votes, measures and constant."""
    labels = np.array(toxic, float)
    chosen = choose_stems(texts, labels)
    voters = Voters(chosen)
    if not len(labels):
        return chosen, np.r_[np.zeros(voters.size + 2), -30.0]
    looks = [voters.look(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    votes, measures = (np.concatenate(x) for x in zip(*looks))
    q, _ = label_model(votes, labels)
    return chosen, logistic(np.column_stack([votes, measures]), q)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, rows: int = FIT_ROWS) -> tuple[list[tuple[str, int]], np.ndarray]:
    """The model from labelled documents whose id is `learnable` (a condition on `doc_id`).

    An id with several labels is toxic if one of them says so; null ids, labels and
    texts teach nothing. Without labels every document scores about 0.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    known = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("text", "_toxic")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (texts[i], marks[i]))
        model = fit([texts[i] for i in order], [marks[i] for i in order])
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(model)]})

    # The sample is bounded by `rows`; it goes to one task that fits the model.
    found = known.repartition(1).mapInArrow(releasing(learn), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([], [])


def score(docs: DataFrame, model: tuple[list[tuple[str, int]], np.ndarray], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """All rows, the columns `carry` (all if None) and `score`, the probability of class 1 (0 to 1).

    Null texts count as empty; an empty text has no votes and scores low. Equal texts
    score the same. A column `score` of the input is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"])
    carry = docs.columns if carry is None else carry
    schema = docs.select(*[F.col(f"`{c}`") for c in carry], F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, weights = sent.value
        voters = Voters(chosen)
        for batch in small_batches(batches, text):
            votes, measures = voters.look([t or "" for t in batch.column(text).to_pylist()])
            odds = np.column_stack([votes, measures, np.ones(len(votes))]) @ weights
            result = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carry], pa.array(result)], names=[*carry, "score"])

    return docs.mapInArrow(releasing(run), schema)
