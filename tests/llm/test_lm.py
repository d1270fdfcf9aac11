import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.llm import lm, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\0end"]


def plain_base(texts, learn):
    counts = Counter(w for t, ok in zip(texts, learn) if ok for w in plain_tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    value = lambda w: math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1)))
    return [(len(x), sum(counts[w] > 0 for w in x), total, sum(map(value, x))) for x in map(plain_tokens, texts)]


def test_whole_table(spark):
    rows = queries.op3_lm_scores(spark, "/root/testdata/sf0.01").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    ids = [r["doc_id"] for r in rows]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in ids]
    assert sorted(ids) == sorted(docs) and [r["held_out"] for r in rows] == held
    for r, (n, known, total, base) in zip(rows, plain_base([docs[i] for i in ids], [not h for h in held])):
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] <= 0
    out = [r for r, h in zip(rows, held) if h]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than counts on held-out texts


def net(seed=1):
    noise = np.array([0.4, 0.3, 0.2, 0.1])
    return lm.Bilinear(noise, seed)


def test_normalised_and_scored_once_a_context():
    n, rng = net(), np.random.default_rng(2)
    n.p["q"] *= 20
    first, second, word = rng.integers(0, 5, (2, 500)).tolist() + [rng.integers(0, 4, 500).tolist()]
    first, second, word = map(np.array, (first, second, word))
    table = n.log_normalised(first, second)
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-5)
    assert np.allclose(n.score(first, second, word, at_once=3), table[np.arange(500), word], atol=1e-5)


def test_noise_contrastive_estimation_finds_the_law():
    rng, n = np.random.default_rng(3), net()
    second = rng.integers(0, 4, 40_000)
    word = np.where(rng.random(40_000) < 0.8, (second + 1) % 4, rng.choice(4, 40_000, p=n.noise))
    first = np.full(40_000, 4)
    for a in range(0, 40_000, 400):
        n.learn(first[a : a + 400], second[a : a + 400], word[a : a + 400], 0.2, batch=8)
    p = np.exp(n.log_normalised(np.full(4, 4), np.arange(4)))
    assert (p[np.arange(4), (np.arange(4) + 1) % 4] > 0.6).all()


def test_scores_do_not_depend_on_the_partitioning(docs_of, spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_BYTES", 3_000)
    rows = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 4 + i % 60))) for i in range(150)] + [(200, None), (201, "w1 w2"), (201, "w1 w2")]
    found = [
        sorted((r["doc_id"], r["base_score"], r["score"]) for r in lm.score(docs_of(rows, parts), F.col("doc_id") % 5 > 0).collect())
        for parts in (1, 4, 16)
    ]
    for other in found[1:]:
        assert [r[:2] for r in other] == [r[:2] for r in found[0]]
        # Rounding of float32 products, which depends on the size of a block.
        assert [r[2] for r in other] == pytest.approx([r[2] for r in found[0]], rel=1e-6)


def test_known_words_and_unseen_words_of_every_class(docs_of, spark):
    """Words of the learned texts are known, an unseen word of any class is not, and all have a score."""
    words = [f"w{i}" for i in range(40)]
    docs = docs_of([(i, " ".join(words[i : i + 6])) for i in range(36)])
    seen = sorted({w for i in range(36) for w in words[i : i + 6]})
    unseen = {}
    for i in range(10_000):
        unseen.setdefault(lm.class_of(f"x{i}z{i % 97}".encode()), f"x{i}z{i % 97}")
    asked = docs_of([(1000 + i, w) for i, w in enumerate([*seen, *unseen.values(), ""])])
    rows = lm.score(docs.union(asked), F.col("doc_id") < 1000).where("doc_id >= 1000").collect()
    assert len(unseen) == lm.CLASSES
    by = {r["doc_id"] - 1000: r for r in rows}
    assert by[len(seen) + len(unseen)]["n_tokens"] == 1
    assert all(by[i]["n_known"] == 2 for i in range(len(seen))) and all(by[len(seen) + i]["n_known"] == 1 for i in range(len(unseen)))


def test_edges(docs_of, spark):
    pairs = [(None, None), (1, ""), (1, ""), (2, "A a\tA\x0bb"), (3, "é É " * 50_000), (4, "new words")]
    docs = docs_of(pairs).withColumnRenamed("source", "SCORE").withColumnRenamed("lang", "_x")
    rows = lm.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) < 4, block_tokens=5).collect()
    texts = sorted((t or "" for _, t in pairs))
    wanted = Counter(zip(texts, [x[:3] for x in plain_base(texts, [t != "new words" for t in texts])]))
    assert Counter(x[1] for x in wanted.elements()) == Counter((r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows)
    empty = {(r["score"], r["base_score"]) for r in rows if r["n_tokens"] == 1}
    assert len(empty) == 1 and set(rows[0].asDict()) == {"doc_id", "_x", "n_chars", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    assert lm.score(docs.limit(0), F.lit(True)).count() == 0
    none = lm.score(docs, F.lit(False)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in none} == {(0, 0, 0.0)}


def test_words_beyond_the_first_are_told_apart_by_context(docs_of, spark):
    """Two words of one class, as frequent as each other and rarer than 448 others: each gains after its own cue."""
    common = [f"word{i}" for i in range(600)]
    docs = [f"{common[(7 * i + k) % 600]} {common[(11 * i + 5 * k) % 600]}" for i in range(600) for k in range(10)]
    docs += [f"cue{c} {w}{lm.CLASSES}ab" for c, w in (("one", "left"), ("two", "right"))] * 18
    asked = [f"cue{c} {w}{lm.CLASSES}ab" for c in ("one", "two") for w in ("left", "right")]
    rows = docs_of([*enumerate(docs), *[(10_000 + i, t) for i, t in enumerate(asked)]], parts=1)
    a, b, c, d = (r["score"] for r in lm.score(rows, F.col("doc_id") < 10_000).where("doc_id >= 10000").orderBy("doc_id").collect())
    assert a - b > c - d + 0.01


def test_tree_is_normalised():
    words = sorted(((f"w{i}".encode(), 9000 - i) for i in range(3000)), key=lambda x: -x[1])
    by_cell = np.zeros((lm.CLASSES * lm.CELLS, 2), np.int64)
    for w, n in [*words, *[(f"rare{i}".encode(), 2) for i in range(500)]]:
        by_cell[lm.cell_of(w)] += (n, 1)
    m = lm.Model(by_cell, words)
    rng, net = np.random.default_rng(4), m.net
    ids = [m.number[w] for w, _ in words]
    assert len(set(ids) | set(m.others.tolist())) == len(words) + len(by_cell) and m.number[b"rare7"] == m.others[lm.cell_of(b"rare7")]
    assert m.rest.sum(0).tolist() == [1000, 500]
    first, second, word = (rng.choice(ids, 20_000) for _ in range(3))
    net.learn(first, second, word, 0.3)
    symbols = np.arange(lm.CLASSES, net.start)
    for before in (net.start, ids[5], ids[2500]):
        total = np.exp(net.score(np.full(len(symbols), net.start), np.full(len(symbols), before), symbols, at_once=100)).sum()
        assert total == pytest.approx(1, abs=1e-4)


def test_sums_by_place_and_shares_at_places():
    rng = np.random.default_rng(8)
    at, rows = rng.integers(0, 50, 400), rng.normal(size=(400, 5)).astype(np.float32)
    places, of = lm.placed(at, 60)
    assert places.tolist() == sorted(set(at.tolist())) and (places[of] == at).all()
    wanted = np.zeros((60, 5))
    np.add.at(wanted, at, rows)
    assert np.allclose(lm.summed(of, rows.T, len(places)), wanted[places], atol=1e-5)
    none, of = lm.placed(np.zeros(0, np.int64), 0)
    assert lm.summed(of, np.zeros((5, 0)), len(none)).shape == (0, 5)
    s, row = rng.normal(size=(7, 9)), np.array([0, 0, 3, 6])
    p = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert np.allclose(lm.log_softmax(s.copy(), row, np.array([0, 8, 2, 4])), np.log(p[row, [0, 8, 2, 4]]))


def test_heads_are_normalised_by_word_not_by_context(monkeypatch):
    """One row of scores for each context word and place, not for each of the 900 contexts; the sums stay those of a softmax."""
    rng = np.random.default_rng(6)
    n = lm.Bilinear(np.full(40, 1 / 40), 2)
    n.p["q"] *= 10
    first, second = (x.ravel() for x in np.indices((30, 30)))
    word = rng.integers(0, 40, 900)
    wanted = n.log_normalised(first, second)[np.arange(900), word]
    rows, product = [], lm.product
    monkeypatch.setattr(lm, "product", lambda a, b: (rows.append(len(a)), product(a, b))[1])
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 13)
    assert np.allclose(n.score(first, second, word, at_once=7), wanted, atol=1e-5)
    monkeypatch.setattr(lm, "WORDS_AT_ONCE", 1 << 14)
    del rows[:]
    assert np.allclose(n.score(first, second, word), wanted, atol=1e-5)
    assert sum(rows) == 60


def test_contexts_that_favour_unlike_words():
    """Each context word raises a head of its own so far that the products of their parts vanish."""
    n = lm.Bilinear(np.array([0.5, 0.5]), 1)
    n.p["q"] = np.zeros((2, lm.WIDTH), np.float32)
    n.p["q"][[0, 1], [0, 1]] = 1
    n.p["r"][:] = 0
    n.p["r"][0, 0], n.p["r"][1, 1] = 300, 300
    n.p["b"][:] = 0
    first, second = (x.ravel() for x in np.indices((2, 2)))
    found = n.score(first, second, np.zeros(4, np.int64))
    assert np.allclose(found, [0, -np.log(2), -np.log(2), -600], atol=1e-3)


def test_drawn_numbered_and_put_as_one_by_one():
    rng = np.random.default_rng(9)
    sizes = rng.integers(1, 9, lm.CLASSES * lm.CELLS)
    tree = lm.Tree(sizes, rng.zipf(1.5, sizes.sum()).clip(1, 10**6).astype(float))
    node = tree.path(rng.integers(0, tree.leaves, 5_000))
    u = np.random.default_rng(1).random((4, len(node)))
    up = tree.parent[node]
    low, high = tree.first[up], tree.first[up + 1]
    at = tree.sums[low] + u * (tree.sums[high] - tree.sums[low])
    wanted = (np.searchsorted(tree.sums, at, side="right") - 1).clip(low, high - 1).T
    assert (tree.siblings(node, 4, np.random.default_rng(1)) == wanted).mean() > 0.9999  # but for the last bit of a float
    number = lm.Numbers({b"a": 7, lm.END: 9}, list(range(100, 100 + lm.CLASSES * lm.CELLS)))
    words = [b"a", b"rare", b"", b"x", "é".encode(), b"rare"]
    assert number.of(words).tolist() == [number[w] for w in words] and number.of([]).tolist() == []
    key = rng.integers(0, 50, 300)
    for below in (50, 1 << 62):
        order, ordered = lm.in_order(key, below)
        assert (order == np.argsort(key, kind="stable")).all() and (ordered == key[order]).all()
    x, y = np.zeros((6, 3), np.float32), np.zeros(6, np.float32)
    lm.put(x, np.array([4, 1]), np.array([[1, 2, 3], [4, 5, 6]], np.float32))
    lm.put(y, np.array([4, 1]), np.array([1, 2], np.float32))
    assert x[4].tolist() == [1, 2, 3] and x[1].tolist() == [4, 5, 6] and x.sum() == 21 and y.tolist() == [0, 2, 0, 0, 1, 0]
