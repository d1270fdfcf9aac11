import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame

from gable.llm import jaccard, oracle, queries
from oracle_check import connect, difference


def plain_components(pairs):
    """(doc_id, set size, least reachable id) of each row, all pairs of distinct sets compared."""
    sets = []
    for _, text in pairs:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        where[s].append(i)
    parent = list(range(len(pairs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for s, rows in where.items():
        for other, more in where.items():
            common = len(s & other)
            if s and (s is other or 100 * common >= 80 * (len(s) + len(other) - common)):
                for b in {rows[0], *more, *rows}:
                    parent[root(b)] = root(rows[0])
    least = {}
    for i, (doc, _) in enumerate(pairs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(pairs, sets))), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def near_copies(rng, groups=6, copies=14):
    texts = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randint(20, 90))]
        for _ in range(copies):
            text = base[:]
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("block,frequent", [(3, 4_000), (2_000, 0)])
def test_near_copies_by_brute_force(docs_of, block, frequent, monkeypatch):
    """Also with tiny blocks, so that most pairs meet across blocks, and without frequent shingles."""
    rng = random.Random(block)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    if not frequent:
        monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [*near_copies(rng), *[f"{passage} a{i} b{i} c{i} " * 1 + " ".join(f"u{i}x{k}" for k in range(rng.randint(0, 40))) for i in range(30)]]
    pairs = list(enumerate(texts + texts[:5]))
    assert found(jaccard.join(docs_of(pairs))) == plain_components(pairs)


@pytest.mark.parametrize("block", [3, 2_000])
def test_a_pair_is_made_once_however_many_shingles_it_shares(docs_of, block, monkeypatch):
    rng, made, tree_pairs, distinct = random.Random(5), [], jaccard.tree_pairs, DataFrame.distinct

    def watched(members):
        with monkeypatch.context() as m:
            m.setattr(DataFrame, "distinct", lambda self: self)
            pairs = tree_pairs(members)
        made.extend((r["a"], r["b"]) for r in pairs.collect())
        return distinct(pairs)

    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "tree_pairs", watched)
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda docs: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    base = [f"w{i}" for i in range(400)]
    texts = [*near_copies(rng), *(" ".join([*base, *(f"u{k}x{i}" for i in range(90 + k % 3))]) for k in range(12))]
    pairs = list(enumerate(texts))
    assert found(jaccard.join(docs_of(pairs))) == plain_components(pairs)
    assert made and len(made) <= 1.2 * len(set(made))


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    pairs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert found(queries.op7_ngram_jaccard(spark, d)) == plain_components(pairs)


def test_whole_table_agrees_with_sql(spark, sf):
    assert difference(queries.op7_ngram_jaccard(spark, sf), connect(sf), oracle.JACCARD) is None


def test_tree_by_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 17, 300, 700):
        points = rng.poisson(rng.choice([0.5, 3, 9], size=(n, 1)), (n, jaccard.GROUPS)).astype(np.int32)
        points[n // 2 :] = points[: n - n // 2]  # copies, some moved a little
        points[n // 2 :, 0] += 1
        sizes = np.maximum(points.sum(1), 1)
        q, p = jaccard.RTree(points, sizes).search(points, sizes)
        bound = np.minimum(points[:, None], points[None]).sum(2)
        wanted = jaccard.similar(bound, sizes[:, None], sizes[None])
        near = (sizes[:, None] * 80 <= sizes[None] * 100) & (sizes[None] * 80 <= sizes[:, None] * 100)
        assert set(zip(q.tolist(), p.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(wanted & near))))


def test_chain_of_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (101, 100)], "a long, b long")
    rows = jaccard.components(links).collect()
    by = defaultdict(set)
    for r in rows:
        by[r["root"]].add(r["node"])
    assert sorted(map(sorted, by.values())) == [list(range(41)), [100, 101, 102]]


def test_edges(docs_of):
    long = " ".join(f"w{i}" for i in range(60_000))
    pairs = [(None, None), (None, "a b c"), (7, "A b  C"), (7, "A b  C"), (3, "a b\tc"), (9, ""), (9, ""), (None, "x y z q r s"), (4, long), (5, long + " more"), (8, "漢字")]
    docs = docs_of(pairs).withColumnRenamed("source", "node").withColumnRenamed("lang", "Component_id")
    assert found(jaccard.join(docs)) == plain_components(pairs)
    assert jaccard.join(docs.limit(0)).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(((r["doc_id"], r["text"] and r["text"][:12]) for r in kept.collect()), key=str)
    assert ids == sorted([(None, None), (3, "a b\tc"), (9, ""), (None, "x y z q r s"), (4, long[:12]), (8, "漢字")], key=str)


def test_unlike_texts_of_one_id_all_stay(docs_of):
    """Null ids and a repeated id name several components; each keeps one text."""
    pairs = [(None, "one two three four five six"), (None, "far other words than those"), (None, "far other words  THAN those"), (5, "a text of its own here"), (5, "nothing like the other one"), (5, ""), (6, "a text of its own here")]
    kept = jaccard.one_of_each(docs_of(pairs)).collect()
    words = sorted(((r["doc_id"], r["text"].lower().split()) for r in kept), key=str)
    assert words == sorted([(d, pairs[i][1].split()) for i, d in ((0, None), (1, None), (3, 5), (4, 5), (5, 5))], key=str)


def block(n, roots, before):
    """Nodes of one key with equal points, as the R-tree search gets them."""
    node = np.random.default_rng(5).permutation(n).astype(np.int64) * 3 - n
    zeros = np.zeros(n, np.int32)
    point = np.full(jaccard.GROUPS, 2, np.int32).tobytes()
    return pa.table({"key": np.zeros(n, np.int64), "i": zeros, "j": zeros, "own": zeros, "node": node, "root": roots, "n_shingles": np.full(n, 2 * jaccard.GROUPS, np.int64), "point": [point] * n, "before": pa.array([before(x) for x in node.tolist()], pa.list_(pa.int64()))})


def test_block_whose_pairs_all_pass_the_bound_stays_small():
    """As large as blocks get; the pairs met at an earlier key or in one component are not held together."""
    n = jaccard.BLOCK
    for roots, before in ((np.arange(n), lambda x: list(range(x % 2, 16, 2))), (np.zeros(n, np.int64), lambda x: [])):
        rows = block(n, roots, before)
        tracemalloc.start()
        pairs = sum(b.num_rows for b in jaccard.block_pairs(rows))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Nodes of unlike parity share no earlier key.
        odd = sum(x % 2 for x in rows.column("node").to_pylist())
        assert pairs == (odd * (n - odd) if roots.any() else 0)
        assert peak < 100 << 20


def test_pairs_of_a_block_by_brute_force():
    rng = np.random.default_rng(6)
    rows = block(300, rng.integers(0, 40, 300), lambda x: [x % 7] if x % 3 else [])
    node, root, seen = (rows.column(c).to_pylist() for c in ("node", "root", "before"))
    wanted = {(min(node[a], node[b]), max(node[a], node[b])) for a in range(300) for b in range(a) if root[a] != root[b] and not set(seen[a]) & set(seen[b])}
    got = [(x["a"], x["b"]) for batch in jaccard.block_pairs(rows) for x in batch.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == wanted
