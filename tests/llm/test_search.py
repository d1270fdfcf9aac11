import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from gable.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEM = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])


def terms(text):
    return TERM.findall((text or "").translate(LOWERED))


def wanted(docs, items, top):
    bags = [(doc_id, Counter(terms(text))) for doc_id, text in docs if terms(text)]
    count, length = len(bags), sum(sum(b.values()) for _, b in bags)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            n = sum(bag.values())
            m, score = 100 - 50 + (50 * n * count) // length, 0
            for t in set(terms(text)) & set(bag):
                df = sum(t in b for _, b in bags)
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


WORDS = "the The cat dog über naïve 12 x1 a-b c_d tree Ünder 日本 semi;colon".split()
DOCS = [(i, " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 2 + i % 9))) for i in range(60)] + [
    (100, None), (101, ""), (102, "--- !!"), (103, "cat " * 40_000), (104, "cat"), (104, "cat"), (104, "dog cat"), (None, "cat dog"), (None, "cat dog"), (105, "cat\x00dog"),
]
ITEMS = [("a", "The cat, the dog"), ("b", None), ("c", "..."), ("d", "nowhere"), (None, "tree c_d"), ("e", "cat"), ("e", "dog 日本"), ("f", "cat cat cat")]


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("top, block_bytes", [(5, 1 << 20), (3, 40)])
def test_equals_brute_force(spark, docs_of, top, block_bytes):
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], ITEM)
    df = search.search(docs_of(DOCS), items, top=top, block_bytes=block_bytes)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(df) == wanted(DOCS, ITEMS, top)


def test_small_tiles_and_thinning(spark, docs_of, monkeypatch):
    for name, size in {"ITEMS": 2, "TERMS": 2, "DOCUMENTS": 3, "PENDING": 4, "FIRST_RANKING": 2}.items():
        monkeypatch.setattr(search, name, size)
    items = spark.createDataFrame([(*i, 7) for i in ITEMS], ITEM)
    assert found(search.search(docs_of(DOCS, parts=5), items, top=4)) == wanted(DOCS, ITEMS, 4)


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEM)
    assert search.search(docs_of(DOCS), none).collect() == []
    assert search.search(docs_of([]), spark.createDataFrame([("a", "cat", 1)], ITEM)).collect() == []
    assert search.search(docs_of([(1, " "), (2, None)]), spark.createDataFrame([("a", "cat", 1)], ITEM)).collect() == []


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 6), st.integers(0, 5)), max_size=60), st.integers(1, 4))
@settings(max_examples=40, deadline=None)
def test_best_keeps_ties_by_id(rows, top):
    best = search.Best(4, top)
    for item, score, doc_id in rows:
        scores = np.zeros((4, 1), np.int64)
        scores[item] = score
        best.add(0, scores, np.array([doc_id]), np.array([False]))
        best.thin()
    item, score, ids, _ = best.thin()
    for i in range(4):
        mine = sorted((-s, d) for it, s, d in rows if it == i and s > 0)[:top]
        assert [(-s, d) for s, d in zip(score[item == i].tolist(), ids[item == i].tolist())] == mine


def test_terms():
    text = "Ab_c1 É-x\u3000y Z\x7fq\x00r"
    assert [t.decode() for t in search.terms_of(text.encode())] == terms(text) == ["ab", "c1", "É", "x\u3000y", "z", "q", "r"]
