import random

import numpy as np
import pytest

from gable.llm import decontaminate as dc
from gable.llm import oracle, queries
from oracle_check import connect, difference


def brute(words, items, window=dc.WINDOW):
    """Hit words and items of one document, by comparing every window at every place."""
    hit, found = set(), set()
    for item, text in items:
        for w in dc.windows_of(dc.words_of(text), window):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return hit, sorted(found)


def test_suffix_array_and_search_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(30):
        text = rng.integers(0, 4, rng.integers(1, 60))
        text[-1] = 0
        index = dc.FMIndex(text, 3)
        for length in (1, 2, 3):
            phrase = rng.integers(1, 4, length)
            low, high = index.search(phrase[::-1].reshape(-1, 1))
            at = index.locate(np.arange(low[0], max(low[0], high[0])))
            wanted = [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]
            assert sorted(at.tolist()) == wanted


def test_wavelet_rank():
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, 11, 300)
    tree = dc.WaveletTree(symbols, 4)
    ends = np.arange(301)
    for s in range(12):
        assert (tree.rank(np.full(301, s), ends) == np.r_[0, np.cumsum(symbols == s)]).all()


@pytest.mark.parametrize("shard_words", [7, 1 << 20])
@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_against_brute_force(docs_of, spark, shard_words, block_bytes):
    rng = random.Random(7)
    letters = "abc"
    items = [(str(i), " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 4, 6, 9])))) for i in range(12)]
    texts = [" ".join(rng.choices(letters + "xy", k=rng.choice([0, 1, 5, 30, 90]))) for _ in range(40)]
    docs = docs_of(list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = dc.find_occurrences(docs, bench, window=4, shard_words=shard_words, block_bytes=block_bytes)
    rows = {r["doc_id"]: r for r in found.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        hit, names = brute(text.encode().split(), [(k, t.encode()) for k, t in items], 4)
        r = rows[i]
        assert {k for s in r["spans"] for k in range(s["first"], s["end"])} == hit
        assert r["items"] == names and r["n_words"] == len(text.split())


def test_whole_table_agrees_with_sql(spark, sf):
    assert difference(queries.op4_decontamination(spark, sf), connect(sf), oracle.DECONTAMINATION) is None


def test_edges(docs_of, spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = docs_of([(None, None), (1, ""), (1, ""), (2, f"Start here. {passage.upper()}! And the end"), (3, ".,;"), (4, "só " * 5000 + passage)])
    bench = spark.createDataFrame([(None, passage), (7, None), (8, passage), (9, ""), (8, passage), (10, "so?")], "item_id long, text string")
    found = dc.find_occurrences(docs.withColumnRenamed("source", "Items"), bench)
    assert sorted(found.columns) == sorted(["doc_id", "text", "lang", "n_chars", "n_words", "spans", "items"])
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert [r["items"] for r in rows] == [[], [], [], ["8"], [], ["8"]]
    cut = {r["doc_id"]: r["text"] for r in dc.remove_spans(found).collect()}
    assert cut[None] is None and cut[2] == "Start here. ! And the end" and cut[4] == "só " * 5000
    empty = dc.find_occurrences(docs, bench.limit(0))
    assert empty.count() == 6 and not any(r["items"] or r["spans"] for r in empty.collect())
    assert dc.find_occurrences(docs.limit(0), bench).count() == 0
