import re

import pytest

import corpus_pipeline as cp
from gable.llm import bpe, decontaminate, pii, queries
from test_bpe import library
from test_decontaminate import brute
from test_jaccard import plain_components

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage, each written and read again."""
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = [{r["doc_id"]: r for r in docs.collect()}]
    for name, stage in cp.STAGES:
        df = stage(spark, docs, DIR)
        if name != cp.STAGES[-1][0]:
            assert df.columns == docs.columns
        df.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        rows = docs.collect()
        out.append({r["doc_id"]: r for r in rows})
        assert len(rows) == len(out[-1])
    return out


def test_toxic_documents_go(spark, stages):
    scores = {r["doc_id"]: r["predicted"] for r in queries.op10_toxicity(spark, DIR).collect()}
    assert set(stages[1]) == {i for i, p in scores.items() if not p}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [i for i, toxic in labels.items() if not toxic]
    assert sum(i in stages[1] for i in clean) > 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    pairs = [(i, r["text"]) for i, r in stages[1].items()]
    assert set(stages[2]) == {c for _, _, c in plain_components(pairs)}


def test_contaminated_documents_go_and_passages_are_cut(spark, stages):
    items = [(str(r["item_id"]), r["text"].encode()) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    grams = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t))}
    for i, r in stages[2].items():
        words = decontaminate.words_of(r["text"].encode())
        hit = set()
        for n in {len(g) for g in grams}:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in grams:
                    hit.update(range(k, k + n))
        assert (i in stages[3]) == (not hit or 20 * len(hit) < len(words))
        if i in stages[3]:
            left = [w for k, w in enumerate(words) if k not in hit]
            assert decontaminate.words_of(stages[3][i]["text"].encode()) == left
            assert hit or stages[3][i]["text"] == r["text"]
    assert brute([b"a"], [("1", b"a")]) == ({0}, ["1"])


def test_personal_data_is_replaced(stages):
    assert set(stages[4]) == set(stages[3])
    for i, r in stages[3].items():
        text = stages[4][i]["text"]
        assert not pii.base_spans(text)
        if not re.search("[0-9@]", r["text"]):
            assert text == r["text"]


def test_ids_are_those_of_the_library(stages):
    t = library()
    assert set(stages[5]) == set(stages[4])
    for i, r in stages[5].items():
        assert r["ids"] == t.encode_ordinary(stages[4][i]["text"]) and r["n_tokens"] == len(r["ids"])


def test_stages_take_nulls_repeats_and_clashing_columns(spark, docs_of, sf):
    docs = docs_of([(None, None), (None, ""), (5, "plain words here"), (5, "plain words here"), (6, "x " * 50_000)])
    for old, new in (("source", "Spans"), ("n_chars", "score")):
        docs = docs.withColumn(new, docs[old])
    for name, stage in cp.STAGES[:-1]:
        df = stage(spark, docs, sf)
        assert df.columns == docs.columns, name
        assert {(r["doc_id"], r["text"]) for r in df.collect()} <= {(r["doc_id"], r["text"]) for r in docs.collect()}, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    assert bpe.encode(docs, bpe.read_ranks()).count() == 5
