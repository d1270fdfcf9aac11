import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from gable.llm import queries, sharding


def test_matrix_keeps_both_margins():
    lines = sharding.communication_matrix([5, 0, 17, 40], [10, 30, 0, 22], seed=1)
    assert [sum(x) for x in lines] == [5, 0, 17, 40]
    assert [sum(x) for x in zip(*lines)] == [10, 30, 0, 22]


@pytest.mark.parametrize("good,bad,drawn", [(6, 9, 5), (60, 90, 40), (300, 40, 100)])
def test_hypergeometric_law(good, bad, drawn):
    rng, n = random.Random(3), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(n))
    exact = {k: comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) for k in range(drawn + 1) if drawn - k <= bad and k <= good}
    assert set(seen) <= set(exact)
    assert sum(abs(seen[k] / n - p) for k, p in exact.items()) < 0.05


def test_hypergeometric_beyond_a_billion():
    k = sharding.hypergeometric(random.Random(1), 10**11, 3 * 10**11, 10**10)
    assert abs(k - 2.5 * 10**9) < 10**6


def checked(rows, n, shards=8):
    assert len(rows) == n
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_whole_table(spark, sf):
    df = queries.op8_sharding(spark, sf)
    rows = df.collect()
    checked(rows, 200)
    assert Counter(r["doc_id"] for r in rows) == Counter(range(200))
    assert rows[0]["law"] == "rows" and rows[0]["grown_shard"] is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_many_blocks_and_repeatable(spark):
    df = spark.range(3000).select("id", F.lit("x").alias("slot"), F.lit("y").alias("Shard"))
    one = sharding.shuffle_into_shards(df, [F.col("id")], rows_per_block=50)
    rows = one.collect()
    checked(rows, 3000)
    again = sharding.shuffle_into_shards(df.repartition(7), [F.col("id")], rows_per_block=50).collect()
    assert {(r["id"], r["shard"], r["slot"]) for r in rows} == {(r["id"], r["shard"], r["slot"]) for r in again}
    spread = Counter((r["id"] // 375, r["shard"]) for r in rows)
    assert max(spread.values()) < 90  # ids of one stretch go everywhere


def test_nulls_ties_empty(docs_of, table_dir, spark):
    docs = docs_of([(None, None), (None, "a"), (1, ""), (1, ""), (1, ""), (2, "é" * 10)])
    rows = queries.op8_sharding(spark, table_dir(documents=docs)).collect()
    checked(rows, 6)
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 1, 2, 21]
    assert sharding.shuffle_into_shards(docs.limit(0), [F.col("doc_id")]).count() == 0


def test_whole_documents_are_dealt(spark, sf, monkeypatch):
    """The texts themselves go into the shards."""
    dealt = []
    deal = sharding.shuffle_into_shards
    monkeypatch.setattr(sharding, "shuffle_into_shards", lambda df, *a, **k: dealt.append(deal(df, *a, **k)) or dealt[-1])
    queries.op8_sharding(spark, sf)
    texts = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS text")
    assert dealt[0].select("doc_id", "text").exceptAll(texts).isEmpty() and dealt[0].count() == texts.count()
