import numpy as np
from pyspark.sql import functions as F

from gable.llm import queries, toxicity


def test_label_model_finds_good_and_correlated_voters():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.2).astype(float)
    good = np.where(rng.random(4000) < 0.8, y, 0)
    noise = (rng.random(4000) < 0.1).astype(float)
    votes = np.column_stack([good, good, np.where(rng.random(4000) < 0.6, y, 0), noise])
    labels = np.where(rng.random(4000) < 0.05, 1 - y, y)
    q, weight = toxicity.label_model(votes, labels)
    assert ((q > 0.5) == y).mean() > 0.97  # better than the noisy labels
    assert weight[0] < 0.7 and weight[1] < 0.7 and weight[3] > 0.9


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.toxic).mean() > 0.98
    found, truth = rows[rows.toxic == 1].score, rows[rows.toxic == 0].score
    assert np.mean([(f > truth).mean() + (f == truth).mean() / 2 for f in found]) > 0.93
    assert rows.score.between(0, 1).all()


def test_edges(docs_of, spark):
    texts = ["you utter idiot and moron", "a calm day by the sea"] * 30
    docs = docs_of([(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    odd = docs_of([(None, None), (7, ""), (7, ""), (8, "IDIOT! moron!"), (9, "sea " * 200_000), (10, "  漢字 123")]).withColumn("Score", F.lit("x"))
    scored = toxicity.score(odd, model)
    assert scored.columns.count("score") == 1 and "Score" not in scored.columns
    rows = scored.collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["text"]: r["score"] for r in rows}
    assert by["IDIOT! moron!"] > 0.5 and max(by[""], by[None], by["sea " * 200_000]) < 0.3 and by[""] == by[None]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert max(r["score"] for r in toxicity.score(docs, none).collect()) < 0.01
