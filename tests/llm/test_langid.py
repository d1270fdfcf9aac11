from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gable.llm import langid, queries
from gable.llm.common import fold


def fitted(texts):
    grams = langid.Texts(texts, langid.letters_table()).grams()
    _, row, number = langid.grouped(langid.hashed(grams, langid.ORDER, 0))
    return langid.kneser_ney(grams[row], np.bincount(number).astype(float))


def plain_kneser_ney(texts):
    """The same probabilities by dictionaries of strings."""
    padded = [" " * 4 + t for t in texts]
    counts = {5: Counter(t[i - 4 : i + 1] for t in padded for i in range(4, len(t)))}
    for m in (4, 3, 2, 1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])

    def p(gram):
        m = len(gram)
        if m == 0:
            return 1 / langid.ALPHABET
        c = counts[m]
        n = Counter(c.values())
        d = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        own = [v for g, v in c.items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        return max(c[gram] - d, 0) / sum(own) + d * len(own) / sum(own) * p(gram[1:])

    return p


def test_probabilities_by_brute_force():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abcd"), size=50)) for _ in range(8)]
    model, p = fitted(texts), plain_kneser_ney(texts)
    for _ in range(60):
        gram = "".join(rng.choice(list("abcdz "), size=5))
        found = langid.log_probabilities(model, np.array([[ord(c) for c in gram]]))[0]
        assert np.exp(found) == pytest.approx(p(gram), rel=1e-4), gram


def test_texts_are_padded_and_folded():
    t = langid.Texts(["Ab, c!", "", "  é  X", "12 3", "a𝒳b"], langid.letters_table())
    assert "".join(map(chr, t.padded)) == "    ab c " + "    " + "    é x" + "    " + "    a𝒳b"
    assert t.lettered.tolist() == [True, False, True, False, True]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = queries.op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    rows = found.select("doc_id", "held_out", "lang", "lang_pred", "score", (fold(F.col("doc_id"), 3) == 1).alias("h")).collect()
    assert len(rows) == 1000 and all(r["held_out"] == r["h"] and 0 <= r["score"] <= 1 for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["held_out"]].append(r["lang"] == r["lang_pred"])
    assert np.mean(by[True]) > 0.97 and len(by[True]) > 250


def test_edges(docs_of, spark):
    learn = [(i, t, lang) for i in range(40) for t, lang in ((f"the old house by the sea {i}", "en"), (f"das alte haus am meer {i}", "de"))]
    model = langid.train(docs_of([*learn, (1, None, "fr"), (2, "texte", None)]), F.lit(True))
    assert model.languages == ["de", "en"]
    odd = docs_of([(None, None), (1, ""), (2, "123 !?"), (3, "the house"), (3, "the house"), (4, "the sea " * 50_000), (5, "漢字漢字")])
    found = langid.identify(odd.withColumnRenamed("source", "Lang_Pred").withColumnRenamed("n_chars", "SCORE"), model)
    assert found.columns == ["doc_id", "text", "lang", "lang_pred", "score", "cross_entropy", "accepted"]
    rows = {(r["doc_id"], r["lang_pred"], r["accepted"]) for r in found.collect()}
    assert {(None, "und", False), (1, "und", False), (2, "und", False), (3, "en", True), (4, "en", True)} <= rows
    assert {r[1] for r in rows if r[0] == 5} <= {"de", "en"} and (5, "en", True) not in rows and (5, "de", True) not in rows
    assert langid.identify(odd.limit(0), model).count() == 0
    none = langid.train(odd.limit(0), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(odd, none).collect()} == {("und", 0.0)}
