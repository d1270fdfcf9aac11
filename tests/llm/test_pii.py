import random
import re

import numpy as np
import pytest

from gable.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    """The rules as they are stated, one regular expression each."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if max(map(int, m[0].split("."))) <= 255]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def test_base_rules_by_brute_force():
    rng = random.Random(4)
    for alphabet, size in (("a@.b-", 12), ("12.", 24), ("+1 ()-.9", 20), ("04 -", 40), ("a1@.+ é", 30)):
        for _ in range(1500):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, size)))
            assert pii.base_spans(text) == plain_spans(text), text
    assert [k for k, _, _ in pii.base_spans("4111 1111 1111 1111, jo@x.org, 10.0.0.1, +1 (511) 555-6887")] == [0, 1, 2, 3]


def test_long_runs_take_linear_time():
    text = "9" * 300_000 + " " + "a" * 300_000 + " @b +1" + " " * 300_000 + "+1" * 100_000
    assert pii.base_spans(text) == []


def test_gradients():
    t = pii.Tagger(hidden=3, width=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    rng = np.random.default_rng(0)
    codes, tags = rng.integers(0, pii.SYMBOLS, (2, 7)), np.array([[0, 1, 2, 2, 0, 3, 4], [2, 0, 0, 5, 6, 6, 0]])
    grads = t.gradients(codes, tags)[1]
    for k in t.p:
        at = (codes[0, 3], 1) if k == "emb" else tuple(0 for _ in t.p[k].shape)
        kept = t.p[k][at]
        t.p[k][at] = kept + 1e-3
        up = t.gradients(codes, tags)[0]
        t.p[k][at] = kept - 1e-3
        down = t.gradients(codes, tags)[0]
        t.p[k][at] = kept
        assert (up - down) / 2e-3 == pytest.approx(grads[k][at], abs=1e-5)


def test_viterbi_by_brute_force():
    from itertools import product

    t = pii.Tagger(hidden=3, width=3, seed=2)
    codes = np.random.default_rng(1).integers(0, pii.SYMBOLS, (3, 4))
    e, tr = t.emissions(codes)[0], t.transitions()
    for i, found in enumerate(t.decode(codes)):
        value = lambda y: sum(e[s, i, y[s]] for s in range(4)) + sum(tr[y[s - 1], y[s]] for s in range(1, 4))  # noqa: B023, E731
        assert value(found) == pytest.approx(max(map(value, product(range(pii.TAGS), repeat=4))), abs=1e-4)


def test_windows_cover_and_tags_round_trip():
    for a, b in ((0, 5), (10, 106), (3, 500), (0, 97), (0, 144), (0, 145)):
        starts = pii.windows(a, b)
        assert starts[0] == a and starts[-1] + pii.WINDOW >= b
    spans = [(0, 2, 5), (3, 5, 9), (3, 9, 12)]
    assert pii.spans_of(pii.tags_of(spans, 15), 0) == spans


def test_held_out_tags(spark):
    """Texts of odd ids that no text of an even id, from which it learned, equals."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    tagger = pii.train(even, rows=350)
    fresh = odd.where("text rlike '[0-9@]'").join(even.select("text"), "text", "left_anti")
    held = [r["text"] for r in fresh.collect() if int.from_bytes(pii.hash_of(r["text"])[:1]) < 80]
    assert len(held) > 100
    codes, tags = pii.examples(held, 400, seed=5)
    found = tagger.decode(codes)
    assert (found == tags).mean() > 0.97
    assert ((found > 0) & (tags > 0)).sum() > 0.85 * (tags > 0).sum()


def test_query_and_edges(docs_of, spark, sf, table_dir):
    rows = queries.op9_pii(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == 200
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        import hashlib

        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
    odd = docs_of([(None, None), (1, ""), (1, ""), (2, "é jo@x.org é +1 (511) 555-6887"), (3, "a" * 200_000 + " 10.0.0.1")]).withColumnRenamed("source", "SPANS")
    found = pii.find(odd, pii.fit([]))
    assert "SPANS" not in found.columns
    by = {r["doc_id"]: r["text"] for r in pii.redact(found).collect()}
    assert by == {None: None, 1: "", 2: "é <EMAIL> é <PHONE>", 3: "a" * 200_000 + " <IP>"}
    assert found.count() == 5 and pii.find(odd.limit(0), pii.fit([])).count() == 0
    assert queries.op9_pii(spark, table_dir(documents=odd.limit(0))).count() == 0
