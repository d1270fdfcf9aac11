import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from gable.llm import codes
from gable.llm.queries import op13_vector_codes

SCHEMA = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("error", T.StringType())]
)


def wanted(rows, parts, entries, rounds):
    """Codes, errors, label errors and codebooks in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    depth = len(kept[0][1]) // parts
    cut = [[v[p * depth : (p + 1) * depth] for p in range(parts)] for _, v, _ in kept]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[nearest(p, v[p])[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, chosen[p]) if c == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    out, by_label = [], defaultdict(int)
    for (i, _, label), v in zip(kept, cut):
        found = [nearest(p, v[p]) for p in range(parts)]
        error = sum(e for e, _ in found)
        by_label[label] += error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, code, error, by_label[label], digest) for i, code, error, label in out), key=str)


def found(df):
    return sorted(((r["vec_id"], bytes(r["codes"]).hex(), r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


def vectors(n, width=32, seed=3, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(0, scale, width)], [None, 1, 2, 1][i % 4]) for i in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(parts)


ODD = [
    (500, None, 1), (501, [None] + [0.0] * 31, 1), (502, [float("nan")] + [0.0] * 31, 2), (503, [float("-inf")] + [0.0] * 31, 2),
    (None, [0.5] * 32, None), (3, [0.25] * 32, 7), (504, [-0.001] * 32, 1), (504, [-0.001] * 32, 1), (505, [1000.0] * 32, 9),
]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, parts):
    rows = vectors(120) + ODD
    assert found(codes.compress(frame(spark, rows, parts), entries=20)) == wanted(rows, 16, 20, 2)


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = vectors(5) + [(i, [0.125] * 32, 1) for i in range(5, 9)]
    assert found(codes.compress(frame(spark, rows))) == wanted(rows, 16, 64, 2)


def test_large_components_need_several_limbs(spark):
    rows = vectors(40, scale=50_000.0)
    assert found(codes.compress(frame(spark, rows), parts=2, entries=6)) == wanted(rows, 2, 6, 2)


def test_no_usable_rows(spark):
    for rows in ([], ODD[:4]):
        df = codes.compress(frame(spark, rows))
        assert df.collect() == [] and df.columns == ["vec_id", "label", "codes", "error", "label_error", "codebooks_sha256"]


def test_unequal_lengths_and_components_too_large_are_errors(spark):
    with pytest.raises(Exception, match="components"):
        codes.compress(frame(spark, vectors(4) + [(9, [1.0] * 16, 1)])).collect()
    with pytest.raises(Exception, match="can't be cut"):
        codes.compress(frame(spark, [(1, [1.0] * 30, 1)])).collect()
    with pytest.raises(Exception, match="don't fit"):
        codes.compress(frame(spark, [*vectors(2), (9, [1e30] * 32, 1)])).collect()


@given(st.integers(1, 9), st.integers(0, 40), st.integers(0, 2**31))
@settings(max_examples=60, deadline=None)
def test_products_are_exact(depth, bits, seed):
    rng = np.random.default_rng(seed)
    top = min(2**bits, 2**29)
    one, other = (rng.integers(-top, top + 1, (7, depth)) for _ in range(2))
    assert (codes.exact_products(one, other) == one @ other.T).all()


def test_codes_lead_back_to_vectors(spark):
    df = frame(spark, vectors(200)).select("vec_id", "label", "embedding")
    books = codes.train(df, entries=64)
    coded = codes.encoded(df, books)
    for row in codes.decoded(coded, books).join(df.select("vec_id", "embedding"), "vec_id").collect():
        off = np.floor(np.array(row["embedding"]) * 256) - np.array(row["vector"]) * 256
        assert int((off * off).sum()) == row["error"]


def test_query_on_fixture(spark, table_dir):
    rows = vectors(90) + ODD
    df = op13_vector_codes(spark, table_dir(embeddings=frame(spark, rows)))
    assert sorted(map(tuple, df.collect()), key=str) == wanted(rows, 16, 64, 2)
