import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gable.llm import exactdedup

BARE = re.compile(r"[\x20\x09-\x0D]")


def wanted(rows):
    """One tuple a row by brute force: keep_id, size, digest; and how many stay under each digest."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[BARE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        bare = BARE.sub("", text or "")
        out.append((doc_id, min(groups[bare])[3], len(groups[bare]), hashlib.sha256(bare.encode()).digest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"])) for r in df.collect()), key=str)


ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb "), (4, None), (5, ""), (6, " \n\x0b"), (7, "A b"), (8, "a b"),
    (9, "é" * 5), (10, "é" * 5), (10, "é" * 5), (None, "ab"), (None, "zz"), (None, "z z"), (11, "x" * 300_000), (12, "x " * 300_000), (13, "ab\x00"),
]


@pytest.mark.parametrize("history", [None, "doc_id % 2 = 0", "doc_id IS NOT NULL", "true"])
def test_groups_equal_brute_force(docs_of, history):
    df = exactdedup.classes(docs_of(ROWS), history and F.expr(history), per_shard=3)
    assert found(df) == wanted(ROWS)
    stays = df.where("kept").groupBy("digest").count().collect()
    assert all(r["count"] == 1 for r in stays) and len(stays) == len({w[3] for w in wanted(ROWS)})


def test_known_tells_the_history(docs_of):
    rows = {r["doc_id"]: r["known"] for r in exactdedup.classes(docs_of([(1, "a"), (2, "a "), (3, "b"), (4, "b"), (5, "c")]), F.col("doc_id") == 1).collect()}
    assert rows == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_more_is_looked_up_than_the_history_holds(docs_of):
    rows = [(i, f"text {i % 40}" + " " * (i % 7)) for i in range(300)]
    assert found(exactdedup.classes(docs_of(rows), F.col("doc_id") < 5, per_shard=6)) == wanted(rows)


def test_large_group(docs_of):
    rows = [(i, "copy" if i % 3 else f"own {i}") for i in range(3_000)]
    assert found(exactdedup.classes(docs_of(rows), F.col("doc_id") % 2 == 0, per_shard=100)) == wanted(rows)


def test_empty_table(docs_of):
    assert exactdedup.classes(docs_of([])).collect() == []


def test_rows_that_stay_keep_all_columns(docs_of):
    docs = docs_of(ROWS).withColumns({"digest": F.lit(1), "kept": F.lit("own"), "a.b": F.lit(2)})
    kept = exactdedup.deduplicated(docs, F.col("doc_id") < 6)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 6, 7, 8, 9, 12, 13]


@given(st.lists(st.binary(min_size=32, max_size=32), min_size=1, max_size=400, unique=True))
@settings(max_examples=30, deadline=None)
def test_hash_is_minimal_and_perfect(digests):
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    levels = exactdedup.unpacked(exactdedup.packed(exactdedup.build(words)))
    assert sorted(exactdedup.slots_of(levels, words).tolist()) == list(range(len(digests)))


def test_index_slots_hold_their_digests(docs_of):
    groups = exactdedup.grouped(exactdedup.digested(docs_of([(i, f"t{i}") for i in range(500)])))
    index = exactdedup.build_index(groups, 4).toPandas()
    for _, part in index.groupby("shard"):
        part = part.sort_values("slot")
        words = np.frombuffer(b"".join(map(bytes, part["digest"])), "<u8").reshape(-1, 4)
        levels = exactdedup.unpacked(bytes(part["function"].iloc[0]))
        assert exactdedup.slots_of(levels, words).tolist() == list(range(len(part))) == part["slot"].tolist()
    assert len(index) == 500
