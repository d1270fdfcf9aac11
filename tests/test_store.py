"""Bucketed tables, lookups by key, and tables that change by versions."""

import random
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gable import schemas
from gable.sources import store, tables, versions
from gable.streaming import ingest

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
RECORD = T.StructType([*SCHEMA.fields, T.StructField("row_class", T.StringType()), T.StructField("at", T.StringType())])
CLASSES = {"A": "ADDITION", "C": "CHANGE", "D": "DELETE"}


def rows_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def insert(df, path, buckets=8):
    tables.insert_if_absent(df, path, "k", ["v"], SCHEMA, buckets)


def files_of(path, bucket=None):
    pattern = "bucket=*/*.parquet" if bucket is None else f"bucket={bucket}/*.parquet"
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).glob(pattern)}


def scanned(df):
    """(files, rows) the scan of a plan without shuffles read; the first time it runs."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves().iterator()
    metrics = leaves.next().metrics()
    return tuple(metrics.get(name).get().value() for name in ("numFiles", "numOutputRows"))


def test_keys_are_added_once(spark, folder):
    path = f"{folder}/t"
    insert(spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")), path)
    before = files_of(path)
    for _ in range(2):
        insert(rows_of(spark, ("k7", 1000), ("new", 5), ("new", 3), (None, 1)), path)
    found = {r["k"]: r["v"] for r in tables.read_table(spark, path, SCHEMA).collect() if r["k"]}
    assert len(found) == 201 and found["k7"] == 7 and found["new"] == 3
    assert before.items() <= files_of(path).items()


def test_a_batch_of_one_key_reads_one_bucket(spark, folder):
    """The files of all other buckets can't be read, and it does not matter."""
    path = f"{folder}/t"
    insert(spark.range(200).select(F.concat(F.lit("k"), "id").alias("k"), F.col("id").alias("v")), path)
    (bucket,) = store.touched(rows_of(spark, ("k7", 0)), "k", 8)
    keys = tables.known_keys(rows_of(spark, ("k7", 0)), path, "k", SCHEMA, 8)
    assert f"PartitionFilters: [isnotnull(bucket" in keys._jdf.queryExecution().toString()
    for name in files_of(path):
        if not name.startswith(f"bucket={bucket}/"):
            Path(path, name).write_bytes(b"broken")
            Path(path, name).with_name(f".{Path(name).name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        tables.read_table(spark, path, SCHEMA).select("k").collect()
    insert(rows_of(spark, ("k7", 1000)), path)
    assert store.rows_of_keys(spark, path, SCHEMA, "k", ["k7"]).collect() == [("k7", 7)]


def test_layout_is_kept_and_can_be_changed(spark, folder):
    path = f"{folder}/t"
    insert(rows_of(spark, *[(f"k{i}", i) for i in range(50)]), path, 4)
    insert(rows_of(spark, ("k1", 99), ("x", 1)), path, 32)
    assert {n.split("/")[0] for n in files_of(path)} == {f"bucket={i}" for i in range(4)}
    store.laid_out(spark, path, "k", 3)
    insert(rows_of(spark, ("k2", 99), ("y", 1)), path)
    assert {n.split("/")[0] for n in files_of(path)} == {f"bucket={i}" for i in range(3)}
    found = {r["k"]: r["v"] for r in tables.read_table(spark, path, SCHEMA).collect()}
    assert found == {**{f"k{i}": i for i in range(50)}, "x": 1, "y": 1}
    with pytest.raises(ValueError, match="laid out by k"):
        store.layout(spark, path, "v")


def test_a_table_without_layout_is_refused(spark, folder):
    rows_of(spark, ("a", 1)).write.parquet(f"{folder}/flat")
    with pytest.raises(ValueError, match="no layout"):
        insert(rows_of(spark, ("b", 1)), f"{folder}/flat")


@pytest.fixture
def small_row_groups(spark):
    settings = spark._jsc.hadoopConfiguration()
    small = {"parquet.block.size": "20000", "parquet.page.row.count.limit": "100", "parquet.block.row.count.limit": "1000"}
    for name, value in small.items():
        settings.set(name, value)
    yield
    for name in small:
        settings.unset(name)


def test_lookup_by_key_reads_a_page_of_a_bucket(spark, folder, small_row_groups):
    path = f"{folder}/t"
    insert(spark.range(40_000).select(F.concat(F.lit("key-"), F.sha1(F.col("id").cast("string"))).alias("k"), F.col("id").alias("v")), path, 4)
    key = spark.range(1).select(F.concat(F.lit("key-"), F.sha1(F.lit("17")))).first()[0]
    found = store.rows_of_keys(spark, path, SCHEMA, "k", [key])
    files, rows = scanned(found)
    assert found.collect() == [(key, 17)]
    assert files == len(files_of(path, store.touched(rows_of(spark, (key, 0)), "k", 4)[0])) and 0 < rows <= 200
    # Keys that are not there lie between others, so only the Bloom filter can tell.
    absent = [store.rows_of_keys(spark, path, SCHEMA, "k", [f"key-{c}nowhere"]) for c in "3456789abc"]
    assert sum(scanned(df)[1] == 0 for df in absent) >= 8


def test_lookup_in_a_table_not_written_yet(spark, folder):
    assert store.rows_of_keys(spark, f"{folder}/none", SCHEMA, "k", ["a"]).collect() == []


# Versions.


def applied(state, records):
    """The definition: records one after the other."""
    for k, v, c in records:
        if c == "A":
            state.setdefault(k, v)
        elif c == "C":
            state[k] = v
        else:
            state.pop(k, None)
    return state


def append(spark, path, records, buckets=4):
    listed = [(k, v, CLASSES[c], f"{i:05d}") for i, (k, v, c) in enumerate(records)]
    df = spark.createDataFrame(listed, RECORD).repartition(3)
    return versions.append(df, path, SCHEMA, "k", ["at"], buckets)


def current(spark, path):
    return {r["k"]: r["v"] for r in versions.current(spark, path, SCHEMA, "k").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_versions_equal_records_applied_one_by_one(spark, folder, seed):
    rng, path, state = random.Random(seed), f"{folder}/t", {}
    for n in range(5):
        records = [(f"k{rng.randrange(12)}", 100 * n + i, rng.choice("AACD")) for i in range(rng.choice([3, 25]))]
        append(spark, path, records)
        if rng.random() < 0.3:
            append(spark, path, records)  # a batch repeated after a failure
        applied(state, records)
        if rng.random() < 0.4:
            versions.fold(spark, path, SCHEMA, "k")
            assert versions.batches(spark, path, SCHEMA) == 0
        assert current(spark, path) == state
    versions.fold(spark, path, SCHEMA, "k")
    assert current(spark, path) == state


def test_folding_leaves_other_buckets_alone(spark, folder):
    path = f"{folder}/t"
    append(spark, path, [(f"k{i}", i, "A") for i in range(60)], 8)
    versions.fold(spark, path, SCHEMA, "k")
    before = files_of(path)
    append(spark, path, [("k3", 1000, "C")])
    assert files_of(path) == before
    (bucket,) = versions.fold(spark, path, SCHEMA, "k")
    after = files_of(path)
    same = {n for n in before if n in after and before[n] == after[n]}
    assert same == {n for n in before if not n.startswith(f"bucket={bucket}/")} and current(spark, path)["k3"] == 1000


def test_a_bucket_whose_keys_all_go(spark, folder):
    path = f"{folder}/t"
    append(spark, path, [("a", 1, "A"), ("b", 2, "A")], 1)
    versions.fold(spark, path, SCHEMA, "k")
    append(spark, path, [("a", 1, "D"), ("b", 1, "D")])
    versions.fold(spark, path, SCHEMA, "k")
    assert current(spark, path) == {} and versions.fold(spark, path, SCHEMA, "k") == []
    append(spark, path, [("a", 9, "A")])
    assert current(spark, path) == {"a": 9}


def test_a_fold_cut_off_before_its_note_is_repeated(spark, folder):
    path = f"{folder}/t"
    append(spark, path, [("a", 1, "A"), ("b", 2, "A"), ("c", 3, "A")])
    versions.fold(spark, path, SCHEMA, "k")
    append(spark, path, [("a", 5, "C"), ("b", 0, "D"), ("b", 8, "A"), ("c", 0, "D"), ("d", 4, "A")])
    wanted = {"a": 5, "b": 8, "d": 4}
    log = versions._state(spark, path, SCHEMA)[1].select("k", "v", "row_class", "load_order")
    base = versions._state(spark, path, SCHEMA)[0].select("k", "v", "row_class", "load_order")
    store.replace_rows(versions.resolved(base.unionByName(log), "k"), path, key="k")  # died here: log and no note
    assert current(spark, path) == wanted
    versions.fold(spark, path, SCHEMA, "k")
    assert current(spark, path) == wanted


def test_only_buckets_with_changes_are_resolved(spark, folder):
    path = f"{folder}/t"
    append(spark, path, [(f"k{i}", i, "A") for i in range(30)])
    versions.fold(spark, path, SCHEMA, "k")
    assert "Window" not in versions.current(spark, path, SCHEMA, "k")._jdf.queryExecution().toString()
    append(spark, path, [("k3", 7, "C")])
    assert "Window" in versions.current(spark, path, SCHEMA, "k")._jdf.queryExecution().toString()


# Keys known to the state store.


def sale(tui, price, day):
    return (tui, price, datetime(2020, 1, day), True, True, "A", "h")


def test_stream_keeps_the_first_of_each_key_over_restarts(spark, tmp_path):
    landing, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "sales"), str(tmp_path / "state")

    def stream(*rows):
        spark.createDataFrame(rows, schemas.SALES).coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema(schemas.SALES).option("maxFilesPerTrigger", 1).parquet(landing)
        query = ingest.ingest_first(source, path, "tui", schemas.SALES, tables.FIRST, checkpoint)
        query.awaitTermination()
        return query

    stream(sale("a", 5, 9), sale("a", 4, 2), sale("b", 1, 3), sale("a", 3, 2))
    query = stream(sale("a", 1, 1), sale("c", 2, 5))
    found = {r["tui"]: r["price"] for r in tables.read_table(spark, path, schemas.SALES).collect()}
    assert found == {"a": 3, "b": 1, "c": 2}
    plan = query._jsq.explainInternal(True) if hasattr(query._jsq, "explainInternal") else ""
    assert path not in plan
    # Repeating the last batch, whose commit was lost, changes nothing.
    for name in ("1", ".1.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    stream(sale("d", 1, 1))
    found = {r["tui"]: r["price"] for r in tables.read_table(spark, path, schemas.SALES).collect()}
    assert found == {"a": 3, "b": 1, "c": 2, "d": 1}


def test_stream_deduplication_runs_no_python_for_each_key(spark, tmp_path):
    landing, path = str(tmp_path / "in"), str(tmp_path / "sales")
    nulls = ("n", None, datetime(2020, 1, 2), None, True, "A", "h")
    for rows in ([sale("a", 4, 2), sale("a", 3, 2), sale(None, 2, 3), sale(None, 1, 4), nulls, sale("n", 1, 2)], [sale(None, 0, 1), sale("b", 7, 7), sale("a", 0, 1)]):
        spark.createDataFrame(rows, schemas.SALES).coalesce(1).write.mode("append").parquet(landing)
    source = spark.readStream.schema(schemas.SALES).option("maxFilesPerTrigger", 1).parquet(landing)
    query = ingest.ingest_first(source, path, "tui", schemas.SALES, tables.FIRST, str(tmp_path / "state"))
    query.awaitTermination()
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"dedupe"}
    found = {r["tui"]: r["price"] for r in tables.read_table(spark, path, schemas.SALES).collect()}
    assert found == {"a": 3, None: 2, "n": None, "b": 7}


# Wide rows.


def test_wide_rows_are_compared_only_where_keys_repeat(spark, folder, monkeypatch):
    compared, first = [], tables.normalise.first_per_key
    monkeypatch.setattr(tables.normalise, "first_per_key", lambda rows, *a: compared.append(rows) or first(rows, *a))
    frame = lambda *rows: spark.createDataFrame(rows, schemas.SALES)
    load = lambda rows: tables.load_certificates(rows.withColumnsRenamed({"tui": "lmk_key", "date": "lodgement_date"}), folder)
    found = lambda: sorted((r["lmk_key"] or "", r["price"]) for r in spark.read.parquet(f"{folder}/certificates").collect())
    load(frame(sale("a", 1, 1), sale("b", 2, 2), sale(None, 3, 3)))
    load(frame(sale("a", 9, 9), sale("b", 9, 1), sale("b", 9, 1)))
    assert not compared and found() == [("", 3), ("a", 1), ("b", 2)]
    load(frame(sale("c", 5, 2), sale("c", 4, 1), sale("c", 6, 1), sale("d", 7, 1), sale("a", 0, 1)))
    assert len(compared) == 1 and found() == [("", 3), ("a", 1), ("b", 2), ("c", 4), ("d", 7)]
