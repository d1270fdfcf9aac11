"""Sale files, certificate files, keyed inserts, load state and streams."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gable import fixed, schemas
from gable.operators import certificates, normalise
from gable.plans import jobs
from gable.sources import files, state, store, tables
from gable.streaming import ingest


def record(tui="{t1}", price="100000", date="2021-11-15 00:00", postcode="LS17 3AD", kind="D", new="N",
           duration="F", paon="10", saon="", street="High Street", category="A", status="A"):
    return [tui, price, date, postcode, kind, new, duration, paon, saon, street, "", "LEEDS", "LEEDS",
            "WEST YORKSHIRE", category, status]


def write_sales(path, *records):
    lines = [",".join('"' + f.replace('"', '""') + '"' for f in r) for r in records]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def stored(spark, folder, name):
    if name == "sales":
        return tables.read_sales(spark, folder)
    return tables.read_table(spark, f"{folder}/{name}", tables.SALE_TABLES[name])


def test_sale_file_to_rows(spark, tmp_path):
    source = write_sales(tmp_path / "pp.csv", record(street='The "Old" Mill, Lane'), record("{t2}", postcode="NOT A POSTCODE"))
    raw = files.read_sales(spark, source)
    assert raw.columns == list(fixed.SALE_FILE_COLUMNS)
    row = normalise.normalised(raw).collect()
    assert len(row) == 1
    row = row[0]
    assert (row["tui"], row["price"], row["date"]) == ("t1", 100000, datetime(2021, 11, 15))
    assert (row["outcode"], row["area"], row["sector"]) == ("LS17", "LS", "LS17 3")
    assert (row["houseid"], row["saon"], row["street"]) == ("10LS17 3AD", "", 'The "Old" Mill, Lane')
    assert (row["new"], row["freehold"], row["row_class"]) == (True, True, "ADDITION")


def test_new_build_flag_by_mode(spark, tmp_path):
    raw = files.read_sales(spark, write_sales(tmp_path / "pp.csv", record(new="Y")))
    assert normalise.normalised(raw).first()["new"] is False
    assert normalise.normalised(raw, normalise.INTENDED).first()["new"] is True


@pytest.mark.parametrize("bad", [{"date": "15/11/2021"}, {"price": ""}])
def test_bad_record_fails_or_is_screened(spark, tmp_path, bad):
    raw = files.read_sales(spark, write_sales(tmp_path / "pp.csv", record(**bad), record("{t2}")))
    with pytest.raises(Exception, match="bad sale record"):
        normalise.normalised(raw).collect()
    good, rejected = normalise.screened(raw)
    assert [r["tui"] for r in good.collect()] == ["t2"]
    assert [(r["tui"], r["reason"]) for r in rejected.collect()] == [("t1", *bad)]


def test_bad_record_fails_whatever_is_read(spark, tmp_path):
    raw = files.read_sales(spark, write_sales(tmp_path / "pp.csv", record("{t2}"), record(date="15/11/2021")))
    with pytest.raises(Exception, match="bad sale record"):
        normalise.normalised(raw).count()
    with pytest.raises(Exception, match="bad sale record"):
        normalise.normalised(raw).select("postcode").distinct().collect()


def test_bad_deletion_fails_the_load(spark, tmp_path, folder):
    source = write_sales(tmp_path / "pp.csv", record("{t2}"), record(date="garbage", status="D"))
    with pytest.raises(Exception, match="bad sale record"):
        jobs.load_sales_file(spark, source, folder)


def test_malformed_file_fails(spark, tmp_path):
    source = write_sales(tmp_path / "pp.csv", record(), record(price="many"))
    with pytest.raises(Exception):
        files.read_sales(spark, source).collect()
    short = write_sales(tmp_path / "short.csv", record()[:9])
    with pytest.raises(Exception):
        files.read_sales(spark, short).collect()


def test_width_check_is_optional(spark, tmp_path):
    raw = files.read_sales(spark, write_sales(tmp_path / "pp.csv", record(street="x" * 71)))
    assert normalise.normalised(raw).count() == 1
    _, rejected = normalise.screened(raw, check_widths=True)
    assert rejected.first()["reason"] == "street too long"
    with pytest.raises(Exception, match="street too long"):
        normalise.normalised(raw, check_widths=True).collect()


def test_status_split(spark, tmp_path):
    records = [record("{%s}" % s, status=s) for s in ("A", "C", "D", "X")]
    rows = normalise.normalised(files.read_sales(spark, write_sales(tmp_path / "pp.csv", *records)))
    assert sorted(r["tui"] for r in normalise.additions(rows).collect()) == ["A", "C"]
    assert sorted(r["tui"] for r in normalise.deletions(rows).collect()) == ["D", "X"]


def test_first_writer_wins_within_and_across_loads(spark, tmp_path):
    folder = str(tmp_path / "tables")
    first = write_sales(
        tmp_path / "one.csv",
        record("{b}", date="2020-02-01 00:00", street="Later", kind="S"),
        record("{a}", date="2020-01-01 00:00", street="Early", kind="D"),
        record("{a}", price="1", date="2020-03-01 00:00"),
    )
    second = write_sales(
        tmp_path / "two.csv", record("{a}", price="5", status="C"), record("{c}", date="2019-01-01 00:00", street="New"),
        record("{d}", postcode="M1 1AA", street="Other"), record("{b}", status="D"),
    )
    assert jobs.load_sales_file(spark, first, folder)
    assert jobs.load_sales_file(spark, second, folder)
    streets = {r["postcode"]: r["street"] for r in stored(spark, folder, "postcodes").collect()}
    assert streets == {"LS17 3AD": "Early", "M1 1AA": "Other"}
    types = {r["houseid"]: r["type"] for r in stored(spark, folder, "houses").collect()}
    assert types == {"10LS17 3AD": "D", "10M1 1AA": "D"}
    prices = {r["tui"]: r["price"] for r in stored(spark, folder, "sales").collect()}
    assert prices == {"a": 100000, "b": 100000, "c": 100000, "d": 100000}


def test_unchanged_file_is_skipped(spark, tmp_path):
    folder = str(tmp_path / "tables")
    source = write_sales(tmp_path / "pp.csv", record())
    assert jobs.load_sales_file(spark, source, folder) is True
    assert jobs.load_sales_file(spark, source, folder) is False
    row = state.read_state(spark, f"{folder}/state").first()
    assert row["last_ppd_file"] and row["last_epc_file"] == ""
    assert row["last_epc_update"] == datetime(1970, 1, 1) and row["last_ppd_update"] > datetime(2020, 1, 1)


def test_changes_and_deletions_apply_when_intended(spark, tmp_path):
    folder = str(tmp_path / "tables")
    mode = normalise.INTENDED
    jobs.load_sales_file(spark, write_sales(tmp_path / "1.csv", record("{a}"), record("{b}"), record("{c}")), folder, mode)
    update = write_sales(
        tmp_path / "2.csv", record("{a}", price="5", status="C"), record("{b}", status="D"),
        record("{c}", price="7"), record("{d}"), record("{e}", status="D"),
    )
    jobs.load_sales_file(spark, update, folder, mode)
    prices = {r["tui"]: r["price"] for r in stored(spark, folder, "sales").collect()}
    assert prices == {"a": 5, "c": 100000, "d": 100000}


def test_last_record_of_the_file_counts(spark, tmp_path):
    """A change to a lower price on the same date, and one to an earlier date, win by their place."""
    folder, mode = str(tmp_path / "tables"), normalise.INTENDED
    source = write_sales(
        tmp_path / "1.csv", record("{a}", price="200"), record("{b}"), record("{a}", price="100", status="C"),
        record("{b}", price="3", date="2020-01-01 00:00", status="C"), record("{c}"), record("{c}", status="D"),
    )
    jobs.load_sales_file(spark, source, folder, mode)
    assert {r["tui"]: r["price"] for r in stored(spark, folder, "sales").collect()} == {"a": 100, "b": 3}


def test_stream_applies_changes_and_deletions_when_intended(spark, tmp_path):
    landing, folder = tmp_path / "in", str(tmp_path / "tables")
    landing.mkdir()

    def stream(name, *records):
        write_sales(landing / name, *records)
        ingest.ingest_sales(
            spark, str(landing), folder, str(tmp_path / "checkpoint"), normalise.INTENDED, "*.csv", maxFilesPerTrigger=1
        ).awaitTermination()

    stream("1.csv", record("{a}"), record("{b}"), record("{c}"))
    stream("2.csv", record("{a}", price="999", status="C"), record("{b}", status="D"), record("{d}"))
    assert {r["tui"]: r["price"] for r in stored(spark, folder, "sales").collect()} == {"a": 999, "c": 100000, "d": 100000}


def test_first_per_key_with_a_hot_key(spark):
    rows = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 100)).alias("k"),
        (30000 - F.col("id")).alias("at"), F.col("id").alias("v"),
    )
    found = {r["k"]: r["v"] for r in normalise.first_per_key(rows, "k", ["k", "v"], ["at"]).collect()}
    brute = {}
    for i in range(30000):
        brute["hot" if i % 3 == 0 else f"k{i % 100}"] = i
    assert found == brute


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = spark.range(1000).select(F.col("id"), F.lit("x").alias("t"))
    known = state.fingerprint(rows).first()
    assert known["rows"] == 1000
    assert state.changed(rows.orderBy(F.desc("id")).repartition(7), known["fingerprint"]).first()["changed"] is False
    assert state.changed(rows.filter("id > 0"), known["fingerprint"]).first()["changed"] is True
    assert state.changed(rows.unionAll(rows.limit(1)), known["fingerprint"]).first()["changed"] is True
    assert state.changed(rows, None).first()["changed"] is True
    assert state.fingerprint(rows.limit(0)).first()["rows"] == 0


def test_fingerprints_of_parts_add_up_and_tell_which_changed(spark):
    rows = spark.range(1000).select(F.col("id"), F.lit("x").alias("t"), F.when(F.col("id") < 900, F.col("id") % 7).alias("p"))
    parts = state.part_fingerprints(rows, F.col("p"))
    assert state.of_parts(parts).first() == state.fingerprint(rows).first()
    assert state.changed_parts(parts, state.part_fingerprints(rows.repartition(5), F.col("p"))).isEmpty()
    other = rows.filter("p <=> null OR p <> 3").withColumn("t", F.when(F.col("id").isin(8, 950), None).otherwise(F.col("t")))
    more = other.unionByName(other.limit(1).withColumn("p", F.lit(9)))
    found = state.changed_parts(parts, state.part_fingerprints(more, F.col("p"))).collect()
    assert {r["part"]: r["change"] for r in found} == {1: "changed", 3: "removed", 9: "added", None: "changed"}
    assert state.of_parts(parts.limit(0)).first() == state.fingerprint(rows.limit(0)).first()


def test_sales_stream_loads_each_file_once(spark, tmp_path):
    landing, folder, checkpoint = tmp_path / "landing", str(tmp_path / "tables"), str(tmp_path / "checkpoint")
    landing.mkdir()
    write_sales(landing / "1.csv", record("{a}"), record("{b}", postcode="BAD"))
    ingest.ingest_sales(spark, str(landing), folder, checkpoint).awaitTermination()
    write_sales(landing / "2.csv", record("{a}", price="1"), record("{c}"))
    for _ in range(2):
        ingest.ingest_sales(spark, str(landing), folder, checkpoint).awaitTermination()
    prices = {r["tui"]: r["price"] for r in stored(spark, folder, "sales").collect()}
    assert prices == {"a": 100000, "c": 100000}
    assert stored(spark, folder, "houses").count() == 1


def test_usage_stream_keeps_daily_totals_over_restarts(spark, tmp_path):
    landing, path, checkpoint = str(tmp_path / "landing"), str(tmp_path / "daily"), str(tmp_path / "checkpoint")

    def emit(*rows):
        spark.createDataFrame([(t, n) for t, n in rows], "timestamp timestamp, tokens bigint").coalesce(
            1
        ).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("timestamp timestamp, tokens bigint").parquet(landing)
        ingest.keep_daily_totals(ingest.daily_totals(stream), path, checkpoint).awaitTermination()

    emit((datetime(2024, 1, 1, 1), 5), (datetime(2024, 1, 2, 1), 7))
    emit((datetime(2024, 1, 2, 23), 1), (datetime(2024, 1, 3), 2))
    found = {str(r["date"]): (r["tokens"], r["requests"]) for r in ingest.latest_daily_totals(spark, path).collect()}
    assert found == {"2024-01-01": (5, 1), "2024-01-02": (8, 2), "2024-01-03": (2, 1)}


def write_certificates(path, headers, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(headers)] + [",".join(f'"{row.get(h, "")}"' for h in headers) for row in rows]
    path.write_text("\n".join(lines) + "\n")


def test_certificates_bind_by_header_name(spark, tmp_path):
    headers = list(schemas.CERTIFICATE_HEADERS)
    one = {"LMK_KEY": "k1", "CURRENT_ENERGY_RATING": " c ", "TOTAL_FLOOR_AREA": "70.5", "POSTTOWN": "LEEDS",
           "LODGEMENT_DATE": "2020-01-05", "LODGEMENT_DATETIME": "2020-01-05 10:00:00", "UPRN": " 100 ",
           "LOCAL_AUTHORITY_LABEL": "Leeds", "CONSTITUENCY_LABEL": "North", "CURRENT_ENERGY_EFFICIENCY": "12.0"}
    write_certificates(tmp_path / "in" / "a" / "certificates.csv", headers, one)
    write_certificates(
        tmp_path / "in" / "b" / "c" / "certificates.csv", ["EXTRA", *reversed(headers)],
        {**one, "LMK_KEY": "k2", "EXTRA": "x"}, {**one, "TOTAL_FLOOR_AREA": "1", "LODGEMENT_DATE": "2021-01-01"},
    )
    write_certificates(tmp_path / "in" / "a" / "recommendations.csv", ["LMK_KEY"], {"LMK_KEY": "no"})
    groups = files.certificate_headers(spark, str(tmp_path / "in"))
    assert len(groups) == 2 and all(len(paths) == 1 for _, paths in groups)
    folder = str(tmp_path / "tables")
    for _ in range(2):
        jobs.load_certificate_files(spark, str(tmp_path / "in"), folder)
    rows = {r["lmk_key"]: r for r in spark.read.parquet(f"{folder}/certificates").collect()}
    assert set(rows) == {"k1", "k2"}
    row = rows["k1"]
    assert (row["current_energy_rating"], row["total_floor_area"], row["uprn"]) == ("C", Decimal("70.50"), 100)
    assert (row["post_town"], row["local_authority_name"], row["constituency_name"]) == ("LEEDS", "Leeds", "North")
    assert row["lodgement_date"] == date(2020, 1, 5) and row["lodgement_datetime"] is None
    assert row["current_energy_efficiency"] is None and row["address1"] is None


def test_certificate_time_is_kept_when_intended(spark):
    raw = spark.createDataFrame(
        [tuple("2020-01-05 10:00:00" if h == "LODGEMENT_DATETIME" else "" for h in schemas.CERTIFICATE_HEADERS)],
        ", ".join(f"{h} string" for h in schemas.CERTIFICATE_HEADERS),
    )
    assert certificates.typed(raw).first()["lodgement_datetime"] is None
    assert certificates.typed(raw, normalise.INTENDED).first()["lodgement_datetime"] == datetime(2020, 1, 5, 10)


def test_missing_certificate_header_is_refused(spark, tmp_path):
    write_certificates(tmp_path / "certificates.csv", ["LMK_KEY"], {"LMK_KEY": "k"})
    with pytest.raises(ValueError, match="headers missing"):
        files.read_certificates(spark, str(tmp_path))


def test_sales_by_year_skip_other_years(spark, folder):
    rows = spark.createDataFrame(
        [(f"t{i}", i, datetime(1990 + i % 10, 1 + i % 12, 1), True, True, "A", "h") for i in range(100)], schemas.SALES
    )
    tables.save_sales_by_year(rows, f"{folder}/sales")
    found = spark.read.parquet(f"{folder}/sales")
    assert found.count() == 100
    one = found.filter("year = 1995")
    assert one.count() == 10
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().toString()


def test_an_interrupted_replacement_is_finished_by_the_next_job(spark, folder):
    path = f"{folder}/usage"
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "day string, tokens int")
    old.write.partitionBy("day").parquet(path)
    new = spark.createDataFrame([("a", 10)], "day string, tokens int")
    new.write.parquet(f"{folder}/new")
    store._overwrite(spark, f"{path}-replacement", [(f"{folder}/new", False)], store._NOTE)
    for _ in range(2):
        tables.finish_replace(spark, path, ("day",))
    assert {(r["day"], r["tokens"]) for r in spark.read.parquet(path).collect()} == {("a", 10), ("b", 3)}
    tables.replace_rows(spark.createDataFrame([("b", 30)], "day string, tokens int"), path, ("day",))
    assert {(r["day"], r["tokens"]) for r in spark.read.parquet(path).collect()} == {("a", 10), ("b", 30)}
