"""Usage reports, prices, billing periods and ledgers."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gable import schemas
from gable.functions import temporal
from gable.operators import ledger, usage
from gable.plans import jobs
from gable.sources import tables
from gable.streaming import ingest

NOW = datetime(2024, 3, 10, 12)


def events(spark, *rows):
    """Rows of (user, route, tokens, timestamp[, ledger])."""
    return spark.createDataFrame(
        [
            (f"e{i}", r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else None)
            for i, r in enumerate(rows)
        ],
        schemas.USAGE,
    )


def users(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "user_id string")


def test_window_includes_both_ends(spark):
    df = events(
        spark, ("u", "/a", 5, NOW), ("u", "/a", 3, NOW + timedelta(hours=2)),
        ("u", "/a", 9, NOW + timedelta(hours=2, seconds=1)), ("v", "/a", 7, NOW),
    )
    rows = usage.usage_window(df, NOW, NOW + timedelta(hours=2), "u").collect()
    assert sorted(r["tokens"] for r in rows) == [3, 5]


def test_summary(spark):
    recent = NOW - timedelta(days=1)
    df = events(
        spark, ("u", "/stats/mean", 10, recent), ("u", "/stats/mean", 15, recent), ("u", "/stats/count", 5, recent),
        ("u", "/stats/count", 99, NOW - timedelta(days=8)),
    )
    rows = {r["user_id"]: r for r in usage.usage_summary(df, NOW, 7, users(spark, "u", "idle")).collect()}
    assert (rows["u"]["total_tokens"], rows["u"]["total_requests"]) == (30, 3)
    assert rows["u"]["average_tokens_per_request"] == 10.0
    assert (rows["idle"]["total_tokens"], rows["idle"]["average_tokens_per_request"]) == (0, 0.0)
    top = [tuple(r) for r in usage.top_routes(df, NOW, 7, 1).collect()]
    assert top == [("u", "/stats/mean", 25, 2)]


def test_top_routes_overall_breaks_ties_by_name(spark):
    df = events(spark, ("u", "/b", 5, NOW), ("v", "/a", 5, NOW), ("v", "/c", 9, NOW))
    assert [r["route"] for r in usage.top_routes(df, NOW, 7, 2, keys=()).collect()] == ["/c", "/a"]


def test_trends(spark):
    df = events(
        spark, ("u", "/a", 10, NOW - timedelta(days=2)), ("u", "/a", 20, NOW - timedelta(days=1)),
        ("u", "/b", 15, NOW - timedelta(days=1)),
    )
    rows = usage.usage_trends(df, NOW - timedelta(days=3), NOW).collect()
    assert [(str(r["date"]), r["tokens"], r["requests"]) for r in rows] == [
        ("2024-03-08", 10, 1), ("2024-03-09", 35, 2)
    ]


def test_history_is_newest_first(spark):
    rows = [
        (f"l{i}", "u", 100 + i, NOW, NOW + timedelta(days=i), NOW, None, None) for i in range(15)
    ] + [("x", "v", 1, NOW, NOW, NOW, None, None)]
    ledgers = spark.createDataFrame(rows, schemas.LEDGERS)
    assert [r["total_tokens"] for r in usage.history_of_user(ledgers, "u").collect()][:2] == [114, 113]
    listed = usage.billing_history(ledgers, 12).filter("user_id = 'u'")
    assert sorted(r["position"] for r in listed.collect()) == list(range(1, 13))
    assert min(r["total_tokens"] for r in listed.collect()) == 103


def test_prices(spark):
    calls = spark.createDataFrame(
        [("get_houses_by_postcode",), ("get_house_details",), ("create_sales_stats_task",), ("health",)],
        "api_route string",
    )
    assert {tuple(r) for r in usage.priced(calls).collect()} == {
        ("get_houses_by_postcode", 1), ("get_house_details", 2), ("create_sales_stats_task", 5)
    }


@pytest.mark.parametrize(
    "today, start, end",
    [
        ("2024-03-10 12:30", "2024-02-29 12:30", "2024-03-28 12:30"),
        ("2024-03-28 00:00", "2024-02-29 00:00", "2024-03-28 00:00"),
        ("2024-03-29 08:00", "2024-03-31 08:00", "2024-04-28 08:00"),
        ("2023-12-31 23:59", "2023-12-31 23:59", "2024-01-28 23:59"),
        ("2024-01-31 01:00", "2024-01-31 01:00", "2024-02-28 01:00"),
    ],
)
def test_billing_period(spark, today, start, end):
    period = spark.range(1).select(temporal.billing_period(temporal.moment(today)).alias("p")).first()["p"]
    assert (period["period_start"], period["period_end"]) == (
        datetime.fromisoformat(start), datetime.fromisoformat(end)
    )


def test_current_period(spark):
    df = events(spark, ("u", "/a", 4, NOW - timedelta(days=5)), ("u", "/a", 8, NOW - timedelta(days=40)))
    rows = usage.current_period_tokens(df, users(spark, "u", "idle"), NOW).collect()
    assert {r["user_id"]: r["current_period_tokens"] for r in rows} == {"u": 4, "idle": 0}


def _four(user, start=NOW, tokens=(50, 100, 150, 200)):
    return [(user, "/a", t, start + timedelta(minutes=i)) for i, t in enumerate(tokens)]


def test_ledger_sums_up_to_the_cutoff(spark):
    df = events(spark, *_four("u"))
    whole = ledger.ledger_of_user(df, "u", NOW + timedelta(days=1)).first()
    assert whole["total_tokens"] == 500
    assert (whole["period_start"], whole["period_end"]) == (NOW, NOW + timedelta(minutes=3))
    assert ledger.ledger_of_user(df, "u", NOW + timedelta(minutes=2)).first()["total_tokens"] == 300


def test_second_ledger_sees_only_new_usage(spark):
    later = NOW + timedelta(days=10)
    df = events(spark, *_four("u"), *_four("u", later, (200, 12, 50, 25)))
    first = ledger.rolled_up(df, NOW + timedelta(days=1))
    assert first.first()["total_tokens"] == 500
    stamped = ledger.stamped_by(df, first)
    assert ledger.rolled_up(stamped, later + timedelta(days=1)).first()["total_tokens"] == 287


def test_nothing_to_bill_raises(spark):
    billed = events(spark, ("u", "/a", 5, NOW, "old"))
    for user in ("u", "nobody"):
        with pytest.raises(ledger.NoUsage, match="User has no usage recorded"):
            ledger.ledger_of_user(billed, user, NOW)
    assert ledger.rolled_up(billed, NOW).isEmpty()


def test_users_in_a_period(spark):
    df = events(spark, ("u", "/a", 5, NOW - timedelta(minutes=1)))
    known = users(spark, "u", "v")
    assert [r["user_id"] for r in ledger.users_with_usage(known, df, NOW).collect()] == ["u"]
    assert ledger.users_with_usage(known, df, NOW - timedelta(minutes=2)).isEmpty()


def test_listed_users(spark):
    df = events(spark, *_four("u"), *_four("v"))
    known = users(spark, "u", "v", "w")
    assert ledger.ledgers_of_users(df, known, users(spark, "u"), NOW + timedelta(1)).count() == 1
    with pytest.raises(ValueError, match="not among the users"):
        ledger.ledgers_of_users(df, known, users(spark, "u", "x"), NOW)
    with pytest.raises(ledger.NoUsage):
        ledger.ledgers_of_users(df, known, users(spark, "w"), NOW)


def test_stamping_by_projection_equals_stamping_by_join(spark):
    rows = [
        (f"u{i % 5}", "/a", i, NOW + timedelta(minutes=i % 17), "old" if i % 7 == 0 else None)
        for i in range(200)
    ]
    df = events(spark, *rows)
    cutoff = NOW + timedelta(minutes=9)
    joined = ledger.stamped_by(df, ledger.rolled_up(df, cutoff)).select("id", "ledger_id")
    plain = ledger.stamped(df, cutoff).select("id", "ledger_id")
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_billing_run_can_be_repeated(spark, folder):
    path = f"{folder}/usage"
    later = NOW + timedelta(days=3)
    tables.append_usage(events(spark, *_four("u"), *_four("v"), *_four("u", later)), path, "load")
    cutoff = NOW + timedelta(days=1)
    for _ in range(2):
        jobs.run_billing(spark, path, folder, cutoff)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    assert {(r["user_id"], r["total_tokens"]) for r in ledgers.collect()} == {("u", 500), ("v", 500)}
    stored = tables.read_usage(spark, path)
    assert stored.count() == 12
    assert stored.filter(F.col("ledger_id").isNull()).count() == 4
    items = ledger.ledger_items(ledgers, stored).groupBy("user_id").agg(F.sum("tokens").alias("t"))
    assert {tuple(r) for r in items.collect()} == {("u", 500), ("v", 500)}
    jobs.run_billing(spark, path, folder, later + timedelta(days=1))
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    assert sorted(r["total_tokens"] for r in ledgers.collect()) == [500, 500, 500]
    runs = tables.read_table(spark, f"{folder}/aggregation_event", schemas.AGGREGATION_EVENTS)
    assert runs.count() == 2 and all(r["run_time"] >= 0 for r in runs.collect())
    assert ledger.event_ledgers(runs, ledgers).count() == 3


def test_billing_run_finishes_what_a_failed_run_left(spark, folder):
    """Ledgers written, stamping lost: the next run keeps the ledgers and stamps."""
    path, cutoff = f"{folder}/usage", NOW + timedelta(days=1)
    tables.append_usage(events(spark, *_four("u")), path, "load")
    tables.insert_if_absent(
        ledger.rolled_up(spark.read.parquet(path), cutoff), f"{folder}/billing_ledger", "id",
        ["period_end"], schemas.LEDGERS,
    )
    jobs.run_billing(spark, path, folder, cutoff)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    assert [r["total_tokens"] for r in ledgers.collect()] == [500]
    assert tables.read_usage(spark, path).filter(F.col("ledger_id").isNull()).isEmpty()


def test_late_usage_is_billed_once_in_a_ledger_of_its_own(spark, folder):
    path, cutoff = f"{folder}/usage", NOW + timedelta(days=1)

    def totals():
        ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
        stamped = tables.read_usage(spark, path).groupBy("ledger_id").agg(F.sum("tokens").alias("t"))
        rows = ledgers.join(stamped, F.col("id") == F.col("ledger_id")).select("total_tokens", "t").collect()
        return sorted(map(tuple, rows)), ledgers.count()

    tables.append_usage(events(spark, *_four("u", tokens=(40, 60, 0, 0))), path, "load")
    jobs.run_billing(spark, path, folder, cutoff)
    late = events(spark, ("u", "/a", 50, NOW, None)).withColumn("id", F.concat(F.lit("late"), "id"))
    tables.append_usage(late, path, "late")
    for _ in range(2):
        jobs.run_billing(spark, path, folder, cutoff)
    assert totals() == ([(50, 50), (100, 100)], 2)
    assert tables.read_usage(spark, path).filter(F.col("ledger_id").isNull()).isEmpty()
    runs = tables.read_table(spark, f"{folder}/aggregation_event", schemas.AGGREGATION_EVENTS)
    assert runs.count() == 2


def test_late_usage_after_a_failed_run_is_not_lost(spark, folder, monkeypatch):
    """The run fails after its ledgers; more usage comes; the next run finishes the first and bills the rest."""
    path, cutoff = f"{folder}/usage", NOW + timedelta(days=1)
    tables.append_usage(events(spark, *_four("u", tokens=(40, 60, 0, 0))), path, "load")
    with monkeypatch.context() as m:
        def fail(*_):
            raise RuntimeError("lost")

        m.setattr(tables, "link_usage", fail)
        with pytest.raises(RuntimeError):
            jobs.run_billing(spark, path, folder, cutoff)
    late = events(spark, ("u", "/a", 50, NOW, None)).withColumn("id", F.concat(F.lit("late"), "id"))
    tables.append_usage(late, path, "late")
    jobs.run_billing(spark, path, folder, cutoff)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    stamped = tables.read_usage(spark, path).groupBy("ledger_id").agg(F.sum("tokens").alias("t"))
    rows = ledgers.join(stamped, F.col("id") == F.col("ledger_id")).select("total_tokens", "t").collect()
    assert sorted(map(tuple, rows)) == [(50, 50), (100, 100)]


def test_another_time_zone_is_refused(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        with pytest.raises(ValueError, match="UTC"):
            jobs.run_billing(spark, f"{folder}/usage", folder, NOW)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_repeated_batch_adds_only_what_is_missing(spark, folder):
    path = f"{folder}/usage"
    df = events(spark, *_four("u"), *_four("v", NOW + timedelta(days=1)))
    tables.append_usage(df.filter("user_id = 'u'"), path, "one")
    for _ in range(2):
        tables.append_usage(df, path, "one")
    tables.append_usage(events(spark, *_four("w")).withColumn("id", F.concat(F.lit("w"), "id")), path, "two")
    assert spark.read.parquet(path).groupBy("batch").count().orderBy("batch").collect() == [("one", 8), ("two", 4)]


def test_streamed_usage_can_be_billed_and_streamed_on(spark, folder):
    landing, path = f"{folder}/landing", f"{folder}/usage"

    def stream(*rows):
        events(spark, *rows).coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema(schemas.USAGE).parquet(landing)
        ingest.ingest_usage(source, path, f"{folder}/checkpoint").awaitTermination()

    stream(*_four("u"))
    jobs.run_billing(spark, path, folder, NOW + timedelta(hours=1))
    stream(*_four("u", NOW + timedelta(days=1)))
    jobs.run_billing(spark, path, folder, NOW + timedelta(days=2))
    stored = tables.read_usage(spark, path)
    assert stored.count() == 8 and stored.filter(F.col("ledger_id").isNull()).isEmpty()
    assert stored.select("ledger_id").distinct().count() == 2


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).glob("day=*/*.parquet")}


def test_billing_leaves_the_usage_files_alone(spark, folder):
    path, cutoff = f"{folder}/usage", NOW + timedelta(days=2)
    tables.append_usage(events(spark, *_four("u"), *_four("v", NOW + timedelta(days=1))), path, "load")
    before = files_of(path)
    jobs.run_billing(spark, path, folder, cutoff)
    tables.append_usage(events(spark, ("u", "/a", 50, NOW, None)).withColumn("id", F.concat(F.lit("late"), "id")), path, "late")
    jobs.run_billing(spark, path, folder, cutoff)
    assert before.items() <= files_of(path).items() and len(files_of(path)) == len(before) + 1
    assert tables.read_usage(spark, path).filter(F.col("ledger_id").isNull()).isEmpty()
    assert spark.read.parquet(path).filter(F.col("ledger_id").isNotNull()).isEmpty()


def test_settling_stamps_days_and_joins_their_files(spark, folder):
    path, cutoff = f"{folder}/usage", NOW + timedelta(days=3)
    for k in range(5):
        rows = [(*r[:2], r[2], r[3], None) for r in (*_four("u"), *_four("v", NOW + timedelta(days=k % 2)))]
        tables.append_usage(events(spark, *rows).withColumn("id", F.concat(F.lit(f"{k}-"), "id")), path, f"b{k}")
    single = events(spark, ("u", "/a", 1, NOW + timedelta(days=9), None)).withColumn("id", F.lit("x"))
    tables.append_usage(single, path, "single")
    jobs.run_billing(spark, path, folder, cutoff)
    def now():
        return sorted(map(tuple, tables.read_usage(spark, path).select("id", "ledger_id", "batch").collect()), key=str)

    wanted, before = now(), files_of(path)
    days = [d.isoformat() for d in tables.settle_usage(spark, path, before="2024-03-11")]
    assert days == ["2024-03-10"] and now() == wanted
    assert {d: sum(f"day={d}" in f for f in files_of(path)) for d in ("2024-03-10", "2024-03-11", "2024-03-19")} == {
        "2024-03-10": 1, "2024-03-11": 2, "2024-03-19": 1
    }
    assert [d.isoformat() for d in tables.settle_usage(spark, path)] == ["2024-03-11"] and now() == wanted
    assert tables.settle_usage(spark, path) == []
    (alone,) = [f for f in before if "day=2024-03-19" in f]
    assert files_of(path)[alone] == before[alone]
    # A batch repeated after its days were settled is still known, and billing goes on.
    tables.append_usage(single, path, "single")
    jobs.run_billing(spark, path, folder, NOW + timedelta(days=10))
    assert len(now()) == len(wanted)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    assert sorted((r["user_id"], r["total_tokens"]) for r in ledgers.collect()) == [("u", 1), ("u", 2500), ("v", 2500)]


def test_settling_cut_off_before_the_links_went_is_repeated(spark, folder):
    path = f"{folder}/usage"
    tables.append_usage(events(spark, *_four("u")), path, "load")
    jobs.run_billing(spark, path, folder, NOW + timedelta(days=1))
    wanted = sorted(map(tuple, tables.read_usage(spark, path).select("id", "ledger_id").collect()))
    tables.replace_rows(tables.read_usage(spark, path), path, tables.USAGE_LAYOUT)  # died here
    assert sorted(map(tuple, tables.read_usage(spark, path).select("id", "ledger_id").collect())) == wanted
    assert len(tables.settle_usage(spark, path)) == 1 and tables.settle_usage(spark, path) == []
    assert sorted(map(tuple, spark.read.parquet(path).select("id", "ledger_id").collect())) == wanted


def test_windows_close_at_the_watermark_over_restarts(spark, folder):
    """One event comes late but before the watermark, one after it; each run is a restart."""
    landing = f"{folder}/landing"
    day = lambda n, hour=1: datetime(2024, 1, n, hour)

    def deliver(*rows):
        spark.createDataFrame([(t, n) for t, n in rows], "timestamp timestamp, tokens bigint").coalesce(1).write.mode("append").parquet(landing)
        source = spark.readStream.schema("timestamp timestamp, tokens bigint").parquet(landing)
        for mode in ("update", "append"):
            totals = ingest.windowed_totals(source, "1 day")
            ingest.keep_windows(totals, f"{folder}/{mode}", f"{folder}/{mode}-state", mode).awaitTermination()
        ingest.keep_daily_totals(ingest.daily_totals(source), f"{folder}/all", f"{folder}/all-state").awaitTermination()
        found = ingest.with_late(
            ingest.latest_daily_totals(spark, f"{folder}/all"), ingest.latest_windows(spark, f"{folder}/update"),
            ingest.closed_windows(spark, f"{folder}/append"),
        )
        return {r["date"].day: tuple(r)[1:] for r in found.collect()}

    assert deliver((day(1), 5), (day(2), 7)) == {1: (5, 1, 0, 0, False), 2: (7, 1, 0, 0, False)}
    # Day 1 is open until the newest event is past the end of day 2: this one still counts.
    assert deliver((day(1, 9), 10), (day(3, 2), 1)) == {1: (15, 2, 0, 0, True), 2: (7, 1, 0, 0, False), 3: (1, 1, 0, 0, False)}
    # Now it is closed, and day 2 is not.
    assert deliver((day(1, 20), 100), (day(2, 20), 1000)) == {
        1: (15, 2, 100, 1, True), 2: (1007, 2, 0, 0, False), 3: (1, 1, 0, 0, False)
    }
    closed = [(r["start"].day, r["tokens"], r["requests"]) for r in ingest.closed_windows(spark, f"{folder}/append").collect()]
    assert closed == [(1, 15, 2)]


def test_the_next_run_is_found_in_one_look(spark):
    ids = [spark.range(1).select(ledger.event_id(NOW, n)).first()[0] for n in range(3)] + ["other"]
    records = spark.createDataFrame([(i, 1, NOW) for i in ids], schemas.AGGREGATION_EVENTS)
    assert ledger.next_run(records, NOW) == 3
    assert ledger.next_run(records, NOW + timedelta(1)) == 0
    assert ledger.next_run(records.limit(0), NOW) == 0
