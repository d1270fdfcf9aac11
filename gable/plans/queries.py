"""The registered queries: each operator over the whole test tables."""

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import bindings as b
from gable import fixed, schemas
from gable.functions import text
from gable.operators import (
    certificates,
    extract,
    houses,
    ledger,
    nest,
    normalise,
    registry,
    rollups,
    stats,
    usage,
)
from gable.plans import jobs, refresh
from gable.session import fresh_folder, staged
from gable.sources import results, state, store, tables, versions
from gable.streaming import ingest

LEVELS = fixed.AREA_TYPES
KEYS = list(jobs.AREA_KEYS)
START, END = b.RANGE
Query = Callable[[SparkSession, str], DataFrame]


def iso_day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


def iso_time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return b.postcodes(spark, d), b.houses(spark, d), b.sales(spark, d)


def _everything(spark: SparkSession, d: str) -> tuple:
    """The tables and all levels, over the open range."""
    return (*_tables(spark, d), LEVELS)


# Extraction


def sales_extract(spark, d):
    rows = extract.sales_frame(*_tables(spark, d), start=START, end=END)
    return rows.withColumn("date", iso_time("date"))


def sales_of_area(spark, d):
    """One area, as SQL with named parameters."""
    postcodes, houses_, sales = _tables(spark, d)
    sql = """
        SELECT s.price, date_format(s.date, 'yyyy-MM-dd') AS date, h.type, h.paon, h.saon,
               h.postcode, p.street, p.town, h.houseid
        FROM {postcodes} p
        JOIN {houses} h ON p.postcode = h.postcode AND p.county = :area AND h.type != 'O'
        JOIN {sales} s ON h.houseid = s.houseid
        WHERE s.ppd_cat = 'A' AND s.date BETWEEN :start AND :end
    """
    parameters = {"area": "County 1", "start": datetime.fromisoformat(START), "end": datetime.fromisoformat(END)}
    return extract.run_query(spark, sql, parameters, postcodes=postcodes, houses=houses_, sales=sales)


# Statistics, every area of all seven levels


def mean_price(spark, d):
    return stats.mean_price(jobs.price_rollup(*_everything(spark, d)), KEYS)


def std_house_price(spark, d):
    spread = stats.std_house_price(jobs.price_rollup(*_everything(spark, d)), KEYS)
    return spread.withColumn("std_price", F.round("std_price", 4))


def most_expensive_sale(spark, d):
    return stats.most_expensive_sale(jobs.price_rollup(*_everything(spark, d)), KEYS)


def count_house_types(spark, d):
    return stats.count_house_types(jobs.span_rollup(*_everything(spark, d)), KEYS)


def avg_house_tenancy(spark, d):
    return stats.avg_house_tenancy(jobs.span_rollup(*_everything(spark, d)), KEYS)


def count_price(spark, d):
    rows = stats.count_price(jobs.monthly_rollup(*_everything(spark, d)), KEYS)
    return rows.withColumn("period", iso_day("period"))


def count_price_wide(spark, d):
    """Monthly counts with a column per type."""
    rows = stats.count_price(jobs.monthly_rollup(*_everything(spark, d)), KEYS)
    wide = nest.widened(rows, [*KEYS, "period"], "count", ["all", "D", "S", "T", "F"])
    return wide.withColumn("period", iso_day("period")).withColumnsRenamed(
        {"all": "n_all", "D": "n_d", "S": "n_s", "T": "n_t", "F": "n_f"}
    )


def sale_volume(spark, d):
    rows = stats.sale_volume(jobs.monthly_rollup(*_everything(spark, d)), KEYS)
    return rows.withColumn("period", iso_day("period"))


def pct_change_price(spark, d):
    rows = stats.pct_change_price(jobs.monthly_rollup(*_everything(spark, d)), KEYS)
    return rows.withColumn("period", iso_day("period")).withColumn("pct_change", F.round("pct_change", 6))


def stats_bundle(spark, d):
    rows = jobs.all_statistics(*_everything(spark, d))
    return rows.withColumn("period", iso_day("period")).withColumn("value", F.round("value", 4))


def frame_statistics(spark, d):
    """Statistics from extracted rows through the registry, planned together, over the open range."""
    frame = extract.sales_frame(*_tables(spark, d), area_columns=["county"])
    rows = registry.run_together(frame, ["mean_price", "count_house_types", "avg_house_tenancy"], ["county"])
    return rows.select("county", "type", "statistic", F.round("value", 6).alias("value"))


def area_statistics(spark, d):
    """Chosen statistics of one area, from the rows extracted for it."""
    frame = extract.sales_frame(*_tables(spark, d), "county", "County 1")
    rows = registry.run_together(frame, ["mean_price", "count_house_types", "avg_house_tenancy"])
    return rows.select("type", "statistic", F.round("value", 6).alias("value"))


# Result shapes, stored results, catalogue


def _monthly_counts(spark, d) -> DataFrame:
    return stats.count_price(jobs.monthly_rollup(*_everything(spark, d)), KEYS)


def stats_nested(spark, d):
    """Monthly counts of each area as one JSON object: period to type to count."""
    nested = nest.packed(_monthly_counts(spark, d), KEYS, "count", ["period", "type"])
    return nest.as_json(nested).select(*KEYS, "result")


def stats_report(spark, d):
    """Four statistics of each area in their nested shapes, one row per statistic."""
    names = ["most_expensive_sale", "count_house_types", "count_price", "sale_volume"]
    return nest.report_together(jobs.statistics(names, *_everything(spark, d)), KEYS)


def sale_gaps(spark, d):
    """Dates of sale of every house with the days since the date before."""
    rows = rollups.sale_gaps(extract.sales_frame(*_tables(spark, d)))
    return rows.withColumn("date", iso_time("date"))


def stats_store(spark, d):
    """Mean prices packed, stored under their keys, and read back as rows."""
    path = fresh_folder(spark, "results")
    identity = state.fingerprint(b.sales(spark, d)).first()["fingerprint"]
    packed = nest.as_json(nest.packed(mean_price(spark, d), KEYS, "mean_price", ["type"]))
    keyed = results.keyed(packed, "mean_price", snapshot=identity)
    results.store(keyed, path)
    results.store(keyed, path)
    read = results.stored(spark, path, "mean_price")
    values = F.from_json("result", "map<string, double>")
    return read.select("data_id", *KEYS, F.explode(values).alias("type", "mean_price"))


def stats_cached(spark, d):
    """Mean prices looked up, else computed and stored: again, for new data, and for areas in capitals."""
    path = fresh_folder(spark, "results")

    def run(case: str, snapshot: str, shift: int = 0, change=lambda c: c) -> DataFrame:
        def compute():
            rows = mean_price(spark, d).withColumns({"area": change(F.col("area")), "mean_price": F.col("mean_price") + shift})
            return nest.as_json(nest.packed(rows, KEYS, "mean_price", ["type"]))

        areas = mean_price(spark, d).select("area_type", change(F.col("area")).alias("area")).distinct()
        rows = results.cached(path, spark, areas, "mean_price", compute, snapshot=snapshot)
        values = F.explode(F.from_json("result", "map<string, double>")).alias("type", "mean_price")
        return staged(rows.select(F.lit(case).alias("case"), *KEYS, values), "cached")

    cases = [run("first", "one"), run("again", "one", 1), run("new data", "two", 2), run("capitals", "one", 3, F.upper)]
    return reduce(DataFrame.unionByName, cases)


def stats_refreshed(spark, d):
    """All statistics from stored rollups, after a batch of additions, changes and deletions was taken in."""
    folder, houses_, sales = fresh_folder(spark, "kept"), b.houses(spark, d), staged(b.sales(spark, d), "sales")
    last = F.substring("tui", -1, 1)
    batches = (
        [(last != "3", normalise.ADD, 0)],
        [(last == "3", normalise.ADD, 0), (last == "1", normalise.DELETE, 0), (last == "2", normalise.CHANGE, 1000)],
    )
    for batch in batches:
        parts = [
            sales.filter(kept).withColumns({"price": F.col("price") + more, "row_class": F.lit(kind)}) for kept, kind, more in batch
        ]
        records = reduce(DataFrame.unionByName, parts).withColumn("at", F.lit("0"))
        versions.append(records, f"{folder}/sales", schemas.SALES, "tui", ["at"])
        refresh.refresh(spark, folder, houses_)
    rows = refresh.statistics(spark, folder, b.postcodes(spark, d), LEVELS, registry.supported()).drop("amount")
    return rows.withColumn("period", iso_day("period")).withColumn("value", F.round("value", 4))


def data_id_keys(spark, d):
    levels = extract.postcode_levels(b.postcodes(spark, d), LEVELS)
    areas = levels.select(F.inline("levels")).distinct()
    identity = results.range_id(F.col("area_type"), F.col("area"), START, END)
    always = results.range_id(F.col("area_type"), F.col("area"))
    return areas.select(*KEYS, identity.alias("data_id"), always.alias("open_data_id"))


def stats_requests(spark, d):
    """The request log read as statistic requests: counts per name, and if it exists."""
    wanted = {"view": "mean_price", "click": "sale_volume", "purchase": "median_price", "signup": "count_price"}
    name = F.coalesce(
        *[F.when(F.col("api_route") == r, s) for r, s in wanted.items()], F.col("api_route")
    )
    asked = b.requests(spark, d).groupBy(name.alias("statistic")).agg(F.count(F.lit(1)).alias("requests"))
    listed = registry.catalog(spark).select("statistic", "description")
    return asked.join(listed, "statistic", "left").select(
        "statistic", "requests", F.col("description").isNotNull().alias("supported"), "description"
    )


def stats_requests_rejected(spark, d):
    wanted = F.when(F.col("api_route") == "view", "mean_price").otherwise(F.col("api_route"))
    asked = b.requests(spark, d).withColumn("statistic", wanted)
    return registry.rejected_requests(asked, spark).groupBy("user_id", "statistic").agg(
        F.count(F.lit(1)).alias("requests")
    )


# Houses


def houses_by_postcode(spark, d):
    return houses.houses_by_postcode(b.houses(spark, d))


def house_by_key(spark, d):
    """The house of the highest number, looked up by its key in the stored table."""
    rows, path = b.houses(spark, d), fresh_folder(spark, "houses")
    tables.insert_if_absent(rows, path, "houseid", ["postcode"], schemas.HOUSES)
    key = rows.agg(F.max(F.col("houseid").cast("bigint")).cast("string")).first()[0]
    return store.rows_of_keys(spark, path, schemas.HOUSES, "houseid", [key])


def house_street(spark, d):
    return houses.with_street(b.houses(spark, d), b.postcodes(spark, d))


def house_sales(spark, d):
    rows = houses.newest_first(houses.house_sales(b.houses(spark, d), b.sales(spark, d)))
    return rows.withColumn("date", iso_time("date"))


def linked_epcs(spark, d):
    rows = houses.linked_certificates(b.houses(spark, d), b.uprn_lookup(spark, d), b.certificates(spark, d))
    return rows.withColumns(
        {"lodgement_date": iso_day("lodgement_date"), "total_floor_area": F.col("total_floor_area").cast("double")}
    )


def house_detail(spark, d):
    """Nested house records, their lists written out as text."""
    rows = houses.house_detail(
        b.houses(spark, d), b.postcodes(spark, d), b.sales(spark, d), b.uprn_lookup(spark, d),
        b.certificates(spark, d),
    )

    def sale(s):
        return F.concat_ws(":", s.tui, s.price, F.date_format(s.date, "yyyy-MM-dd"), s.new, s.freehold, s.ppd_cat)

    def epc(e):
        return F.concat_ws(
            ":", e.lmk_key, e.current_energy_rating, e.potential_energy_rating,
            F.date_format(e.lodgement_date, "yyyy-MM-dd"), e.total_floor_area, e.uprn,
        )

    return rows.select(
        "houseid", "year", "paon", "saon", "street", "postcode", "type",
        F.size("previous_sales").alias("n_sales"),
        F.size("linked_epcs").alias("n_epcs"),
        F.array_join(F.transform("previous_sales", sale), "|").alias("sales"),
        F.array_join(F.transform("linked_epcs", epc), "|").alias("epcs"),
    )


# Usage and ledgers


def usage_priced(spark, d):
    return b.usage_events(spark, d).withColumn("timestamp", iso_time("timestamp"))


def usage_window(spark, d):
    rows = usage.usage_window(b.usage_events(spark, d), "2024-01-05", "2024-01-15 12:00:00")
    return usage.in_time_order(rows).withColumn("timestamp", iso_time("timestamp"))


def usage_trends(spark, d):
    rows = usage.usage_trends(b.usage_events(spark, d), "2024-01-03", "2024-01-28")
    return rows.withColumn("date", iso_day("date"))


def usage_summary(spark, d):
    return usage.usage_summary(b.usage_events(spark, d), b.AS_OF, 7, b.users(spark, d))


def top_routes(spark, d):
    return usage.top_routes(b.usage_events(spark, d), b.AS_OF, 30)


def top_routes_overall(spark, d):
    return usage.top_routes(b.usage_events(spark, d), b.AS_OF, 30, keys=())


def current_period_tokens(spark, d):
    rows = usage.current_period_tokens(b.usage_events(spark, d), b.users(spark, d), b.AS_OF)
    return rows.withColumns({"period_start": iso_time("period_start"), "period_end": iso_time("period_end")})


def billing_history(spark, d):
    rows = usage.billing_history(b.ledgers(spark, d), 3)
    return rows.withColumns({"period_start": iso_time("period_start"), "period_end": iso_time("period_end")})


def users_with_usage(spark, d):
    return ledger.users_with_usage(b.users(spark, d), b.usage_events(spark, d), b.CUTOFF)


def ledger_rollup(spark, d):
    rows = ledger.rolled_up(b.usage_events(spark, d), b.CUTOFF, b.AS_OF)
    return rows.withColumns({c: iso_time(c) for c in ("period_start", "period_end", "timestamp")})


def ledgers_listed(spark, d):
    """Ledgers of the listed users: everyone with open usage at the cutoff."""
    events = b.usage_events(spark, d)
    wanted = ledger.unbilled(events, b.CUTOFF).select("user_id")
    rows = ledger.ledgers_of_users(events, b.users(spark, d), wanted, b.CUTOFF)
    return rows.select("id", "user_id", "total_tokens")


def ledger_of_user(spark, d):
    """The ledger of one user, the first with open usage."""
    events = b.usage_events(spark, d)
    user = ledger.unbilled(events, b.CUTOFF).agg(F.min("user_id")).first()[0]
    return ledger.ledger_of_user(events, user, b.CUTOFF).select("id", "user_id", "total_tokens")


def usage_stamped(spark, d):
    rows = ledger.stamped(b.usage_events(spark, d), b.CUTOFF)
    return rows.select("id", "user_id", "tokens", "ledger_id")


def usage_stamped_by_join(spark, d):
    events = b.usage_events(spark, d)
    rows = ledger.stamped_by(events, ledger.rolled_up(events, b.CUTOFF))
    return rows.select("id", "user_id", "tokens", "ledger_id")


def ledger_items(spark, d):
    events = b.usage_events(spark, d)
    rows = ledger.ledger_items(ledger.rolled_up(events, b.CUTOFF), ledger.stamped(events, b.CUTOFF))
    return rows.withColumn("timestamp", iso_time("timestamp"))


def billing_run(spark, d):
    """The whole billing job on stored usage, then each run's ledgers and items."""
    path, folder = fresh_folder(spark, "usage"), fresh_folder(spark, "billing")
    tables.append_usage(b.usage_events(spark, d), path, "load")
    jobs.run_billing(spark, path, folder, b.CUTOFF, b.AS_OF)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    events = tables.read_table(spark, f"{folder}/aggregation_event", schemas.AGGREGATION_EVENTS)
    items = (
        tables.read_usage(spark, path)
        .groupBy("ledger_id")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("item_tokens"))
    )
    return (
        ledger.event_ledgers(events, ledgers)
        .join(items, F.col("id") == F.col("ledger_id"))
        .select("id", F.col("user_id").cast("bigint").alias("user_id"), "total_tokens", "items", "item_tokens")
    )


def usage_settled(spark, d):
    """Usage appended in six batches, billed, and its days settled: totals and files by day."""
    path, folder = fresh_folder(spark, "usage"), fresh_folder(spark, "billing")
    events = staged(b.usage_events(spark, d), "events")
    for k in range(6):
        tables.append_usage(events.filter(F.pmod(F.col("id").cast("bigint"), F.lit(6)) == k), path, f"batch {k}")
    jobs.run_billing(spark, path, folder, b.CUTOFF, b.AS_OF)
    tables.settle_usage(spark, path)
    rows = spark.read.parquet(path).select("day", "tokens", "ledger_id", F.col("_metadata.file_path").alias("file"))
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens"), F.count("ledger_id").alias("billed"),
        F.countDistinct("ledger_id").alias("ledgers"), F.countDistinct("file").alias("files"),
    )


def billing_late_usage(spark, d):
    """Usage billed, more of the same time appended, and billed again at the same cutoff."""
    path, folder = fresh_folder(spark, "usage"), fresh_folder(spark, "billing")
    events = b.usage_events(spark, d)
    late = F.col("id").endswith("7")
    tables.append_usage(events.filter(~late), path, "on time")
    jobs.run_billing(spark, path, folder, b.CUTOFF, b.AS_OF)
    tables.append_usage(events.filter(late), path, "late")
    jobs.run_billing(spark, path, folder, b.CUTOFF, b.AS_OF)
    jobs.run_billing(spark, path, folder, b.CUTOFF, b.AS_OF)
    ledgers = tables.read_table(spark, f"{folder}/billing_ledger", schemas.LEDGERS)
    runs = tables.read_table(spark, f"{folder}/aggregation_event", schemas.AGGREGATION_EVENTS)
    items = (
        tables.read_usage(spark, path)
        .groupBy("ledger_id")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("item_tokens"))
    )
    return (
        ledger.event_ledgers(runs, ledgers)
        .join(items, F.col("id") == F.col("ledger_id"))
        .select(
            "id", F.col("user_id").cast("bigint").alias("user_id"), "total_tokens", "items", "item_tokens",
            (F.col("run_time") >= 0).alias("timed"),
        )
    )


# Sale records


def ppd_normalise(spark, d):
    return normalise.normalised(b.raw_sales(spark, d)).withColumn("date", iso_time("date"))


def ppd_rejects(spark, d):
    _, rejected = normalise.screened(b.raw_sales(spark, d))
    return rejected.select("tui", "postcode", "reason")


def ppd_status_split(spark, d):
    rows = normalise.normalised(b.raw_sales(spark, d))
    added = normalise.additions(rows).withColumn("side", F.lit("additions"))
    deleted = normalise.deletions(rows).withColumn("side", F.lit("deletions"))
    return added.unionByName(deleted).select("tui", "row_class", "side")


def _loaded(spark, d, name: str) -> DataFrame:
    """First rows per key, added to a table that holds the older records already."""
    rows = normalise.additions(normalise.normalised(b.raw_sales(spark, d)))
    schema, key = tables.SALE_TABLES[name], schemas.KEYS[name]

    def first(part: DataFrame) -> DataFrame:
        return normalise.first_per_key(part, key, schema.fieldNames(), tables.FIRST)

    older = F.col("date") < F.lit("1998-01-01").cast("timestamp")
    existing = first(rows.filter(older))
    return normalise.keyed_union(existing, first(rows.filter(~older)), key)


def ppd_upsert_postcodes(spark, d):
    return _loaded(spark, d, "postcodes")


def ppd_upsert_houses(spark, d):
    return _loaded(spark, d, "houses")


def ppd_upsert_sales(spark, d):
    return _loaded(spark, d, "sales").withColumn("date", iso_time("date"))


def ppd_apply_changes(spark, d):
    """Changes and deletions applied to the sales known before them."""
    rows = normalise.normalised(b.raw_sales(spark, d), normalise.INTENDED)
    existing = normalise.relation(rows, schemas.SALES).withColumn("price", F.col("price") - 1000)
    merged = normalise.changes_applied(existing, rows.select(*existing.columns, "row_class"), ["date"])
    return merged.withColumn("date", iso_time("date"))


def keyed_insert_pruned(spark, d):
    """Sales added to a bucketed table: the older ones, then a single one, then all of them, twice."""
    rows, path = staged(normalise.additions(normalise.normalised(b.raw_sales(spark, d))), "sales"), fresh_folder(spark, "sales")
    older = F.col("date") < F.lit("1998-01-01").cast("timestamp")
    one = rows.filter(~older).agg(F.min("tui")).first()[0]
    for batch in (rows.filter(older), rows.filter(F.col("tui") == one), rows, rows):
        tables.insert_if_absent(batch, path, "tui", tables.FIRST, schemas.SALES)
    return tables.read_table(spark, path, schemas.SALES).withColumn("date", iso_time("date"))


def ppd_file_load(spark, d):
    """Records written as a sale file, loaded twice by the load job, read as a table."""
    source, folder = fresh_folder(spark, "sale-file"), fresh_folder(spark, "sale-tables")
    b.raw_sales(spark, d).select(*fixed.SALE_FILE_COLUMNS).write.option("escape", '"').csv(source)
    jobs.load_sales_file(spark, source, folder)
    jobs.load_sales_file(spark, source, folder)
    rows = tables.read_table(spark, f"{folder}/sales", schemas.SALES)
    return rows.withColumn("date", iso_time("date"))


def ppd_stream_ingest(spark, d):
    """Records written as a sale file, loaded by the stream in small batches."""
    source, folder = fresh_folder(spark, "sale-landing"), fresh_folder(spark, "sale-tables")
    b.raw_sales(spark, d).select(*fixed.SALE_FILE_COLUMNS).write.option("escape", '"').csv(source)
    ingest.ingest_sales(
        spark, source, folder, fresh_folder(spark, "ingest"), pattern="*.csv"
    ).awaitTermination()
    rows = tables.read_table(spark, f"{folder}/sales", schemas.SALES)
    return rows.withColumn("date", iso_time("date"))


def _written(rows: DataFrame, folder: str, ordered: Column) -> None:
    """One sale file in the given order."""
    in_order = rows.repartitionByRange(1, ordered).sortWithinPartitions(ordered)
    in_order.select(*fixed.SALE_FILE_COLUMNS).write.option("escape", '"').csv(folder)


def ppd_stream_changes(spark, d):
    """Additions, changes and deletions in five files, a batch each, folded in after every second batch.

    Eight records in a row are records of one sale; a fifth of them is in each file.
    """
    landing, folder = fresh_folder(spark, "sale-landing"), fresh_folder(spark, "sale-tables")
    number = F.expr("cast(substring(tui, 2, length(tui) - 2) as bigint)")
    records = staged(b.raw_sales(spark, d).withColumn("number", number), "records")
    sale = F.concat(F.lit("{"), F.floor(F.col("number") / 8), F.lit("}"))
    for k in range(5):
        _written(records.filter(F.col("number") % 5 == k).withColumn("tui", sale), f"{landing}/{k}", F.col("number"))
    raw = ingest.sale_records(spark, f"{landing}/*", normalise.INTENDED, "*.csv", maxFilesPerTrigger=1)
    ingest.load_stream(raw, folder, fresh_folder(spark, "ingest"), normalise.INTENDED, fold_after=2).awaitTermination()
    return tables.read_sales(spark, folder).withColumn("date", iso_time("date"))


def ppd_stream_dedup(spark, d):
    """Records streamed twice, the second time at a higher price; the state store knows which came before."""
    landing, path = fresh_folder(spark, "sale-landing"), fresh_folder(spark, "sales")
    records = staged(b.raw_sales(spark, d).select(*fixed.SALE_FILE_COLUMNS), "records")
    for k in range(2):
        records.withColumn("price", F.col("price") + k).write.option("escape", '"').csv(f"{landing}/{k}")
    raw = ingest.sale_records(spark, f"{landing}/*", normalise.REFERENCE, "*.csv", maxFilesPerTrigger=1)
    rows = normalise.additions(raw)
    ingest.ingest_first(rows, path, "tui", schemas.SALES, tables.FIRST, fresh_folder(spark, "ingest")).awaitTermination()
    return tables.read_table(spark, path, schemas.SALES).withColumn("date", iso_time("date"))


def snapshot_changed(spark, d):
    """The sales against the state of an earlier load of them."""
    sales = b.sales(spark, d)
    known = state.fingerprint(sales).first()["fingerprint"]
    compared = {
        "same": sales,
        "prices one higher": sales.withColumn("price", F.col("price") + 1),
        "a column null": sales.withColumn("ppd_cat", F.lit(None).cast("string")),
    }
    found = [state.changed(rows, known).withColumn("against", F.lit(name)) for name, rows in compared.items()]
    return reduce(DataFrame.unionByName, found).select("against", "rows", "changed")


def snapshot_parts(spark, d):
    """The years in which two snapshots of the sales differ, from fingerprints by year, with the sales to read again."""
    sales = b.sales(spark, d)
    year = F.year("date")
    before = staged(state.part_fingerprints(sales.filter(year != 1998), year), "parts")
    dearer = F.when(year.isin(1993, 1995) & F.col("tui").endswith("0"), 1).otherwise(0)
    now = sales.filter(year != 1996).withColumn("price", F.col("price") + dearer)
    parts = staged(state.part_fingerprints(now, year), "parts")
    again = now.groupBy(year.alias("part")).agg(F.count(F.lit(1)).alias("sales"))
    whole = (state.of_parts(parts).first() == state.fingerprint(now).first(), state.of_parts(parts).first() != state.of_parts(before).first())
    return state.changed_parts(before, parts).join(again, "part", "left").select(
        "part", "change", "sales", F.lit(whole[0]).alias("adds_up"), F.lit(whole[1]).alias("differs")
    )


# Certificates


def epc_typed(spark, d):
    return _shown(certificates.typed(b.raw_certificates(spark, d)))


def _shown(rows: DataFrame) -> DataFrame:
    """Decimals as doubles, dates and times as text."""
    shown = {}
    for field in rows.schema:
        kind = field.dataType.simpleString()
        if kind.startswith("decimal"):
            shown[field.name] = F.col(field.name).cast("double")
        elif kind == "date":
            shown[field.name] = F.col(field.name).cast("string")
        elif kind == "timestamp":
            shown[field.name] = iso_time(field.name)
    return rows.withColumns(shown)


def _extracts(rows: DataFrame, folder: str) -> None:
    """Certificate extracts below a folder, one file in each of its folders, as the archive has them."""
    spark, written = rows.sparkSession, f"{folder}-written"
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(written)
    store.spread(spark, written, folder, ".csv", fixed.CERTIFICATE_FILE)


def epc_file_load(spark, d):
    """Certificates written as extracts of two header orders, one with a column more, and loaded twice."""
    source, folder = fresh_folder(spark, "epc-extracts"), fresh_folder(spark, "epc-tables")
    raw = b.raw_certificates(spark, d)
    odd = F.pmod(F.xxhash64("LMK_KEY"), F.lit(2)) == 1
    _extracts(raw.filter(odd), f"{source}/one")
    _extracts(raw.filter(~odd).select(F.lit("x").alias("EXTRA"), *raw.columns[::-1]), f"{source}/two")
    for _ in range(2):
        jobs.load_certificate_files(spark, source, folder)
    schema = certificates.typed(raw).schema
    return _shown(tables.read_table(spark, f"{folder}/certificates", schema))


def load_skipped(spark, d):
    """A sale file loaded, offered again, and offered once more with further records."""
    source, folder = fresh_folder(spark, "sale-file"), fresh_folder(spark, "sale-tables")
    records = b.raw_sales(spark, d).select(*fixed.SALE_FILE_COLUMNS)
    part = F.substring("tui", -2, 1).isin("1", "2", "3", "4", "5")
    for name, rows in (("part", records.filter(part)), ("whole", records)):
        rows.write.option("escape", '"').csv(f"{source}/{name}")
    steps = []
    for step, name in (("first", "part"), ("again", "part"), ("more", "whole"), ("more again", "whole")):
        loaded = jobs.load_sales_file(spark, f"{source}/{name}", folder)
        known = state.read_state(spark, f"{folder}/state").first()["last_ppd_file"]
        row = tables.read_sales(spark, folder).agg(F.count(F.lit(1)).alias("sales"))
        steps.append(staged(row.select(F.lit(step).alias("step"), F.lit(loaded).alias("loaded"), F.lit(known != "").alias("noted"), "sales"), "steps"))
    return reduce(DataFrame.unionByName, steps)


def record_flags(spark, d):
    """Yes and no of the sale records; a text that is neither is unknown."""
    flags = {c: text.yes_no(F.col(c)) for c in ("new_build", "duration")}
    return b.raw_sales(spark, d).select("tui", *[flag.alias(c) for c, flag in flags.items()])


def epc_upsert(spark, d):
    """Certificates added by key to a table that holds a part of them."""
    rows = certificates.typed(b.raw_certificates(spark, d))
    known = rows.filter(F.col("current_energy_rating") == "A").withColumn("tenure", F.lit("known"))
    first = normalise.first_per_key(rows, "lmk_key", rows.columns, ["lodgement_date"])
    return normalise.keyed_union(known, first, "lmk_key").select(
        "lmk_key", "current_energy_rating", "current_energy_efficiency", "tenure", "uprn"
    )


# Streams of usage


def usage_stream_daily(spark, d):
    """Daily totals kept by a stream, as the last batch of each day left them."""
    path = fresh_folder(spark, "daily")
    totals = ingest.daily_totals(b.usage_events(spark, d, stream=True))
    ingest.keep_daily_totals(totals, path, fresh_folder(spark, "daily-checkpoint")).awaitTermination()
    return ingest.latest_daily_totals(spark, path).withColumn("date", iso_day("date"))


def usage_stream_append(spark, d):
    """Usage appended by a stream, read back per user."""
    path = fresh_folder(spark, "usage")
    events = b.usage_events(spark, d, stream=True)
    ingest.ingest_usage(events, path, fresh_folder(spark, "usage-checkpoint")).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens")
    )


def _delivered(spark, d) -> tuple[DataFrame, Column]:
    """Usage with the delivery it comes in: eight days each, some events one or two deliveries late."""
    events = staged(b.usage_events(spark, d), "events")
    own = F.floor(F.datediff("timestamp", F.lit("2024-01-01").cast("date")) / 8)
    late = F.when(F.col("id").endswith("7"), 1).when(F.col("id").endswith("3"), 2).otherwise(0)
    return events, F.least(own + late, F.lit(3))


def usage_stream_windowed(spark, d):
    """Daily totals of a stream in four deliveries with restarts; what comes after the watermark is counted aside.

    Totals come as updates, a day is closed once the append output has it.
    """
    landing, folder = fresh_folder(spark, "usage-landing"), fresh_folder(spark, "windows")
    events, delivery = _delivered(spark, d)
    for k in range(4):
        events.filter(delivery == k).write.parquet(f"{landing}/{k}")
        usage_ = spark.readStream.schema(events.schema).parquet(f"{landing}/*")
        for mode in ("update", "append"):
            totals = ingest.windowed_totals(usage_, "2 days")
            ingest.keep_windows(totals, f"{folder}/{mode}", f"{folder}/{mode}-state", mode).awaitTermination()
    usage_ = spark.readStream.schema(events.schema).parquet(f"{landing}/*")
    ingest.keep_daily_totals(ingest.daily_totals(usage_), f"{folder}/all", f"{folder}/all-state").awaitTermination()
    rows = ingest.with_late(
        ingest.latest_daily_totals(spark, f"{folder}/all"), ingest.latest_windows(spark, f"{folder}/update"),
        ingest.closed_windows(spark, f"{folder}/append"),
    )
    return rows.withColumn("date", iso_day("date"))


REGISTERED: dict[str, Query] = {
    query.__name__: query
    for query in (
        sales_extract, sales_of_area,
        mean_price, std_house_price, most_expensive_sale, count_house_types, avg_house_tenancy,
        count_price, count_price_wide, sale_volume, pct_change_price, stats_bundle, frame_statistics, area_statistics,
        sale_gaps, stats_nested, stats_report, stats_store, stats_cached, stats_refreshed, data_id_keys, stats_requests, stats_requests_rejected,
        houses_by_postcode, house_by_key, house_street, house_sales, linked_epcs, house_detail,
        usage_priced, usage_window, usage_trends, usage_summary, top_routes, top_routes_overall,
        current_period_tokens, billing_history, users_with_usage,
        ledger_rollup, ledgers_listed, ledger_of_user, usage_stamped, usage_stamped_by_join, ledger_items, billing_run, billing_late_usage, usage_settled,
        ppd_normalise, ppd_rejects, ppd_status_split,
        ppd_upsert_postcodes, ppd_upsert_houses, ppd_upsert_sales, ppd_apply_changes,
        keyed_insert_pruned, ppd_file_load, ppd_stream_ingest, ppd_stream_changes, ppd_stream_dedup, snapshot_changed, snapshot_parts,
        epc_typed, epc_upsert, epc_file_load, load_skipped, record_flags,
        usage_stream_daily, usage_stream_windowed, usage_stream_append,
    )
}
