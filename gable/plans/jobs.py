"""Whole jobs: loading, billing, and keeping rollups."""

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import schemas
from gable.operators import certificates, ledger, normalise, registry, rollups, stats
from gable.functions.temporal import moment
from gable.operators.extract import postcode_sales
from gable.session import require_utc, staged
from gable.sources import files, state, tables, versions

AREA_KEYS = ("area_type", "area")


def load_sales_file(
    spark: SparkSession, source: str, folder: str, mode: str = normalise.REFERENCE
) -> bool:
    """Load a sale file unless it is the one loaded last; tells whether it was new."""
    require_utc(spark)
    raw = files.read_sales(spark, source)
    known = state.read_state(spark, f"{folder}/state").first()["last_ppd_file"]
    found = state.changed(raw, known).first()
    if not found["changed"]:
        return False
    if mode == normalise.INTENDED:
        apply_sales_changes(normalise.normalised(files.in_load_order(raw), mode), folder)
    else:
        tables.load_sales(normalise.normalised(raw, mode), folder)
    state.sales_loaded(spark, f"{folder}/state", found["fingerprint"], datetime.now(timezone.utc))
    return True


def apply_sales_changes(rows: DataFrame, folder: str, fold: bool = True) -> None:
    """Keyed inserts for postcodes and houses; sales also change and disappear.

    Records apply in their `load_order`, or by date where the rows don't have one: an
    addition fills a gap, a change replaces, a deletion removes. The batch goes to the log
    of sales; with `fold` it is folded into the buckets it touches, else that is left to a
    later `fold_sales_changes`, and readers resolve it meanwhile.
    """
    spark = rows.sparkSession
    rows = staged(rows, "normalised-sales")
    for name in ("postcodes", "houses"):
        tables.insert_if_absent(
            normalise.additions(rows), f"{folder}/{name}", schemas.KEYS[name], tables.FIRST,
            tables.SALE_TABLES[name],
        )
    # By date as text of one length, which sorts as the dates do.
    order = [f"load_order.{c}" for c in files.ORDER] if "load_order" in rows.columns else ["_date"]
    dated = rows.withColumn("_date", F.date_format("date", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    versions.append(dated, f"{folder}/sales", schemas.SALES, schemas.KEYS["sales"], order)
    if fold:
        fold_sales_changes(spark, folder)


def fold_sales_changes(spark: SparkSession, folder: str) -> list[int]:
    """Fold the waiting changes of sales into their buckets; returns the buckets."""
    return versions.fold(spark, f"{folder}/sales", schemas.SALES, schemas.KEYS["sales"])


def load_certificate_files(
    spark: SparkSession, source: str, folder: str, mode: str = normalise.REFERENCE
) -> None:
    tables.load_certificates(certificates.typed(files.read_certificates(spark, source), mode), folder)


def run_billing(spark: SparkSession, usage_path: str, folder: str, upto, as_of=None) -> DataFrame:
    """Ledgers for everyone, their usage linked to them, and the record of the run.

    The events of a run are taken once and written down; ledgers and links both come
    from that list, so every event is in the total of the ledger it is linked to.
    Events that arrive later are open for the next run, which at the same cutoff has
    ledgers and a record of its own. A run cut off by a failure is finished from its
    list by the next call, before that looks for events of its own. Billing writes links
    beside the usage and leaves the usage alone; `tables.settle_usage` stamps whole days
    later.
    """
    require_utc(spark)
    started = datetime.now(timezone.utc)
    tables.finish_replace(spark, usage_path, tables.USAGE_LAYOUT)
    records = tables.read_table(spark, f"{folder}/aggregation_event", schemas.AGGREGATION_EVENTS)
    run = ledger.next_run(records, upto)
    resumed = _bill(spark, usage_path, folder, upto, as_of, run, started, new=False)
    if resumed:
        run, started = run + 1, datetime.now(timezone.utc)
    billed = _bill(spark, usage_path, folder, upto, as_of, run, started, new=True)
    return _record(spark, f"{folder}/aggregation_event", upto, run if billed else run - 1)


def _record(spark: SparkSession, path: str, upto, run: int) -> DataFrame:
    known = tables.read_table(spark, path, schemas.AGGREGATION_EVENTS)
    return known.filter(F.col("id") == ledger.event_id(upto, run))


def _bill(spark, usage_path: str, folder: str, upto, as_of, run: int, started: datetime, new: bool) -> bool:
    """One run from its list; without `new` only one that has a list already. Tells whether it ran.

    The first run at a cutoff is recorded even if it finds nothing.
    """
    micros = int(spark.range(1).select(F.unix_micros(moment(upto))).first()[0])
    path = f"{folder}/billing_items/{micros}-{run}"
    tables.finish_replace(spark, path)
    items = tables.read_table(spark, path, schemas.RUN_ITEMS)
    if items.isEmpty():
        if not new:
            return False
        found = ledger.run_items(tables.read_usage(spark, usage_path), upto, run)
        if run and found.isEmpty():
            return False
        tables.replace_rows(found.select(*[found[f.name].cast(f.dataType) for f in schemas.RUN_ITEMS]), path)
        items = tables.read_table(spark, path, schemas.RUN_ITEMS)
    tables.insert_if_absent(
        ledger.rolled_up(items, upto, as_of, run), f"{folder}/billing_ledger", "id", ["period_end"],
        schemas.LEDGERS,
    )
    tables.link_usage(items, usage_path, f"{micros}-{run}")
    event = ledger.aggregation_event(spark, upto, started, datetime.now(timezone.utc), run)
    tables.insert_if_absent(
        event, f"{folder}/aggregation_event", "id", ["timestamp"], schemas.AGGREGATION_EVENTS
    )
    return True


def monthly_rollup(
    postcodes: DataFrame, houses: DataFrame, sales: DataFrame, area_types: Sequence[str], start=None, end=None
) -> DataFrame:
    """(area_type, area, type, month) sums, all levels from one pass over sales."""
    require_utc(sales.sparkSession)
    by_postcode = rollups.price_rollup(postcode_sales(houses, sales, start, end), ["postcode"], by_month=True)
    return rollups.to_areas(by_postcode, postcodes, area_types, rollups.MEASURES, "month")


def price_rollup(
    postcodes: DataFrame, houses: DataFrame, sales: DataFrame, area_types: Sequence[str], start=None, end=None
) -> DataFrame:
    """(area_type, area, type) sums over the whole range, the row of all types included."""
    by_postcode = rollups.price_rollup(postcode_sales(houses, sales, start, end), ["postcode"])
    return rollups.to_areas(by_postcode, postcodes, area_types, rollups.MEASURES, total=True)


def span_rollup(
    postcodes: DataFrame, houses: DataFrame, sales: DataFrame, area_types: Sequence[str], start=None, end=None
) -> DataFrame:
    """(area_type, area, type) houses and gaps, the row of all types included."""
    by_postcode = rollups.span_rollup_of_tables(houses, sales, start, end)
    return rollups.to_areas(by_postcode, postcodes, area_types, rollups.SPANS, total=True)


def statistics(
    names: Sequence[str],
    postcodes: DataFrame,
    houses: DataFrame,
    sales: DataFrame,
    area_types: Sequence[str],
    start=None,
    end=None,
) -> DataFrame:
    """The named statistics for every area as long rows, planned together.

    What they need is merged into one rollup of prices and one of houses, so sales are
    read and summed once for each of the two, however many statistics are asked for.
    """
    tables_ = (postcodes, houses, sales, area_types, start, end)
    kinds = {s.kind for s in registry.lookup(names)}
    monthly = monthly_rollup(*tables_) if kinds & {registry.PRICES, registry.MONTHS} else None
    return stats.together(names, monthly, span_rollup(*tables_) if registry.SPANS in kinds else None, AREA_KEYS)


def all_statistics(
    postcodes: DataFrame, houses: DataFrame, sales: DataFrame, area_types: Sequence[str], start=None, end=None
) -> DataFrame:
    """The eight statistics for every area of every level, as long rows."""
    tables_ = (postcodes, houses, sales, area_types, start, end)
    return stats.bundle(monthly_rollup(*tables_), span_rollup(*tables_), AREA_KEYS)
