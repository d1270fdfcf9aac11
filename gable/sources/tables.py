"""Table sinks: keyed inserts into bucketed tables, usage by day, and the layout of sales."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from gable import schemas
from gable.operators import normalise
from gable.session import discard, staged
from gable.sources import store, versions
from gable.sources.store import finish_replace, read_table, replace_rows

SALE_TABLES = {
    "postcodes": schemas.POSTCODES, "houses": schemas.HOUSES, "sales": schemas.SALES,
}
FIRST = ["date", "tui"]
USAGE_LAYOUT = ("day",)
_USAGE_IDS = StructType(
    [StructField("id", StringType()), StructField("day", DateType()), StructField("batch", StringType())]
)
LINK_LAYOUT = ("day", "run")
_LINKS = StructType(
    [StructField("id", StringType()), StructField("run_ledger", StringType()), StructField("day", DateType()), StructField("run", StringType())]
)
#: Days of several files that are smaller than this on average are rewritten.
SMALL_FILE_BYTES = 16 << 20


def insert_if_absent(
    rows: DataFrame, path: str, key: str, order: list[str], schema: StructType, buckets: int = store.BUCKETS
) -> None:
    """Append the first row of every key the table does not hold yet.

    Of the table only the keys in the buckets of these rows are read. Running it again
    with the same rows adds nothing, so a failed job can simply be repeated. One writer
    per table at a time.
    """
    spark = rows.sparkSession
    finish_replace(spark, path, key=key)
    columns = schema.fieldNames()
    rows = rows.withColumns({f.name: rows[f.name].cast(f.dataType) for f in schema})
    first = normalise.first_per_key(rows, key, columns, order)
    buckets = store.layout(spark, path, key, buckets)
    if store.exists(spark, path):
        first = normalise.absent(first, known_keys(rows, path, key, schema, buckets), key)
    store.write_buckets(first, path, key, buckets)


def insert_wide_if_absent(
    rows: DataFrame, path: str, key: str, order: list[str], schema: StructType, buckets: int = store.BUCKETS
) -> None:
    """`insert_if_absent` for wide rows that are cheap to read again and whose keys seldom repeat.

    The keys are counted first, alone. Rows whose keys are all known go no further; of the others,
    those that have their key for themselves are written as they come, and only rows that share a
    key are compared.
    """
    spark = rows.sparkSession
    finish_replace(spark, path, key=key)
    columns = schema.fieldNames()
    rows = rows.withColumns({f.name: rows[f.name].cast(f.dataType) for f in schema}).select(*columns)
    keys = staged(rows.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_several")), "keys")
    buckets = store.layout(spark, path, key, buckets)
    if store.exists(spark, path):
        new = staged(normalise.absent(keys, known_keys(keys, path, key, schema, buckets), key), "keys")
        if new.isEmpty():
            discard(keys, new)
            return
        if new.count() < keys.count():
            rows = rows.join(new.select(F.col(key).alias("_key")), F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        discard(keys)
        keys = new
    several = keys.where("_several").select(F.col(key).alias("_key"))
    if not several.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_key"))
        shared = normalise.first_per_key(rows.join(several, same, "left_semi"), key, columns, order)
        rows = rows.join(several, same, "left_anti").unionByName(shared)
    store.write_buckets(rows, path, key, buckets)
    discard(keys)


def known_keys(rows: DataFrame, path: str, key: str, schema: StructType, buckets: int) -> DataFrame:
    """The keys of the table in the buckets of the given rows."""
    table = store.read_buckets(rows.sparkSession, path, StructType([schema[key]]))
    return store.only(table, store.touched(rows, key, buckets), buckets).select(key)


def read_sales(spark: SparkSession, folder: str) -> DataFrame:
    """The sales in force, whether or not changes are waiting to be folded in."""
    return versions.current(spark, f"{folder}/sales", schemas.SALES, schemas.KEYS["sales"])


def load_sales(rows: DataFrame, folder: str) -> None:
    """Normalised rows into postcodes, then houses, then sales.

    The rows are written once to the shared folder and read three times, each
    time only the columns of that table.
    """
    rows = staged(normalise.additions(rows), "normalised-sales")
    for name, schema in SALE_TABLES.items():
        insert_if_absent(rows, f"{folder}/{name}", schemas.KEYS[name], FIRST, schema)


def load_certificates(typed: DataFrame, folder: str) -> None:
    """Typed certificates, the first of each key."""
    insert_wide_if_absent(
        typed, f"{folder}/certificates", schemas.KEYS["certificates"], ["lodgement_date"], typed.schema
    )


def append_usage(usage: DataFrame, path: str, batch: str) -> None:
    """Append usage events by day, so time ranges skip files; each row knows its batch.

    A batch repeated under its name after a failure adds only what is missing. The check
    opens the batch's days only, and there the row groups that can hold its name.
    """
    spark = usage.sparkSession
    finish_replace(spark, path, USAGE_LAYOUT)
    rows = usage.withColumns({"day": F.to_date("timestamp"), "batch": F.lit(batch)})
    if store.exists(spark, path):
        days = [r["day"] for r in rows.select("day").distinct().collect()]
        known = read_table(spark, path, _USAGE_IDS).filter((F.col("batch") == batch) & F.col("day").isin(days))
        rows = normalise.absent(rows, known, "id")
    # A day's rows of one batch share a file, or some files where they are many.
    rows.hint("rebalance", F.col("day")).write.mode("append").partitionBy(*USAGE_LAYOUT).parquet(path)


def link_usage(items: DataFrame, path: str, run: str) -> None:
    """Note which ledger billed each event, beside the usage, by day and run; repeating a run replaces its notes."""
    rows = items.select("id", "run_ledger", "day", F.lit(run).alias("run"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LINK_LAYOUT).parquet(f"{path}-links")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """The usage with the ledger of each event, whether stamped in its day or linked since.

    Days without links are read as they are, without a join.
    """
    usage = spark.read.parquet(path)
    links = read_table(spark, f"{path}-links", _LINKS)
    days = [r["day"] for r in links.select("day").distinct().collect()]
    if not days:
        return usage
    linked = F.col("day").isin(days)
    mine = links.select(F.col("id").alias("_item"), F.col("day").alias("_day"), "run_ledger")
    met = usage.where(linked).join(mine, (F.col("id") == F.col("_item")) & (F.col("day") == F.col("_day")), "left")
    stamped = met.withColumn("ledger_id", F.coalesce("ledger_id", "run_ledger")).drop("_item", "_day", "run_ledger")
    return usage.where(~F.coalesce(linked, F.lit(False))).unionByName(stamped)


def days_to_settle(spark: SparkSession, path: str, before=None, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """Days that have links, or several small files: day, files, bytes, linked. From file sizes alone."""
    usage = spark.read.parquet(path)
    files = usage.select("day", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    sizes = files.groupBy("day").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    links = read_table(spark, f"{path}-links", _LINKS).select("day").distinct().withColumn("linked", F.lit(True))
    found = sizes.join(links, "day", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
    wanted = F.col("linked") | ((F.col("files") > 1) & (F.col("bytes") / F.col("files") < small_bytes))
    return found.where(wanted if before is None else wanted & (F.col("day") < F.lit(before).cast("date")))


def settle_usage(spark: SparkSession, path: str, before=None, small_bytes: int = SMALL_FILE_BYTES) -> list[date]:
    """Rewrite days into few files with their ledgers stamped, and drop the links; returns the days.

    Only days before the given date, by which their usage should be complete, and of these
    only those that need it. Billing may come before or after, as it goes by event and
    day, but like all writers not meanwhile. Cut off at any point, it can be repeated.
    """
    finish_replace(spark, path, USAGE_LAYOUT)
    plan = {r["day"]: r["linked"] for r in days_to_settle(spark, path, before, small_bytes).collect()}
    if plan:
        replace_rows(read_usage(spark, path).filter(F.col("day").isin(list(plan))), path, USAGE_LAYOUT)
    for day in plan:
        if plan[day]:
            store.remove(spark, f"{path}-links/day={day}")
    return sorted(plan)


def save_sales_by_year(sales: DataFrame, path: str) -> None:
    """Save sales by year, sorted by date inside a file, so a range skips the rest.

    Rows of a year are spread over a range of dates, so a busy year is not one task.
    """
    years = sales.withColumn("year", F.year("date"))
    (
        years.repartitionByRange("date", "tui")
        .sortWithinPartitions("year", "date")
        .write.mode("overwrite")
        .partitionBy("year")
        .parquet(path)
    )
