"""Streams: sale files into tables, usage events into a table and daily totals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from gable.operators import normalise
from gable.plans import jobs
from gable.session import require_utc
from gable.sources import tables
from gable.sources.files import placed, stream_sales


def ingest_sales(
    spark: SparkSession,
    landing: str,
    folder: str,
    checkpoint: str,
    mode: str = normalise.REFERENCE,
    pattern: str = "*",
    **options,
) -> StreamingQuery:
    """Load every sale file that is new in the landing folder, then stop.

    The checkpoint remembers the files; a batch repeated after a failure adds
    nothing, because the tables are keyed.
    """
    return load_stream(sale_records(spark, landing, mode, pattern, **options), folder, checkpoint, mode)


def sale_records(spark: SparkSession, landing: str, mode: str = normalise.REFERENCE, pattern: str = "*", **options) -> DataFrame:
    """Normalised records of the sale files of a folder as a stream, with the `file` and `block` they come from."""
    require_utc(spark)
    raw = stream_sales(spark, landing, pattern, **options)
    of_file = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = normalise.normalised(raw.withColumn("load_order", of_file), mode)
    return rows.select("*", "load_order.*").drop("load_order")


#: Batches of changes that wait before they are folded into their buckets.
FOLD_AFTER = 8


def load_stream(rows: DataFrame, folder: str, checkpoint: str, mode: str = normalise.REFERENCE, fold_after: int = FOLD_AFTER) -> StreamingQuery:
    """Normalised rows of a stream into the keyed tables, batch by batch.

    In `intended` mode changes and deletions of a batch go to the log of the sales, which
    is folded into the buckets it touches after so many batches; a batch reads no sales.
    """

    def load(batch: DataFrame, number: int) -> None:
        if mode == normalise.INTENDED:
            jobs.apply_sales_changes(placed(batch).drop("file", "block"), folder, fold=(number + 1) % fold_after == 0)
        else:
            tables.load_sales(batch.drop("file", "block"), folder)

    return (
        rows.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def with_new_keys(rows: DataFrame, key: str) -> DataFrame:
    """The rows of a stream, and for each key that no earlier batch had one more row, with `_new`.

    Which keys came before is kept in the state store, a flag for each, by Spark's own deduplication.
    """
    new = rows.select(key).dropDuplicates([key]).withColumn("_new", F.lit(True))
    return rows.withColumn("_new", F.lit(False)).unionByName(new, allowMissingColumns=True)


def first_of_new(batch: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """Of a batch of `with_new_keys` the first row of each new key, by the given order and then the other columns.

    Spark's own deduplication would keep any of the batch's rows, hence the order. A minimum, so
    that each task keeps one row of a key.
    """
    rest = [*order, *[c for c in columns if c not in (key, *order)]]
    first = F.min(F.when(~F.col("_new"), F.struct(*rest))).alias("_first")
    found = batch.groupBy(key).agg(first, F.max("_new").alias("_new")).where("_new")
    return found.select(key, "_first.*").select(*columns)


def ingest_first(rows: DataFrame, path: str, key: str, schema: StructType, order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the first row of each key of a stream, in a folder a batch that repeating the batch overwrites.

    Of a key's first batch the first row by `order` stays. The table is never read. `rows` need
    the columns of the schema.
    """
    require_utc(rows.sparkSession)
    columns = schema.fieldNames()

    def write(batch: DataFrame, number: int) -> None:
        first_of_new(batch, key, columns, [c for c in order if c != key]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        with_new_keys(rows.select(*columns), key)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def ingest_usage(usage: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Append usage events to a table by day, each exactly once.

    Batches go through the keyed append rather than the file sink, whose log
    would hide the files that billing rewrites.
    """

    require_utc(usage.sparkSession)

    def append(batch: DataFrame, number: int) -> None:
        tables.append_usage(batch, path, f"{name}-{number}")

    return (
        usage.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_totals(usage: DataFrame) -> DataFrame:
    """Streaming tokens and requests per day.

    Without a watermark, so late events still count; the state is one row per
    day and stays small.
    """
    return usage.groupBy(F.to_date("timestamp").alias("date")).agg(
        F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests")
    )


def keep_daily_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the days each batch changed.

    A batch owns its folder and overwrites it, so repeating one is harmless.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        totals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )


def latest_daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """Each day as its last batch left it."""
    last = F.max(F.struct("batch", "tokens", "requests")).alias("last")
    return (
        spark.read.parquet(path).groupBy("date").agg(last).select("date", "last.tokens", "last.requests")
    )


def windowed_totals(usage: DataFrame, delay: str, every: str = "1 day") -> DataFrame:
    """Streaming tokens and requests per window of event time, for events no later than `delay`.

    A window closes when the newest event is `delay` past its end. Then its state goes, and
    events that still come for it are left out.
    """
    window = F.window("timestamp", every)
    sums = usage.withWatermark("timestamp", delay).groupBy(window).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("requests"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "tokens", "requests")


def keep_windows(totals: DataFrame, path: str, checkpoint: str, output: str) -> StreamingQuery:
    """Write windows in a folder a batch: as they change with `update`, once they closed with `append`."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        totals.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode(output)
        .trigger(availableNow=True)
        .start()
    )


def latest_windows(spark: SparkSession, path: str) -> DataFrame:
    """Each window as its last update left it."""
    last = F.max(F.struct("batch", "tokens", "requests")).alias("last")
    return spark.read.parquet(path).groupBy("start", "end").agg(last).select("start", "end", "last.tokens", "last.requests")


def closed_windows(spark: SparkSession, path: str) -> DataFrame:
    """The windows that closed; each was written once."""
    return spark.read.parquet(path).select("start", "end", "tokens", "requests")


def with_late(everything: DataFrame, in_time: DataFrame, closed: DataFrame) -> DataFrame:
    """Daily totals of events in time, beside them those that came too late, and whether the day closed.

    `everything` are totals without a watermark; what they have more came late.
    """
    zero = F.lit(0).cast("bigint")
    kept = in_time.select(F.to_date("start").alias("date"), F.col("tokens").alias("_tokens"), F.col("requests").alias("_requests"))
    done = closed.select(F.to_date("start").alias("date"), F.lit(True).alias("closed"))
    tokens, requests = F.coalesce("_tokens", zero), F.coalesce("_requests", zero)
    return everything.join(kept, "date", "left").join(done, "date", "left").select(
        "date",
        tokens.alias("tokens"),
        requests.alias("requests"),
        (F.col("tokens") - tokens).alias("late_tokens"),
        (F.col("requests") - requests).alias("late_requests"),
        F.coalesce("closed", F.lit(False)).alias("closed"),
    )
