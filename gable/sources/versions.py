"""A keyed table that changes: buckets of current rows, and a log of records not folded in yet.

Records are additions, changes and deletions in an order. An addition fills a gap, a
change replaces, a deletion removes. A batch is written to the log as it comes and
touches nothing else. Readers resolve the log over the buckets it touches and read the
others as they are. Folding resolves the touched buckets once, replaces them, and drops
the log; the files of other buckets stay. Repeating a batch or a fold that was cut off
gives the same rows, because records resolve by their order, not by when they came.

Deletion marks stay in their bucket, so that a bucket whose keys all went is replaced too.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from gable.operators.normalise import ADD, DELETE
from gable.sources import store

#: Place of a record: its batch, then the order inside the batch as text and number.
ORDER = StructType([StructField("batch", LongType()), StructField("file", StringType()), StructField("block", LongType()), StructField("place", LongType())])
_VERSION = [StructField("row_class", StringType()), StructField("load_order", ORDER)]
_FOLDED = StructType([StructField("upto", LongType())])
_BATCH = StructField("batch", LongType())


def _versioned(schema: StructType) -> StructType:
    return StructType([*schema.fields, *_VERSION])


def resolved(records: DataFrame, key: str) -> DataFrame:
    """One record a key: the one in force after all of its records, or a deletion mark.

    What counts is the last change or deletion of a key, or after a deletion, or without
    either, the first addition.
    """
    columns = records.columns
    of_key = Window.partitionBy(key)
    last = F.max(F.when(F.col("row_class") != ADD, F.col("load_order"))).over(of_key)
    since = records.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("load_order") >= F.col("_last")))
    rest = [c for c in columns if c not in (key, "load_order")]
    first = since.groupBy(key).agg(F.min(F.struct((F.col("row_class") == DELETE).alias("gone"), "load_order", *rest)).alias("r"))
    return first.select(*[F.col(key) if c == key else F.col("r")[c].alias(c) for c in columns])


def _state(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame, int]:
    """Base rows with their bucket, log rows that are not folded in, and the last folded batch."""
    upto = store.read_table(spark, f"{path}-folded", _FOLDED).first()
    upto = -1 if upto is None else upto["upto"]
    bucketed = StructField(store.BUCKET, IntegerType())
    base = store.read_table(spark, path, StructType([*_versioned(schema).fields, bucketed]))
    base = base.withColumn("row_class", F.coalesce("row_class", F.lit(ADD)))
    log = store.read_table(spark, f"{path}-log", StructType([*_versioned(schema).fields, _BATCH, bucketed]))
    return base, log.where(F.col("batch") > upto), upto


def append(records: DataFrame, path: str, schema: StructType, key: str, order: list[str], buckets: int = store.BUCKETS) -> int:
    """Write a batch of records to the log and return its number; the table itself is not read.

    Of each key only the records that can matter later are kept: one, and after a
    deletion the addition that follows it.
    """
    spark = records.sparkSession
    n = store.layout(spark, path, key, buckets)
    _, log, upto = _state(spark, path, schema)
    last = log.agg(F.max("batch")).first()[0]
    batch = max(upto, -1 if last is None else last) + 1
    fields = {f.name: F.col(f.name).cast(f.dataType) for f in schema}
    place = [F.col(order[i]) if i < len(order) else F.lit(None) for i in range(3)]
    at = F.struct(F.lit(batch), *place).cast(ORDER).alias("load_order")
    rows = records.select(*[c.alias(f) for f, c in fields.items()], "row_class", at)
    few = _shortened(rows, key).withColumn(store.BUCKET, store.bucket_of(key, n))
    few.hint("rebalance", F.col(store.BUCKET)).write.mode("overwrite").partitionBy(store.BUCKET).parquet(f"{path}-log/batch={batch}")
    return batch


def _shortened(rows: DataFrame, key: str) -> DataFrame:
    """The records of one batch that still matter after it: see `resolved`."""
    ends = resolved(rows, key)
    # An addition that counts because a deletion stands before it needs that deletion too.
    gone = rows.where(F.col("row_class") == DELETE).groupBy(key).agg(F.max("load_order").alias("load_order"))
    marks = gone.join(ends.where(F.col("row_class") == ADD).select(key, F.col("load_order").alias("_added")), key)
    marks = marks.where(F.col("load_order") < F.col("_added"))
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in (key, "load_order", "row_class")}
    deleted = marks.select(*[empty[c] if c in empty else F.lit(DELETE).alias(c) if c == "row_class" else F.col(c) for c in rows.columns])
    return ends.unionByName(deleted)


def current(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """The rows in force. Only buckets with records in the log are resolved."""
    base, log, _ = _state(spark, path, schema)
    names = _versioned(schema).fieldNames()
    places = _places(log)
    if not places:
        rows = base.select(*names)
    else:
        open_ = F.col(store.BUCKET).isin(places)
        mixed = base.where(open_).select(*names).unionByName(log.select(*names))
        rows = base.where(~open_).select(*names).unionByName(resolved(mixed, key))
    return rows.where(F.col("row_class") != DELETE).select(*schema.fieldNames())


def _places(log: DataFrame) -> list[int]:
    """Buckets with records in the log: a list no longer than the number of buckets."""
    return sorted(r[0] for r in log.select(store.BUCKET).distinct().collect())


def fold(spark: SparkSession, path: str, schema: StructType, key: str, upto: int | None = None) -> list[int]:
    """Fold the log, or its batches up to a number, into the buckets it touches; returns those buckets."""
    store.finish_replace(spark, path, key=key)
    base, log, _ = _state(spark, path, schema)
    if upto is not None:
        log = log.where(F.col("batch") <= upto)
    listed, places = sorted(r[0] for r in log.select("batch").distinct().collect()), _places(log)
    if not places:
        return []
    names = _versioned(schema).fieldNames()
    mixed = base.where(F.col(store.BUCKET).isin(places)).select(*names).unionByName(log.select(*names))
    store.replace_rows(resolved(mixed, key), path, key=key)
    store._overwrite(spark, f"{path}-folded", [(listed[-1],)], _FOLDED)
    # Readers pass over folded batches from here on.
    for batch in listed:
        store.remove(spark, f"{path}-log/batch={batch}")
    return places


def waiting(spark: SparkSession, path: str, schema: StructType, key: str) -> tuple[int, int, DataFrame]:
    """The last folded batch, the last in the log, and what the log changes: `sign` -1 as it was, 1 as it will be.

    Only buckets with records in the log are read.
    """
    base, log, folded = _state(spark, path, schema)
    last = log.agg(F.max("batch")).first()[0]
    names = _versioned(schema).fieldNames()
    old = base.where(F.col(store.BUCKET).isin(_places(log))).select(*names).join(log.select(key).distinct(), key, "left_semi")
    new = resolved(old.unionByName(log.select(*names)), key)
    both = old.select(*names, F.lit(-1).alias("sign")).unionByName(new.select(*names, F.lit(1).alias("sign")))
    return folded, folded if last is None else last, both.where(F.col("row_class") != DELETE).select(*schema.fieldNames(), "sign")


def batches(spark: SparkSession, path: str, schema: StructType) -> int:
    """How many batches wait in the log."""
    return _state(spark, path, schema)[1].agg(F.countDistinct("batch")).first()[0]
