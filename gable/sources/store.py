"""Tables as folders of parquet: reading, replacing, and the layout in hash buckets of a key.

A keyed table is laid out by a hash of its key into a fixed number of buckets, noted
beside it when its first rows come. Inside a bucket, files are sorted by key and carry a
Bloom filter of it. Who looks for some keys thus reads their buckets only, and there the
few row groups and pages that can hold them.
"""

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

BUCKET = "bucket"
#: Buckets of a new table. A bucket should be some tasks' work: more for large tables.
BUCKETS = 16
_NOTE = StructType([StructField("folder", StringType()), StructField("whole", BooleanType())])
_LAYOUT = StructType([StructField("key", StringType()), StructField("buckets", IntegerType())])


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at `path`, empty if nothing was written there yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _files(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing refers to any more."""
    place, files = _files(spark, path)
    files.delete(place, True)


def spread(spark: SparkSession, source: str, target: str, ending: str, name: str) -> None:
    """Move each file of a folder into a numbered folder of its own, under one name."""
    place, files = _files(spark, source)
    for n, found in enumerate(f.getPath() for f in files.listStatus(place) if f.getPath().getName().endswith(ending)):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/{n}")
        files.mkdirs(folder)
        files.rename(found, spark._jvm.org.apache.hadoop.fs.Path(folder, name))


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


# Buckets.


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def layout(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> int:
    """The number of buckets of the table; a table without one gets `buckets`."""
    noted = read_table(spark, f"{path}-layout", _LAYOUT).first()
    if noted is None:
        if exists(spark, path):
            raise ValueError(f"{path} has rows but no layout; lay it out with `laid_out`")
        _overwrite(spark, f"{path}-layout", [(key, buckets)], _LAYOUT)
        return buckets
    if noted["key"] != key:
        raise ValueError(f"{path} is laid out by {noted['key']}, not by {key}")
    return noted["buckets"]


def laid_out(spark: SparkSession, path: str, key: str, buckets: int) -> None:
    """Rewrite a table into this number of buckets, whatever its layout was."""
    new = f"{path}-new-{uuid.uuid4().hex}"
    spark.read.parquet(path).drop(BUCKET).write.parquet(new)
    # Cut off between these two, the rows go back into the layout they came from.
    _overwrite(spark, f"{path}-replacement", [(new, True)], _NOTE)
    _overwrite(spark, f"{path}-layout", [(key, buckets)], _LAYOUT)
    finish_replace(spark, path, key=key)


def touched(rows: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets the keys of `rows` are in, at most as many as there are."""
    return sorted(r[0] for r in rows.select(bucket_of(key, buckets)).distinct().collect())


def only(table: DataFrame, places: list[int], buckets: int) -> DataFrame:
    """The rows of a bucketed table in the given buckets; other folders are not read."""
    return table if len(places) == buckets else table.where(F.col(BUCKET).isin(places))


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int, overwrite: str | None = None) -> None:
    """Add rows to their buckets; `dynamic` replaces the buckets that have rows among them, `static` the table.

    A large bucket is cut into several files, small ones share a task.
    """
    placed = rows.drop(BUCKET).withColumn(BUCKET, bucket_of(key, buckets))
    writer = (
        placed.hint("rebalance", F.col(BUCKET))
        .sortWithinPartitions(BUCKET, key)
        .write.mode("overwrite" if overwrite else "append")
        .option("partitionOverwriteMode", overwrite or "dynamic")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
    )
    writer.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table with its `bucket` column."""
    return read_table(spark, path, StructType([*schema.fields, StructField(BUCKET, IntegerType())]))


def rows_of_keys(spark: SparkSession, path: str, schema: StructType, key: str, values: Iterable) -> DataFrame:
    """The rows of some listed keys: their buckets, and there what statistics and Bloom filters leave."""
    noted = read_table(spark, f"{path}-layout", _LAYOUT).first()
    values = list(values)
    if noted is None or not values:
        return read_table(spark, path, schema).where(F.lit(False))
    asked = spark.createDataFrame([(v,) for v in values], StructType([schema[key]]))
    places = touched(asked, key, noted["buckets"])
    found = only(read_buckets(spark, path, schema), places, noted["buckets"])
    return found.where(F.col(key).isin(values)).drop(BUCKET)


# Replacing.


def replace_rows(rows: DataFrame, path: str, partitions: tuple[str, ...] = (), key: str | None = None) -> None:
    """Replace a table, or with `partitions` only those that `rows` touches.

    The new rows are written in full beside the table and noted before anything is
    removed. A job that dies in between leaves the note, and `finish_replace` at the start
    of the next job completes it. With a `key`, buckets are replaced.
    """
    spark = rows.sparkSession
    new = f"{path}-new-{uuid.uuid4().hex}"
    rows.write.parquet(new)
    _overwrite(spark, f"{path}-replacement", [(new, False)], _NOTE)
    finish_replace(spark, path, partitions, key)


def finish_replace(spark: SparkSession, path: str, partitions: tuple[str, ...] = (), key: str | None = None) -> None:
    """Complete a replacement an earlier job noted; does nothing without one.

    Rows of one partition share a file, or some files where they are many.
    """
    noted = read_table(spark, f"{path}-replacement", _NOTE).first()
    if noted is None:
        return
    rows = spark.read.parquet(noted["folder"])
    if key:
        write_buckets(rows, path, key, layout(spark, path, key), "static" if noted["whole"] else "dynamic")
    else:
        writer = rows.write.mode("overwrite")
        if partitions:
            together = rows.hint("rebalance", *[F.col(c) for c in partitions])
            writer = together.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
        writer.parquet(path)
    _overwrite(spark, f"{path}-replacement", [], _NOTE)
    remove(spark, noted["folder"])


def _overwrite(spark: SparkSession, path: str, rows: list[tuple], schema: StructType) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
