"""Load state: what was loaded last, and whether a snapshot differs from it."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import schemas
from gable.functions.temporal import moment
from gable.sources.tables import read_table

_START = datetime(1970, 1, 1)


def _sums(rows: DataFrame) -> list[Column]:
    """Count and hash sums of rows: they add up over any split, so order does not matter."""
    columns = [
        F.to_json(c) if rows.schema[c].dataType.typeName() == "map" else F.col(f"`{c}`") for c in rows.columns
    ]
    # Spark's row hash skips nulls, so where they stand is hashed too.
    columns += [F.col(f"`{c}`").isNull() for c in rows.columns]
    total = F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))
    second = F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).alias("one"), F.coalesce(second, F.lit(0)).alias("two")]


def _print() -> Column:
    return F.sha2(F.concat_ws("|", "rows", "one", "two"), 256).alias("fingerprint")


def fingerprint(rows: DataFrame) -> DataFrame:
    """One row with the count of rows and a text that changes with any of them.

    Row hashes are summed, so the order of rows and files does not matter and
    every task hashes its own share.
    """
    return rows.agg(*_sums(rows)).select("rows", _print())


def part_fingerprints(rows: DataFrame, part: Column) -> DataFrame:
    """A fingerprint for each part: part, rows, one, two, fingerprint.

    The lower of two levels; `of_parts` makes the upper one from it without the rows.
    """
    return rows.withColumn("_part", part).groupBy(F.col("_part").alias("part")).agg(*_sums(rows)).select("*", _print())


def of_parts(parts: DataFrame) -> DataFrame:
    """The fingerprint of a table from those of its parts: the same as over its rows."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rows", "one", "two")]
    return parts.agg(*sums).select("rows", _print())


def changed_parts(before: DataFrame, now: DataFrame) -> DataFrame:
    """The parts of two snapshots that differ, from their part fingerprints: part, change.

    Nobody has to read the rows of the other parts again.
    """
    old = before.select(F.col("part").alias("_part"), F.col("fingerprint").alias("_before"))
    both = now.select("part", "fingerprint").join(old, F.col("part").eqNullSafe(F.col("_part")), "full")
    change = (
        F.when(F.col("_before").isNull(), "added")
        .when(F.col("fingerprint").isNull(), "removed")
        .when(F.col("fingerprint") != F.col("_before"), "changed")
    )
    part = F.when(F.col("fingerprint").isNull(), F.col("_part")).otherwise(F.col("part"))
    return both.select(part.alias("part"), change.alias("change")).where("change IS NOT NULL")


def changed(rows: DataFrame, known: str | None) -> DataFrame:
    """The fingerprint row with whether it differs from the one loaded last."""
    same = F.lit(False) if known is None else F.col("fingerprint") == known
    return fingerprint(rows).withColumn("changed", ~same)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The one-row state, at its initial values if nothing was loaded yet."""
    state = read_table(spark, path, schemas.LOAD_STATE)
    if not state.isEmpty():
        return state
    start, none = moment(_START), F.lit("")
    values = {
        f.name: start if f.dataType == schemas.TIME else none for f in schemas.LOAD_STATE
    }
    return spark.range(1).select(*[v.alias(n) for n, v in values.items()])


def write_state(state: DataFrame, path: str) -> None:
    """Replace the state; its one row is taken first, since it may come from there."""
    row = state.select(*schemas.LOAD_STATE.fieldNames()).first()
    state.sparkSession.createDataFrame([row], schemas.LOAD_STATE).write.mode("overwrite").parquet(path)


def sales_loaded(spark: SparkSession, path: str, found: str, when: datetime) -> None:
    state = read_state(spark, path)
    write_state(
        state.withColumns({"last_ppd_update": moment(when), "last_ppd_file": F.lit(found)}), path
    )
