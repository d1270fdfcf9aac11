"""Raw sale records to postcode, house and sale rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gable import fixed, schemas
from gable.functions import text
from gable.functions.temporal import parsed_minute

REFERENCE, INTENDED = "reference", "intended"
ADD, CHANGE, DELETE = "ADDITION", "CHANGE", "DELETE"


def row_class(status: Column) -> Column:
    return (
        F.when(status == fixed.ADDED, ADD).when(status == fixed.CHANGED, CHANGE).otherwise(DELETE)
    )


def derived(raw: DataFrame, mode: str = REFERENCE) -> DataFrame:
    """All columns of the three relations on one row, plus `row_class`.

    A plain projection, so it also runs on a stream; `load_order` stays if it is there. In `reference` mode the
    new-build flag is true for "N", as existing tables have it; `intended` reads
    it the other way round.
    """
    parts = text.postcode_parts(F.col("postcode"))
    return raw.withColumn("parts", parts).select(
        text.without_ends(F.col("tui")).alias("tui"),
        "price",
        parsed_minute(F.col("date")).alias("date"),
        text.flag_is(F.col("new_build"), "N" if mode == REFERENCE else "Y").alias("new"),
        text.flag_is(F.col("duration"), "F").alias("freehold"),
        "ppd_cat",
        text.house_id(F.col("paon"), F.col("saon"), F.col("postcode")).alias("houseid"),
        "paon",
        "saon",
        "postcode",
        F.col("property_type").alias("type"),
        "street",
        "town",
        "district",
        "county",
        "parts.outcode",
        "parts.area",
        "parts.sector",
        row_class(F.col("record_status")).alias("row_class"),
        F.col("date").alias("date_text"),
        text.postcode_is_valid(F.col("postcode")).alias("postcode_ok"),
        *[c for c in raw.columns if c == "load_order"],
    )


def problems(check_widths: bool = False) -> Column:
    """What is wrong with a derived row, apart from its postcode."""
    found = [
        F.when(F.col("price").isNull(), "price"),
        F.when(F.col("date").isNull(), "date"),
    ]
    if check_widths:
        widths = {c: w for table in schemas.WIDTHS.values() for c, w in table.items()}
        found += [F.when(F.length(c) > w, f"{c} too long") for c, w in widths.items()]
    return F.array_compact(F.array(*found))


def _clean(rows: DataFrame) -> DataFrame:
    return rows.drop("date_text", "postcode_ok", "problems")


def normalised(raw: DataFrame, mode: str = REFERENCE, check_widths: bool = False) -> DataFrame:
    """Rows with a valid postcode; any other fault fails the job.

    The check is a filter, so it runs whichever columns are read and whatever is
    done with the rows, deletions included.
    """
    rows = derived(raw, mode).filter("postcode_ok").withColumn("problems", problems(check_widths))
    message = F.concat(
        F.lit("bad sale record "), F.coalesce("tui", F.lit("?")), F.lit(": "),
        F.array_join("problems", ", "), F.lit(", date "), F.coalesce("date_text", F.lit("?")),
    )
    checked = F.when(F.size("problems") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return _clean(rows.filter(checked))


def screened(
    raw: DataFrame, mode: str = REFERENCE, check_widths: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their reasons) instead of failing."""
    reasons = F.concat(
        F.when(~F.col("postcode_ok"), F.array(F.lit("postcode"))).otherwise(
            F.array().cast("array<string>")
        ),
        problems(check_widths),
    )
    rows = derived(raw, mode).withColumn("problems", reasons)
    good = rows.filter(F.size("problems") == 0)
    rejected = rows.filter(F.size("problems") > 0).withColumn(
        "reason", F.array_join("problems", ", ")
    )
    return _clean(good), rejected.drop("problems", "postcode_ok")


def additions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("row_class") != DELETE)


def deletions(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("row_class") == DELETE)


def relation(rows: DataFrame, schema) -> DataFrame:
    return rows.select(*schema.fieldNames())


def first_per_key(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order, ties by the other columns.

    A minimum over structs, so each task keeps one row per key before the
    shuffle, however often a key repeats.
    """
    ranked = F.struct(*order, *[c for c in columns if c not in order])
    least = rows.groupBy(key).agg(F.min(ranked).alias("first"))
    return least.select(*[F.col(key) if c == key else F.col("first")[c].alias(c) for c in columns])


def latest_per_key(rows: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    ranked = F.struct(*order, *[c for c in columns if c not in order])
    most = rows.groupBy(key).agg(F.max(ranked).alias("last"))
    return most.select(*[F.col(key) if c == key else F.col("last")[c].alias(c) for c in columns])


def absent(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def keyed_union(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows win; `new` must hold each key once."""
    return existing.unionByName(absent(new, existing, key))


def changes_applied(existing: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """Sales after additions, changes and deletions, by the last record of each.

    A change replaces, a deletion removes, an addition only fills a gap.
    """
    columns = existing.columns
    last = latest_per_key(changes, "tui", [*columns, "row_class"], order)
    replacing = last.filter(F.col("row_class") != ADD)
    kept = absent(existing, replacing, "tui")
    changed = last.filter(F.col("row_class") == CHANGE).select(*columns)
    added = absent(last.filter(F.col("row_class") == ADD).select(*columns), existing, "tui")
    return kept.unionByName(changed).unionByName(added)
