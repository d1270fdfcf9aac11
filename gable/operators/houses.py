"""House lookups: by postcode, by key, and with sales and certificates nested."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALE_FIELDS = ("tui", "price", "date", "new", "freehold", "ppd_cat")
CERTIFICATE_FIELDS = (
    "lmk_key", "address1", "address2", "address3", "postcode", "current_energy_rating",
    "potential_energy_rating", "property_type", "lodgement_date", "total_floor_area", "uprn",
)


def listing_order() -> list[Column]:
    return [F.asc_nulls_last("paon"), F.asc_nulls_last("saon"), F.asc_nulls_last("houseid")]


def houses_of_postcode(houses: DataFrame, postcode: str) -> DataFrame:
    return houses.filter(F.col("postcode") == postcode).orderBy(*listing_order())


def houses_by_postcode(houses: DataFrame) -> DataFrame:
    """All postcodes listed at once.

    A range sort over every ordering column, so the houses of one large postcode
    spread over several tasks.
    """
    return houses.filter(F.col("postcode").isNotNull()).orderBy("postcode", *listing_order())


def house(houses: DataFrame, houseid: str) -> DataFrame:
    return houses.filter(F.col("houseid") == houseid)


def houses_of_keys(houses: DataFrame, keys: DataFrame) -> DataFrame:
    return houses.join(keys.select("houseid"), "houseid", "left_semi")


def house_sales(houses: DataFrame, sales: DataFrame) -> DataFrame:
    """Every sale of the given houses, as rows."""
    return sales.join(houses.select("houseid"), "houseid", "left_semi")


def newest_first(sales: DataFrame) -> DataFrame:
    """Sorted by house, newest sale first, then by transaction."""
    return sales.orderBy("houseid", F.desc_nulls_first("date"), F.asc_nulls_last("tui"))


def first_lookup(lookup: DataFrame) -> DataFrame:
    """One property number per house; the smallest if the table holds several."""
    return lookup.groupBy("houseid").agg(F.min("uprn").alias("uprn"))


def linked_certificates(houses: DataFrame, lookup: DataFrame, certificates: DataFrame) -> DataFrame:
    """(houseid, certificate columns) of houses with a property number.

    Inner joins: houses without a number and certificates without one never
    meet in a null key.
    """
    numbers = first_lookup(lookup).join(houses.select("houseid"), "houseid", "left_semi")
    return numbers.join(certificates.select(*CERTIFICATE_FIELDS), "uprn").select(
        "houseid", *CERTIFICATE_FIELDS
    )


def with_street(houses: DataFrame, postcodes: DataFrame) -> DataFrame:
    """Add the street of the postcode, null when the house has no postcode.

    Houses without a postcode get a key of their own that matches nothing, so
    they do not gather in the null partition.
    """
    no_match = F.concat(F.lit("\u0000"), F.col("houseid"))
    return (
        houses.withColumn("_place", F.coalesce(F.col("postcode"), no_match))
        .join(
            postcodes.select(F.col("postcode").alias("_place"), "street"), "_place", "left"
        )
        .drop("_place")
    )


def house_detail(
    houses: DataFrame,
    postcodes: DataFrame,
    sales: DataFrame,
    lookup: DataFrame,
    certificates: DataFrame,
) -> DataFrame:
    """Houses with `previous_sales` (newest first) and `linked_epcs` arrays, by calendar year.

    A row is a house and a year in which it was sold or certified; `year` is null for
    children without a date and for the one row of a house without children. The shape
    follows from the children alone, not from how many there are. Children of both
    kinds are placed by house and year in one shuffle, so they never multiply and the
    years of a busy house go to different tasks. All years newest first, one after the
    other, are the whole history in order.
    """
    wanted = houses.select("houseid")
    sold = F.struct(
        (-F.unix_micros(F.col("date").cast("timestamp"))).alias("newest"),
        F.col("tui"),
        *[F.col(c) for c in SALE_FIELDS if c != "tui"],
    )
    children = (
        sales.join(wanted, "houseid", "left_semi")
        .select("houseid", F.year("date").alias("year"), sold.alias("sale"))
        .unionByName(
            linked_certificates(houses, lookup, certificates).select(
                "houseid", F.year("lodgement_date").alias("year"), F.struct(*CERTIFICATE_FIELDS).alias("epc")
            ),
            allowMissingColumns=True,
        )
    )
    nested = (
        children.repartition("houseid", "year")
        .groupBy("houseid", "year")
        .agg(
            F.array_sort(F.collect_list("sale")).alias("sales_sorted"),
            F.array_sort(F.collect_list("epc")).alias("linked_epcs"),
        )
    )
    previous = F.transform("sales_sorted", lambda s: F.struct(*[s[c].alias(c) for c in SALE_FIELDS]))
    return (
        with_street(houses, postcodes)
        .join(nested, "houseid", "left")
        .select(
            "houseid", "year", "paon", "saon", "street", "postcode", "type",
            F.coalesce(previous, F.expr("array()").cast(_sales_type(sales))).alias("previous_sales"),
            F.coalesce("linked_epcs", F.expr("array()").cast(_epcs_type(certificates))).alias("linked_epcs"),
        )
    )


def _sales_type(sales: DataFrame) -> str:
    return _array_type(sales, SALE_FIELDS)


def _epcs_type(certificates: DataFrame) -> str:
    return _array_type(certificates, CERTIFICATE_FIELDS)


def _array_type(table: DataFrame, fields: tuple[str, ...]) -> str:
    inner = ", ".join(f"{f}: {table.schema[f].dataType.simpleString()}" for f in fields)
    return f"array<struct<{inner}>>"
