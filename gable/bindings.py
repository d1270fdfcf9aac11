"""The domain tables, read from the test parquet tables.

Every row of a source table becomes a row here, but for two facts of the domain:
a house has a property number only when its customer has a positive balance, and
only priced calls are usage.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import schemas
from gable.operators import usage

RANGE = ("1996-01-01", "2000-12-31")
CUTOFF = "2024-01-20"
AS_OF = "2024-01-25"
PRICES = {"view": 1, "click": 2, "purchase": 5}

_ORDERS = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string"
)
_EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def _read(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    # A stated schema reads the stored local times as UTC instants in the scan,
    # so filters on them still reach the file.
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders", _ORDERS)


def postcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    outcode = F.concat(F.lit("N"), key)
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("postcode"),
        F.concat(F.lit("Street "), key % 7).alias("street"),
        F.concat(F.lit("Town "), key).alias("town"),
        F.concat(F.lit("District "), key % 10).alias("district"),
        F.concat(F.lit("County "), key % 4).alias("county"),
        outcode.alias("outcode"),
        F.substring("r_name", 1, 2).alias("area"),
        F.concat(outcode, F.lit(" "), key % 10).alias("sector"),
    )


def houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    codes = {"BUILDING": "D", "AUTOMOBILE": "S", "FURNITURE": "T", "HOUSEHOLD": "F", "MACHINERY": "O"}
    kind = F
    for name, code in codes.items():
        kind = kind.when(segment == name, code)
    return _read(spark, sf_dir, "customer").select(
        key.cast("string").alias("houseid"),
        (key % 50).cast("string").alias("paon"),
        F.when(key % 4 == 0, F.concat(F.lit("Flat "), key % 7)).alias("saon"),
        F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("postcode"),
        kind.alias("type"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return _orders(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("tui"),
        F.round("o_totalprice").cast("bigint").alias("price"),
        F.col("o_orderdate").alias("date"),
        (F.col("o_orderpriority") == "1-URGENT").alias("new"),
        (status != "O").alias("freehold"),
        F.when(status == "P", "B").otherwise("A").alias("ppd_cat"),
        F.col("o_custkey").cast("string").alias("houseid"),
    )


def uprn_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("houseid"),
        (F.col("c_custkey") + 100_000_000).alias("uprn"),
    )


def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")

    def letter(shift: int):
        return F.substring(F.lit("ABCDEFG"), (1 + (key + shift) % 7).cast("int"), F.lit(1))

    return _orders(spark, sf_dir).select(
        F.concat(F.lit("epc-"), key).alias("lmk_key"),
        F.concat((key % 50), F.lit(" High Street")).alias("address1"),
        F.when(key % 3 == 0, F.concat(F.lit("Block "), key % 9)).alias("address2"),
        F.lit(None).cast("string").alias("address3"),
        F.concat(F.lit("NATION_"), key % 25).alias("postcode"),
        letter(0).alias("current_energy_rating"),
        letter(1).alias("potential_energy_rating"),
        F.when(key % 2 == 0, "House").otherwise("Flat").alias("property_type"),
        F.to_date("o_orderdate").alias("lodgement_date"),
        ((key % 400) * F.lit(0.25)).cast("decimal(10,2)").alias("total_floor_area"),
        F.when(key % 20 != 0, F.col("o_custkey") + 100_000_000).alias("uprn"),
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale records as a sale file holds them."""
    key, house = F.col("o_orderkey"), F.col("c_custkey")
    postcode = (
        F.when(house % 10 == 9, "BAD CODE")
        .when(house % 10 == 8, "SW1A 1AA")
        .otherwise(F.concat(F.lit("LS"), F.col("c_nationkey") + 1, F.lit(" "), house % 10, F.lit("AD")))
    )
    status = F.when(key % 10 == 0, "C").when(key % 10 == 1, "D").otherwise("A")
    customer = _read(spark, sf_dir, "customer")
    return _orders(spark, sf_dir).join(customer, F.col("o_custkey") == house).select(
        F.concat(F.lit("{"), key, F.lit("}")).alias("tui"),
        F.round("o_totalprice").cast("bigint").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm").alias("date"),
        postcode.alias("postcode"),
        F.substring("c_mktsegment", 1, 1).alias("property_type"),
        F.when(key % 2 == 0, "N").otherwise("Y").alias("new_build"),
        F.when(key % 3 == 0, "F").otherwise("L").alias("duration"),
        (house % 50).cast("string").alias("paon"),
        F.when(house % 4 == 0, F.concat(F.lit("Flat "), house % 7)).otherwise("").alias("saon"),
        F.concat(F.lit("Street "), key % 5).alias("street"),
        F.lit("").alias("locality"),
        F.concat(F.lit("Town "), F.col("c_nationkey")).alias("town"),
        F.concat(F.lit("District "), F.col("c_nationkey") % 10).alias("district"),
        F.concat(F.lit("County "), F.col("c_nationkey") % 4).alias("county"),
        F.when(F.col("o_orderstatus") == "P", "B").otherwise("A").alias("ppd_cat"),
        status.alias("record_status"),
    )


# Texts the raw certificate fields cycle through, by the parser of the field.
RAW_TEXTS = {
    "key": None,
    "text": ("plain", "  padded ", "   ", "", "a, \"quoted\" text"),
    "rating": ("A", " c ", "INVALID!", "g", "", "B "),
    "int": ("12", " 12 ", "12.0", "abc", "", "-7", "99999999999"),
    "bigint": ("100", " 200 ", "x", "", "9000000000"),
    "decimal": ("1.5", " 2.25 ", "n/a", "", "3", "-0.5"),
    "date": ("2020-01-05", "2020-02-30", "2020-01-05 10:00:00", "", "2019-12-31", "05/01/2020"),
    "datetime": ("2020-01-05 10:11:12", "2020-01-05", "", "bad"),
}


def raw_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificate rows as text, good, padded, blank and bad by turns."""
    key = F.col("o_orderkey")

    def field(position: int, name: str, kind: str):
        texts = RAW_TEXTS[kind.split("(")[0]]
        if texts is None:
            return F.concat(F.lit("epc-"), key).alias(name.upper())
        choices = F.array(*[F.lit(t) for t in texts])
        turn = ((key + position % len(texts)) % len(texts) + 1).cast("int")
        return F.element_at(choices, turn).alias(name.upper())

    return _orders(spark, sf_dir).select(
        *[field(i, name, kind) for i, (name, kind) in enumerate(schemas.CERTIFICATE_FIELDS)]
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


def requests(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """The request log; as a stream it reads the same file as a file source."""
    if stream:
        rows = spark.readStream.schema(_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        rows = _read(spark, sf_dir, "events", _EVENTS)
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        "user_id",
        F.col("event_type").alias("api_route"),
        F.col("ts").alias("timestamp"),
    )


def usage_events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    billed = F.when(F.col("timestamp") < F.lit("2024-01-08").cast("timestamp"),
                    F.concat(F.lit("old-"), F.col("user_id")))
    return usage.priced(requests(spark, sf_dir, stream), PRICES).withColumn("ledger_id", billed)


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A billing history: one ledger per user and week of usage."""
    week = F.to_date(F.date_trunc("week", "timestamp"))
    return (
        usage_events(spark, sf_dir)
        .groupBy("user_id", week.alias("week"))
        .agg(
            F.sum("tokens").alias("total_tokens"),
            F.min("timestamp").alias("period_start"),
            F.max("timestamp").alias("period_end"),
        )
        .select(
            F.concat_ws("-", F.lit("week"), "week", "user_id").alias("id"),
            "user_id", "total_tokens", "period_start", "period_end",
        )
    )
