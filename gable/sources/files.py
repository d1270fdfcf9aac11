"""CSV sources: sale files and certificate extracts."""

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable import fixed, schemas

# Quotes are doubled inside quoted text. Records with line breaks inside quotes
# need `multiline`, which costs the splitting of a file across tasks.
#: Certificate extracts have fewer columns than this.
MOST_COLUMNS = 200
_CSV = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def read_sales(spark: SparkSession, path: str, mode: str = "FAILFAST", multiline: bool = False) -> DataFrame:
    """The headerless sales file; a malformed row fails the load by default."""
    options = {**_CSV, "mode": mode, "header": False, "multiLine": multiline}
    return _blank(spark.read.schema(schemas.SALE_FILE).options(**options).csv(path))


def stream_sales(spark: SparkSession, folder: str, pattern: str = "*", **options) -> DataFrame:
    """Sale files as they arrive in a folder."""
    reader = spark.readStream.schema(schemas.SALE_FILE).options(
        **{**_CSV, "header": False, "pathGlobFilter": pattern, **options}
    )
    return _blank(reader.csv(folder))


#: Fields of `load_order`, the most significant first.
ORDER = ("file", "block", "place")


def in_load_order(rows: DataFrame) -> DataFrame:
    """Add `load_order`: the path of the file, the split's offset in it, and the place in the split.

    Files of one load apply in the order of their paths, so name them that way, such as
    by date or by numbers of equal length (09.csv, 10.csv).
    """
    of_file = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start")}
    return placed(rows.withColumns(of_file)).drop(*of_file)


def placed(rows: DataFrame) -> DataFrame:
    """Add `load_order` to rows that have the `file` and `block` they come from."""
    return rows.withColumn("load_order", F.struct("file", "block", F.monotonically_increasing_id().alias("place")))


def _blank(rows: DataFrame) -> DataFrame:
    """An empty field is empty text, not null."""
    return rows.fillna("", [f.name for f in schemas.SALE_FILE if f.name != "price"])


def certificate_headers(spark: SparkSession, folder: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """Distinct header lines of the certificate extracts below the folder, each with its files.

    One read of all files; their first lines are found where the splits with offset 0
    begin, however many files there are.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", fixed.CERTIFICATE_FILE)
        .text(folder)
        .select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("offset"))
        .where("offset = 0")
        .withColumn("place", F.monotonically_increasing_id())
    )
    first = lines.groupBy("path").agg(F.min_by("value", "place").alias("line"))
    names = F.from_csv("line", F.lit(", ".join(f"c{i} string" for i in range(MOST_COLUMNS))), {"quote": '"', "escape": '"'})
    shown = F.to_json(F.array(*[F.col("names")[f"c{i}"] for i in range(MOST_COLUMNS)]))
    by_header = first.select("path", names.alias("names")).groupBy(shown.alias("names")).agg(F.sort_array(F.collect_list("path")).alias("files"))
    return [(tuple(x.strip() for x in json.loads(r["names"]) if x is not None), r["files"]) for r in by_header.orderBy("names").collect()]


def read_certificates(spark: SparkSession, folder: str, multiline: bool = False) -> DataFrame:
    """All certificate extracts as text, columns by header name.

    Spark binds a schema by position, so files are grouped by their header line
    and each group is read under its own order. Unknown headers are ignored.
    """
    groups = certificate_headers(spark, folder)
    if not groups:
        raise FileNotFoundError(f"no {fixed.CERTIFICATE_FILE} below {folder}")
    # With pruned columns, a malformed row would pass where only keys are asked for.
    options = {**_CSV, "header": True, "multiLine": multiline, "columnPruning": False}

    def rows(columns: tuple[str, ...], files: list[str]) -> DataFrame:
        missing = set(schemas.CERTIFICATE_HEADERS) - set(columns)
        if missing:
            raise ValueError(f"certificate headers missing in {files[0]}: {sorted(missing)}")
        schema = ", ".join(f"`{c}` string" for c in columns)
        read = spark.read.schema(schema).options(**options, enforceSchema=False).csv(files)
        return read.select(*schemas.CERTIFICATE_HEADERS)

    return reduce(DataFrame.unionByName, [rows(c, f) for c, f in groups])
