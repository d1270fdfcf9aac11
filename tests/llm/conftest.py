import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """Documents from pairs (doc_id, text), optionally with a language."""

    def made(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return made


@pytest.fixture
def table_dir(spark, tmp_path):
    """A folder with the given DataFrames as parquet tables."""

    def written(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return written


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
