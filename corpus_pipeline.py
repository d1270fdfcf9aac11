"""The corpus pipeline: each stage is one operator over what the stage before kept."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.llm import bpe, decontaminate, jaccard, pii, toxicity
from gable.llm.common import fold, small_arrow
from gable.session import staged

#: Tokens of a block of documents in the last stage.
BLOCK_TOKENS = 300_000
#: Documents with at least this probability of being toxic go.
TOXIC_FROM = 0.3


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; null and empty texts stay, and so do repeated rows."""
    small_arrow(spark)
    held_out = fold(F.col("doc_id"), 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.withColumnRenamed("score", "_own_score"), toxicity.train(docs, labels, ~held_out))
    return scored.where(F.col("score") < TOXIC_FROM).drop("score").withColumnRenamed("_own_score", "score")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of copies and near copies.

    Of repeated rows one stays; documents without words stay one by one, told by id and text.
    """
    small_arrow(spark)
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated go; of the others, benchmark passages are cut out.

    Null and empty texts have no passages and stay as they are; each repeated row is judged alike.
    """
    small_arrow(spark)
    new = {c: f"_own_{c}" for c in docs.columns if c.lower() in ("n_words", "spans", "items")}
    found = decontaminate.find_occurrences(docs.withColumnsRenamed(new), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    kept = found.where((n_hit == 0) | (n_hit * 20 < F.col("n_words")))
    return decontaminate.remove_spans(kept).withColumnsRenamed({v: k for k, v in new.items()})


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. All rows stay, null and empty texts as they are."""
    small_arrow(spark)
    new = {c: f"_own_{c}" for c in docs.columns if c.lower() == "spans"}
    found = pii.find(docs.withColumnsRenamed(new), pii.train(docs))
    return pii.redact(found).withColumnsRenamed({v: k for k, v in new.items()})


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document: none for null and empty texts, the same for repeated rows.

    Blocks are small, as they share their executors with what earlier stages left.
    """
    small_arrow(spark)
    kept = [c for c in docs.columns if c in ("doc_id", "lang", "source")]
    return bpe.encode(docs.select(*kept, "text"), bpe.read_ranks(), block_tokens=BLOCK_TOKENS)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", decontaminated), ("pii", redacted), ("byte_bpe", encoded)]

#: Models decide in two stages, so SQL can't state the rows; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
