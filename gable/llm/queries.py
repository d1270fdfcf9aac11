"""The registered queries of this package, each over its whole tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.llm import bpe, codes, decontaminate, exactdedup, jaccard, langid, lm, oracle, pii, search, sharding, syncmers, tokens, toxicity
from gable.llm.common import documents, fold, whole_text

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    held_out = fold(F.col("doc_id"), 3) == 1
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs, ~held_out), carry=["doc_id"])
    return found.withColumn("held_out", held_out)


def op2_syncmer_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return syncmers.edited_likeness(documents(spark, d).select("doc_id", "text"))


def op3_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    held_out = fold(F.col("doc_id"), 10) == 0
    return lm.score(documents(spark, d).select("doc_id", "text"), ~held_out).withColumn("held_out", held_out)


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words of every document; contaminated from one word in twenty."""
    found = decontaminate.find_occurrences(
        documents(spark, d).select("doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet"), carry=["doc_id"]
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op5_token_output(spark: SparkSession, d: str) -> DataFrame:
    return tokens.crc32_of_ids(tokens.encoded(documents(spark, d)))


def op6_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    ranks = bpe.read_ranks()
    encoded = bpe.encode(documents(spark, d).select("doc_id", "text"), ranks)
    return bpe.digests(encoded, ranks)


def op7_ngram_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return jaccard.join(documents(spark, d)).select("doc_id", "n_shingles", "component_id")


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    """Law `rows`: counts of the shards differ by one at most."""
    rows = documents(spark, d).select("doc_id", whole_text(F.col("text")).alias("text"))
    size, crc = (F.octet_length("text") + 1).cast("bigint"), F.crc32(F.col("text"))
    dealt = sharding.shuffle_into_shards(rows, [F.col("doc_id"), size, crc])
    # Digests of the documents as they arrived in their shards.
    return dealt.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "slot", "shard", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans with those that the network adds."""
    docs = documents(spark, d).select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), carry=["doc_id"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(kind) for kind in pii.KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added"),
    )


def op10_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d).select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"), ~held_out)
    return toxicity.score(docs, model, carry=["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op11_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Copies of every document; one half of the ids is the history, the other half is looked up in it."""
    found = exactdedup.classes(documents(spark, d), history=fold(F.col("doc_id"), 2) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return search.search(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of every usable vector, two hex digits a part."""
    found = codes.compress(spark.read.parquet(f"{d}/embeddings.parquet"))
    return found.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", "codebooks_sha256")


REGISTERED: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_syncmer_fingerprints, op3_lm_scores, op4_decontamination, op5_token_output, op6_byte_bpe, op7_ngram_jaccard,
        op8_sharding, op9_pii, op10_toxicity, op11_exact_dedup, op12_lexical_search, op13_vector_codes,
    )
}
SQL: dict[str, str] = oracle.SQL
