"""Document fingerprints from closed syncmers.

A text is its runs of characters other than blanks. Every two neighbouring words have
a hash; a run of `K` words is a closed syncmer if the smallest hash of its inner pairs
stands first or last. That depends on the run alone, so equal passages choose equal
anchors whatever stands around them. An anchor and the next one, with their distance
in words, make a feature: it matches only where both anchors stand in the same
position to each other. The fingerprint is a bottom sketch: the `SKETCH` smallest
feature hashes, or all of them where there are fewer. Everything is a DataFrame
expression; arrays are columns of their own, so no expression is worked out again for
each element.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SKETCH = 128
BLOCK_BYTES = 8 << 20


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, size: int = SKETCH) -> DataFrame:
    """The rows with `out`, the sorted sketch of a text column without nulls.

    A text without words has an empty sketch; one with fewer than `k` words has its
    whole sequence of words as the only feature.
    """
    w, s, a = f"_{out}_words", f"_{out}_pairs", f"_{out}_anchors"
    words, pairs, anchors = F.col(w), F.col(s), F.col(a)
    inner = k - 1  # pairs of neighbours inside a run
    df = df.withColumn(w, F.filter(F.split(F.col(text), r"[\s]+"), lambda x: x != ""))
    some = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - 2)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(s, F.transform(some, lambda i: F.xxhash64(words[i], words[i + 1])))

    def closed(i: Column) -> Column:
        between = F.least(*[pairs[i + j] for j in range(1, inner - 1)]) if inner > 3 else pairs[i + 1]
        return F.least(pairs[i], pairs[i + inner - 1]) <= between

    runs = F.when(F.size(s) >= inner, F.sequence(F.lit(0), F.size(s) - inner)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(a, F.filter(runs, closed))
    run = lambda i: [pairs[i + j] for j in range(inner)]
    links = F.when(F.size(a) >= 2, F.sequence(F.lit(0), F.size(a) - 2)).otherwise(F.array().cast("array<int>"))
    paired = F.transform(links, lambda j: F.xxhash64(*run(anchors[j]), *run(anchors[j + 1]), anchors[j + 1] - anchors[j]))
    # Without two anchors the whole sequence of words stands for the text.
    features = F.when(F.size(a) >= 2, paired).when(F.size(w) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    sketch = F.slice(F.array_sort(F.array_distinct(features)), 1, size)
    return df.withColumn(out, sketch).drop(w, s, a)


def likeness(one: str, other: str, size: int = SKETCH) -> Column:
    """Share of features that two sketched texts have in common, twice the common over the sum; 1 for two empty ones."""
    union = F.slice(F.array_sort(F.array_union(one, other)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(one, other), union)) / F.size(union)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(2 * common / (1 + common))


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, size: int = SKETCH) -> DataFrame:
    """All rows and columns with `fingerprint`, the sketch in hexadecimal; null texts count as empty."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "fingerprint"]
    df = with_sketch(docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_whole")), "_whole", "_sketch", k, size)
    return df.withColumn("fingerprint", as_text("_sketch")).drop("_whole", "_sketch")


def beside_next(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, Window]:
    """Rows (block, copy, key, doc_id, text) and the window in which the next row is the next document.

    Blocks are ranges of ids, cut at values of the id. The rows of the id a block
    begins with are copied to the end of the block before, those of the first id to the
    end of the last block, so each row finds its successor inside its block. Null ids
    come first; rows of one id come in the order of their text.
    """
    least = -(1 << 63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(least)).alias("key"))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("key").alias("first")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2, -(-(facts["bytes"] or 0) // block_bytes))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] or []
    first = facts["first"] if facts["first"] is not None else 0
    cuts = sorted({c for c in cuts if c > first})
    starts = F.from_json(F.lit(str([first, *cuts])), "array<bigint>")
    # Blocks are found in two steps, over the starts of runs of blocks and inside one run.
    last = len(cuts)
    width = max(1, int(last**0.5))
    heads = F.from_json(F.lit(str([first, *cuts][::width])), "array<bigint>")
    run = F.size(F.filter(heads, lambda c: c <= F.col("key"))) - 1
    inside = F.size(F.filter(F.slice(starts, F.col("_run") * width + 1, width), lambda c: c <= F.col("key"))) - 1
    rows = rows.withColumn("_run", run).withColumn("block", (F.col("_run") * width + inside).cast("int")).drop("_run")
    begins = F.col("key") == F.element_at(starts, F.col("block") + 1)
    before = F.when(F.col("block") > 0, F.col("block") - 1).otherwise(F.lit(last))
    own = F.struct(F.col("block").alias("block"), F.lit(False).alias("copy"))
    copied = F.struct(before.alias("block"), F.lit(True).alias("copy"))
    rows = rows.withColumn("_to", F.when(begins, F.array(own, copied)).otherwise(F.array(own))).drop("block").select("*", F.inline("_to")).drop("_to")
    return rows, Window.partitionBy("block").orderBy("copy", "key", "text")


def edited_likeness(docs: DataFrame, k: int = K, size: int = SKETCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each document the fingerprints of its text and of its edited text, and their likeness.

    In the edited text the last floor(n / 2) characters are replaced by the first as
    many, or all, of the next document, in the order of ids and after the last the first.
    """
    rows, window = beside_next(docs, block_bytes)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = (
        rows.withColumn("_next", F.coalesce(F.lead("text").over(window), F.col("text")))
        .withColumn("n_chars", F.char_length("text").cast("bigint"))
        .withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half)))
        .drop("_next")
    )
    rows = with_sketch(with_sketch(rows, "text", "own", k, size), "edited", "changed", k, size)
    rows = rows.withColumn("following", F.coalesce(F.lead("own").over(window), F.col("own"))).where(~F.col("copy"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("changed").alias("edited_fingerprint"),
        likeness("own", "changed", size).alias("near_edited"),
        likeness("own", "following", size).alias("near_next"),
    )
