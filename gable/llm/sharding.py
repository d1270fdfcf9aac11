"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to partitions by a hash. How many rows of each partition go to each
target is drawn from the multivariate hypergeometric law, so that the sizes of all
targets are exact and every assignment is as likely as under a uniform shuffle of all
rows. Each partition permutes its rows and deals them out by its line of the matrix;
each target permutes what it received. A shard is a run of targets, so no task holds
a whole shard. Only counts reach the driver: as many as there are partitions, at most
`MOST_BLOCKS`, whatever the input.
"""

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 2_000
MOST_BLOCKS = 512


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many good ones are among `drawn` of `good + bad`, drawn without replacement.

    Small cases draw one by one; others reject from a ratio of uniforms around the
    mode, with the exact probabilities by log-gamma.
    """
    total = good + bad
    if drawn > total - drawn:
        return good - hypergeometric(rng, good, bad, total - drawn)
    if drawn <= 12:
        found, left = 0, total
        for _ in range(drawn):
            if rng.random() * left < good - found:
                found += 1
            left -= 1
        return found
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    lg = math.lgamma

    def weight(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(drawn - k + 1) + lg(bad - drawn + k + 1))

    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    spread = math.sqrt(drawn * (good / total) * (bad / total) * (total - drawn) / max(1, total - 1))
    centre, width, top = mode + 0.5, 1.7155277699214135 * math.sqrt(spread * spread + 0.5) + 0.8989161620588988, weight(mode)
    while True:
        u = 1.0 - rng.random()
        k = math.floor(centre + width * (rng.random() - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows from each partition to each target; lines sum to `counts`, columns to `sizes`."""
    rng, room, lines = random.Random(seed), list(sizes), []
    for count in counts:
        line, left, free = [], count, sum(room)
        for j, size in enumerate(room):
            free -= size
            k = hypergeometric(rng, size, free, left) if left else 0
            line.append(k)
            left -= k
        room = [size - k for size, k in zip(room, line)]
        lines.append(line)
    return lines


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def shuffle_into_shards(df: DataFrame, key: list[Column], shards: int = 8, seed: int = 8, rows_per_block: int = ROWS_PER_BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Every row once, with `shard` (int) and `slot` (long, from 0 without gaps in its shard).

    Shard sizes differ by one row at most. `key` names the content of a row; rows with
    the same key are interchangeable. Null keys are ordinary values, a table without
    rows gives none, and columns of the input called `shard` or `slot` are replaced.
    The result depends on the keys and the seed only, so a task can be repeated.
    """
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")])
    plain = [c.cast("string") for c in key]
    hashed = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *plain, *[c.isNull() for c in plain])
    total = df.count()
    blocks = max(1, min(most_blocks, math.ceil(total / rows_per_block)))
    own = F.pmod(hashed("deal"), F.lit(blocks)).cast("int")
    found = {r["p"]: r["n"] for r in df.groupBy(own.alias("p")).agg(F.count("*").alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(blocks)]
    per_shard = max(1, math.ceil(blocks / shards))
    shard_sizes = even(total, shards)
    sizes = [n for size in shard_sizes for n in even(size, per_shard)]
    lines = communication_matrix(counts, sizes, seed)
    ends = [running(line) for line in lines]
    bases = [sum(sizes[t - t % per_shard : t]) for t in range(len(sizes))]
    # Each line in runs of `width` targets, so that a row looks at two short arrays.
    width = math.isqrt(len(sizes) - 1) + 1
    matrix = [{"_p": p, "_runs": [e[i : i + width] for i in range(0, len(e), width)]} for p, e in enumerate(ends)]
    lines_df = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(matrix)), "array<struct<_p:int,_runs:array<array<bigint>>>>")))
    base = F.from_json(F.lit(json.dumps(bases)), "array<bigint>")
    local = Window.partitionBy("_p").orderBy(hashed("local"), *plain)
    dealt = (
        df.withColumn("_p", own)
        .withColumn("_rank", F.row_number().over(local).cast("bigint") - 1)
        .join(F.broadcast(lines_df), "_p")
        .withColumn("_run", F.size(F.filter("_runs", lambda run: F.element_at(run, -1) <= F.col("_rank"))))
        .withColumn("_target", F.col("_run") * width + F.size(F.filter(F.col("_runs")[F.col("_run")], lambda e: e <= F.col("_rank"))))
        .drop("_p", "_rank", "_runs", "_run")
    )
    arrived = Window.partitionBy("_target").orderBy(hashed("arrived"), *plain)
    return (
        dealt.withColumn("slot", F.row_number().over(arrived).cast("bigint") - 1 + F.element_at(base, F.col("_target") + 1))
        .withColumn("shard", F.floor(F.col("_target") / per_shard).cast("int"))
        .drop("_target")
    )


def running(line: list[int]) -> list[int]:
    total, out = 0, []
    for k in line:
        total += k
        out.append(total)
    return out
