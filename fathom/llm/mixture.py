"""Problem 8: mix sources to target weights by systematic sampling.

Every document of a source is expected to be used as often as the source needs to reach its share, at most its cap.
Prefix sums of these expectations within the source, shifted by one random offset, cross an integer once for each copy.
The prefix sums are built from counts of small buckets first, so no source, however large, is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED, BUCKETS, BUCKET_ROWS = 42, 64, 1_000_000


def source_budget(sizes: DataFrame, targets: DataFrame, source: str = "source", size: str = "n_tokens", share: str = "target_share", repeats: str = "max_repeats") -> DataFrame:
    """One row per listed source: own and total size, wanted size, expected copies of each document, short.

    total counts every document of a listed source once. copies = least(max_repeats, wanted / own); short tells that
    max_repeats x own stays below target_share x total. A listed source without documents has own 0 and copies 0. Null
    sources and sizes take no part; a source listed twice counts with its first row by share and repeats; a null share or
    cap counts as 0. Empty tables give totals of 0, and no source is short.
    """
    own = sizes.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("s")).agg(F.sum(F.col(size)).cast("bigint").alias("own"), F.count("*").alias("documents"))
    listed = targets.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("s")).agg(F.min(F.struct(F.coalesce(F.col(share).cast("double"), F.lit(0.0)).alias("share"), F.coalesce(F.col(repeats).cast("bigint"), F.lit(0)).alias("repeats"))).alias("t"))
    rows = listed.join(own, "s", "left").select("s", F.col("t.share").alias("target_share"), F.col("t.repeats").alias("max_repeats"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("documents", F.lit(0)).alias("documents"))
    # one row per listed source: the list is as long as the targets table, whatever the documents
    total = F.sum("own").over(Window.partitionBy(F.lit(1)))
    wanted = F.col("target_share") * F.col("total")
    copies = F.when(F.col("own") > 0, F.least(F.col("max_repeats").cast("double"), wanted / F.col("own"))).otherwise(0.0)
    return rows.withColumn("total", total).withColumn("wanted", wanted).withColumn("copies", copies).withColumn("short", F.col("max_repeats") * F.col("own") < F.col("wanted")).withColumnRenamed("s", source)


def _offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) of each source's own."""
    return F.pmod(F.xxhash64(F.lit(seed), source), F.lit(1 << 30)) / F.lit(float(1 << 30))


def systematic_copies(sizes: DataFrame, budget: DataFrame, key: str = "doc_id", source: str = "source", size: str = "n_tokens", seed: int = SEED) -> DataFrame:
    """Every use of a document in the mixture as (key, source, size, copy), copy counting from 1.

    Documents are taken in order of size, so that the sample of a source has its sizes too. The same seed gives the same
    mixture. A document occurs floor(copies) or ceil(copies) times, never more than max_repeats. Null keys, sources and
    sizes take no part; equal keys in a source are documents of their own.
    """
    plan = budget.where("copies > 0").select(F.col(source).alias("s"), "copies", F.greatest(F.lit(BUCKETS), F.col("documents") / BUCKET_ROWS).cast("int").alias("buckets"))
    docs = sizes.where(F.col(key).isNotNull() & F.col(source).isNotNull() & F.col(size).isNotNull()).select(F.col(key).alias("k"), F.col(source).alias("s"), F.col(size).alias("n"))
    # documents of one size are spread over more buckets the more documents the source has
    docs = docs.join(plan, "s").withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "k"), F.col("buckets")))
    counts = docs.groupBy("s", "n", "b").agg(F.count("*").alias("c"))
    upto = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # smaller sizes of the source, a row for each size; then smaller buckets of the size, a row for each bucket
    smaller = counts.groupBy("s", "n").agg(F.sum("c").alias("c")).select("s", "n", upto(Window.partitionBy("s").orderBy("n")).alias("smaller"))
    before = counts.select("s", "n", "b", upto(Window.partitionBy("s", "n").orderBy("b")).alias("within")).join(smaller, ["s", "n"]).select("s", "n", "b", (F.col("within") + F.col("smaller")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("s", "n", "b").orderBy("k"))
    ranked = docs.withColumn("r", rank).join(before, ["s", "n", "b"])
    at = F.col("before") + F.col("r")
    u = _offset(F.col("s"), seed)
    uses = F.floor(at * F.col("copies") + u) - F.floor((at - 1) * F.col("copies") + u)
    used = ranked.withColumn("uses", uses.cast("int")).where("uses > 0")
    return used.select(F.col("k").alias(key), F.col("s").alias(source), F.col("n").alias(size), F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))


def reached_shares(mixture: DataFrame, budget: DataFrame, source: str = "source", size: str = "n_tokens") -> DataFrame:
    """Per listed source: target_share, the size used, its share of the target total and of the mixture, short."""
    used = mixture.groupBy(F.col(source).alias("s")).agg(F.sum(size).alias("used"))
    rows = budget.join(used, budget[source] == used["s"], "left").drop("s").withColumn("used", F.coalesce("used", F.lit(0)))
    whole = F.sum("used").over(Window.partitionBy(F.lit(1)))
    return rows.withColumn("share_of_target_total", F.when(F.col("total") > 0, F.col("used") / F.col("total"))).withColumn("reached_share", F.when(whole > 0, F.col("used") / whole)).select(source, "target_share", "max_repeats", "own", "wanted", "used", "share_of_target_total", "reached_share", "short")
