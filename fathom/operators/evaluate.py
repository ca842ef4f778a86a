"""How well retrieval does: best rank of the expected code, and counts of outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, PARTIAL = 3, 5


def classify_rank(rank: Column) -> Column:
    """PASS up to rank 3, PARTIAL up to 5, FAIL beyond or without a rank."""
    return F.when(rank <= PASS, "PASS").when(rank <= PARTIAL, "PARTIAL").otherwise("FAIL")


def best_ranks(cases: DataFrame, results: DataFrame, case: str = "case_id", item: str = "item") -> DataFrame:
    """(case, rank, result) of every case(case, item): the smallest rank up to 5 at which the item was retrieved."""
    hits = cases.join(results.where(F.col("rank") <= PARTIAL), [case, item], "left")
    return hits.groupBy(case).agg(F.min("rank").alias("rank")).withColumn("result", classify_rank(F.col("rank")))


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row: n_pass, n_partial, n_fail, and whether all passed."""
    n = {name: F.count_if(F.col("result") == name.upper()) for name in ("pass", "partial", "fail")}
    return results.agg(*[v.alias(f"n_{k}") for k, v in n.items()], ((n["partial"] == 0) & (n["fail"] == 0)).alias("successful"))
