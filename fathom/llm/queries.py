"""The queries of the numbered problems, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import mixture
from fathom.llm.common import shared_folder, table
from fathom.llm.credentials import find_credentials
from fathom.llm.handwritten import code_files, not_handwritten
from fathom.llm.languages import mislabelled, passages
from fathom.llm.neighbours import MIN_COSINE, most_similar, similar_pairs
from fathom.llm.parse_files import rates, verdicts
from fathom.llm.split_pieces import split_oversized
from fathom.llm.tokenize import count_tokens, encode
from fathom.llm.top_groups import top_per_group


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "code_chunks"), keys=("id", "file_path")).dropDuplicates(["id", "piece_no"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_oversized(table(spark, d, "code_chunks"))
    return pieces.where("piece_no = 1").select("id").distinct()


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return top_per_group(table(spark, d, "investigation_results"), "query_id", "chunk_id", "score", ("file_path", "start_line"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top(spark, d).select("query_id", "chunk_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return verdicts(table(spark, d, "source_files")).where("not accepted").select("file_id").distinct()


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return rates(verdicts(table(spark, d, "source_files")))


def p3_faults(spark: SparkSession, d: str) -> DataFrame:
    rows = verdicts(table(spark, d, "source_files"), keep=("file_id", "file_path")).where("not accepted").dropDuplicates(["file_id"])
    return rows.select("file_id", "file_path", "language", "first_line", "first_fault", F.array_join("faults", "; ").alias("faults"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    files = code_files(table(spark, d, "code_chunks"), table(spark, d, "source_files"))
    return not_handwritten(files, table(spark, d, "upstream_sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).where("reason is not null").select(F.col("path").alias("file_path"))


def _code_texts(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, body: str, owner: Column | None = None) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("tbl"), F.col(key).cast("string").alias("row_key"), (F.lit(None).cast("string") if owner is None else owner).alias("owner"), F.col(body).alias("body"))

    # contexts quote chunks and have no owner of their own
    return of("code_chunks", "id", "source_code", F.coalesce("repo", F.lit(""))).unionAll(of("llm_chunk_contexts", "context_id", "code_snippet")).unionAll(of("llm_investigation_chunk_contexts", "context_id", "code_snippet"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return find_credentials(_code_texts(spark, d))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return find_credentials(_code_texts(spark, d), redact=True)


def p6_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return most_similar(table(spark, d, "chunk_vectors")).withColumn("cosine", F.round("cosine", 3))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(most_similar(table(spark, d, "chunk_vectors"), min_cosine=MIN_COSINE))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return count_tokens(table(spark, d, "documents"), keep=("doc_id", "source"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # the sizes are used three times: written once, where the executors share them
    folder = shared_folder(spark, "sizes")
    _sizes(spark, d).write.parquet(folder)
    sizes = spark.read.parquet(folder)
    budget = mixture.source_budget(sizes, table(spark, d, "source_targets"))
    return mixture.systematic_copies(sizes, budget), budget


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.reached_shares(*_mixture(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).where("short").select("source")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return passages(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(p9_passages(spark, d)).select("doc_id", "lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_top": p2_top,
    "p3_found": p3_found,
    "p3_rates": p3_rates,
    "p3_faults": p3_faults,
    "p4_found": p4_found,
    "p4_files": p4_files,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_neighbours": p6_neighbours,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
}

_P2 = """
    SELECT * FROM (
        SELECT query_id, chunk_id, score, file_path, start_line, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, start_line, chunk_id)::INT AS place
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY score DESC, file_path, start_line) AS k
              FROM investigation_results WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL)
        WHERE k = 1) WHERE place <= 10
"""

# brute force; vectors of one direction to five digits are equally similar
_P6 = """
    WITH d AS (SELECT DISTINCT ON (vec_id) vec_id, embedding::DOUBLE[] AS e FROM chunk_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    n AS (SELECT vec_id, list_transform(e, lambda x: x / n) AS u FROM (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM d) WHERE n > 0),
    u AS (SELECT vec_id, first_value(u) OVER (PARTITION BY list_transform(u, lambda x: round(x, 5) + 0.0) ORDER BY vec_id) AS u, min(vec_id) OVER (PARTITION BY list_transform(u, lambda x: round(x, 5) + 0.0)) AS of FROM n),
    s AS (SELECT a.vec_id, b.vec_id AS other, CASE WHEN a.of = b.of THEN 1.0 ELSE list_inner_product(a.u, b.u) END AS cosine FROM u a JOIN u b ON a.vec_id <> b.vec_id),
    r AS (SELECT vec_id, other, cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other)::INT AS rank FROM s)
"""

ORACLE_SQL: dict[str, str] = {
    "p1_found": "SELECT DISTINCT id FROM code_chunks WHERE length(source_code) > 3000 OR length(source_code) - length(replace(source_code, chr(10), '')) + 1 > 80",
    "p2_found": f"SELECT query_id, chunk_id FROM ({_P2})",
    "p2_top": f"SELECT query_id, chunk_id, score, file_path, start_line, place AS rank FROM ({_P2})",
    "p6_found": f"{_P6} SELECT DISTINCT least(vec_id, other) AS vec_id_a, greatest(vec_id, other) AS vec_id_b FROM r WHERE rank <= 5 AND cosine >= 0.85",
    "p6_neighbours": f"{_P6} SELECT vec_id, rank, other, round(cosine, 3) AS cosine FROM r WHERE rank <= 5",
}
