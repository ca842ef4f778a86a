"""Walks over dependency edges: bounded hops as joins, limits as window ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.paths import folder
from fathom.functions.predicates import is_infrastructure, query_mentions
from fathom.functions.text import dedupe_ignoring_case
from fathom.functions.vocabulary import INFRASTRUCTURE_QUERY_WORDS, TEST_QUERY_WORDS


def forward(edges: DataFrame, src: str = "src", dst: str = "dst", order: str = "dep_ord") -> DataFrame:
    """Each pair of neighbours once, with its first place among the source's dependencies."""
    return edges.where(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.min(order).alias(order))


def reverse(edges: DataFrame, src: str = "src", dst: str = "dst", name: str = "matched_name") -> DataFrame:
    """Callers of each chunk: (dst, name, src), each once."""
    return edges.where(F.col(src) != F.col(dst)).select(dst, name, src).distinct()


def best_per_key(rows: DataFrame, keys: tuple[str, ...], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def first_per_group(rows: DataFrame, keys: tuple[str, ...], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def two_hop_best(seeds: DataFrame, edges: DataFrame, key: str = "seed", src: str = "src", dst: str = "dst", per_hop: int = 10) -> DataFrame:
    """(key, node, depth, paths) of nodes within two hops of each seed(key, src); per hop the per_hop nodes with most paths.

    Ties go to the smaller node. Only kept nodes lead on; a node keeps its smaller depth.
    """
    hop1 = seeds.join(edges, src).groupBy(key, F.col(dst).alias("node")).agg(F.count("*").alias("paths"))
    hop1 = first_per_group(hop1, (key,), per_hop, F.col("paths").desc(), F.col("node"))
    hop2 = hop1.select(key, F.col("node").alias(src)).join(edges, src).groupBy(key, F.col(dst).alias("node")).agg(F.count("*").alias("paths"))
    hop2 = hop2.join(hop1.select(key, "node"), [key, "node"], "left_anti")
    hop2 = first_per_group(hop2, (key,), per_hop, F.col("paths").desc(), F.col("node"))
    return hop1.withColumn("depth", F.lit(1)).unionByName(hop2.withColumn("depth", F.lit(2))).select(key, "node", "depth", "paths")


def related_context(results: DataFrame, queries: DataFrame, edges: DataFrame, chunks: DataFrame, sources: int = 2, limit: int = 5, least: int = 2, max_depth: int = 2, per_hop: int = 10, infrastructure: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that the first results depend on: (query_id, chunk_id, score, depth, rank).

    results(query_id, chunk_id, rank) are the ranked chunks, queries(query_id, query) their texts. From each of the first
    sources chunks the walk takes per hop the per_hop best candidates that are no result and not visited; tests count only if the
    query asks for them. A candidate scores for the same file 3, the exact name 2 or the qualified name 1, the same parent 1,
    the same folder as source and hop 1 each, less 2 for infrastructure, and 2 at depth 1, 1 at depth 2. Scores below least
    go, the limit best stay; ties by depth, path, type, parent, name, line, id.
    """
    c = F.col
    facts = chunks.select(c("id").alias("node"), c("file_path").alias("path"), "chunk_type", c("name").alias("node_name"), F.coalesce("parent", F.lit("")).alias("node_parent"), "start_line", c("is_test"), folder(c("file_path")).alias("dir"), is_infrastructure(c("file_path"), infrastructure).alias("infra"))
    asks = queries.select("query_id", query_mentions(c("query"), TEST_QUERY_WORDS).alias("ask_tests"), query_mentions(c("query"), INFRASTRUCTURE_QUERY_WORDS).alias("ask_infra"))
    start = results.where(c("rank") <= sources).join(asks, "query_id").join(facts.select(c("node").alias("chunk_id"), c("path").alias("s_path"), c("node_parent").alias("s_parent"), c("dir").alias("s_dir")), "chunk_id")
    start = start.select("query_id", c("chunk_id").alias("source"), "s_path", "s_parent", "s_dir", "ask_tests", "ask_infra")
    frontier = start.select("*", c("source").alias("hop"), c("s_path").alias("h_path"), c("s_dir").alias("h_dir"))
    visited = start.select("query_id", "source", c("source").alias("node"))
    kept: DataFrame | None = None
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges.select(c("src").alias("hop"), "dep_ord", "matched_name", c("dst").alias("node")), "hop").join(facts, "node")
        step = step.where(c("ask_tests") | ~c("is_test"))
        step = step.join(results.select("query_id", c("chunk_id").alias("node")), ["query_id", "node"], "left_anti").join(visited, ["query_id", "source", "node"], "left_anti")
        score = (
            F.when(c("path") == c("s_path"), 3).otherwise(0)
            + F.when(c("matched_name") == c("node_name"), 2).when((c("node_parent") != "") & (c("matched_name") == F.concat_ws(".", "node_parent", "node_name")), 1).otherwise(0)
            + F.when((c("s_parent") != "") & (c("node_parent") == c("s_parent")), 1).otherwise(0)
            + F.when(c("infra") & ~c("ask_infra"), -2).otherwise(0)
            + F.when((c("path") != c("s_path")) & (c("dir") == c("s_dir")), 1).otherwise(0)
            + F.when((c("path") != c("h_path")) & (c("dir") == c("h_dir")), 1).otherwise(0)
            + max(0, 3 - depth)
        )
        best = best_per_key(step.withColumn("score", score), ("query_id", "source", "node"), c("score").desc(), c("h_path"), c("hop"), c("dep_ord"))
        best = first_per_group(best, ("query_id", "source"), per_hop, c("score").desc(), c("path"), c("node")).withColumn("depth", F.lit(depth))
        frontier = best.select("query_id", "source", "s_path", "s_parent", "s_dir", "ask_tests", "ask_infra", c("node").alias("hop"), c("path").alias("h_path"), c("dir").alias("h_dir"))
        visited = visited.unionByName(best.select("query_id", "source", "node"))
        rows = best.select("query_id", "node", "score", "depth", "path", "chunk_type", "node_parent", "node_name", "start_line")
        kept = rows if kept is None else kept.unionByName(rows)
    order = [c("score").desc(), c("depth"), c("path"), c("chunk_type"), c("node_parent"), c("node_name"), c("start_line"), c("node")]
    best = best_per_key(kept, ("query_id", "node"), c("score").desc(), c("depth")).where(c("score") >= least)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(c("rank") <= limit).select("query_id", c("node").alias("chunk_id"), "score", "depth", "rank")


def merge_results(*parts: DataFrame, key: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Rows (key, item, score, reasons) of several rankings as one: best score, reasons in order of first appearance."""
    rows = None
    for n, part in enumerate(parts):
        p = part.select(key, item, "score", "reasons", F.lit(n).alias("part"))
        rows = p if rows is None else rows.unionByName(p)
    g = rows.groupBy(key, item).agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("part", "reasons"))).alias("said"))
    return g.withColumn("reasons", dedupe_ignoring_case(F.flatten(F.transform("said", lambda x: x["reasons"])))).drop("said")
