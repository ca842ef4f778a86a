"""Search, investigation and diagnosis as pipelines over chunks, edges, and the questions of many users at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions.paths import is_test_path
from fathom.functions.predicates import chunk_features
from fathom.functions.text import display_name, one_line
from fathom.functions.vectors import block_top_k, hashing_embedding
from fathom.functions.vocabulary import INVESTIGATION_INTENT
from fathom.operators import callpath, explain, failures as fail, graph, resolve, scoring
from fathom.sources.tables import settle

SHOWN = ("chunk_id", "name", "chunk_type", "parent", "file_path", "start_line", "end_line", "is_test", "dependencies", "source_code")


class Corpus:
    """Chunks(id, repo, ...CHUNK_SCHEMA, embedding) and their edges, made once; plain has what every question needs, chunks
    the features of a diagnosis too, which are made when they are asked for."""

    def __init__(self, chunks: DataFrame, infrastructure: tuple[str, ...] = ()):
        self.infrastructure = infrastructure
        chunks = chunks.where(F.col("id").isNotNull() & F.col("name").isNotNull() & F.col("file_path").isNotNull()).dropDuplicates(["id"])
        self._whole = settle(chunks, "chunks")
        self.edges = settle(resolve.edges(self._whole), "edges")
        self.plain = self._whole.withColumnRenamed("id", "chunk_id").withColumn("is_test", is_test_path(F.col("file_path")))

    @cached_property
    def chunks(self) -> DataFrame:
        feats = scoring.investigation_features(callpath.call_features(chunk_features(self._whole)))
        return settle(feats.withColumnRenamed("id", "chunk_id").drop("imports", "decorators"), "features")

    def named(self, *columns: str) -> DataFrame:
        return self.plain.select("chunk_id", *columns)


def embed_queries(df: DataFrame, text: str, dimensions: int = 64) -> DataFrame:
    return df.withColumn("embedding", hashing_embedding(F.col(text), dimensions))


def _show(corpus: Corpus, rows: DataFrame, key: str) -> DataFrame:
    c = F.col
    shown = rows.join(corpus.plain.select(*SHOWN), "chunk_id")
    return shown.select(key, "kind", "rank", "chunk_id", display_name(c("name"), c("parent"), c("chunk_type")).alias("name"), c("chunk_type"), F.translate("file_path", "\\", "/").alias("file_path"), "start_line", "end_line", "score", "reasons")


def _with_related(corpus: Corpus, likely: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Likely rows (key, chunk_id, rank, score, reasons) and the related ones that they lead to."""
    likely = settle(likely, "likely")
    rel = graph.related_context(likely.select(F.col(key).alias("query_id"), "chunk_id", "rank"), queries.select(F.col(key).alias("query_id"), "query"), corpus.edges, corpus.plain.withColumnRenamed("chunk_id", "id"), infrastructure=corpus.infrastructure)
    rel = rel.select(F.col("query_id").alias(key), "chunk_id", "rank", F.lit(None).cast("double").alias("score"), F.array(F.lit("dependency context")).alias("reasons"), F.lit("related").alias("kind"))
    return likely.select(key, "chunk_id", "rank", "score", "reasons", F.lit("semantic").alias("kind")).unionByName(rel)


def search(corpus: Corpus, queries: DataFrame, k: int = 5) -> DataFrame:
    """Answers to queries(query_id, query): the k most similar chunks and up to five that they depend on."""
    q = queries.select("query_id", one_line(F.col("query")).alias("query")).where("query <> ''")
    return answers(corpus, embed_queries(q, "query"), k)


def answers(corpus: Corpus, questions: DataFrame, k: int = 5) -> DataFrame:
    """As search, for questions(query_id, query, embedding) that have their vectors; cosines count to six digits."""
    hits = block_top_k(corpus.plain, questions, k, digits=6)
    likely = hits.withColumn("reasons", F.array(F.lit("semantic match")))
    return _show(corpus, _with_related(corpus, likely, questions, "query_id"), "query_id")


def investigate(corpus: Corpus, queries: DataFrame, k: int = 5, repo: str | None = None) -> DataFrame:
    """As search, for bug descriptions: a pool of max(8k, 30) chunks is ranked anew by what their code does.

    Blank descriptions have no answer. With repo, a query(query_id, query, repo) meets only chunks of its repository.
    """
    q = queries.select("query_id", one_line(F.col("query")).alias("query"), *([repo] if repo else [])).where("query <> ''")
    text = F.concat(F.lit("Bug description:\n"), F.col("query"), F.lit(f"\n\nInvestigation intent:\n{INVESTIGATION_INTENT}\n"))
    return ranked_answers(corpus, embed_queries(q.withColumn("text", text), "text"), k, repo)


def ranked_answers(corpus: Corpus, q: DataFrame, k: int = 5, repo: str | None = None) -> DataFrame:
    """As investigate, for questions(query_id, query, embedding) that have their vectors."""
    pool = settle(block_top_k(corpus.plain, q, max(8 * k, 30) if k > 0 else 0, same=repo, digits=6).select("query_id", "chunk_id", F.col("score").alias("base_score")), "pool")
    features = scoring.investigation_evidence(scoring.investigation_features(chunk_features(corpus.plain.join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi"))))
    asked = scoring.description_terms(q.select("query_id", F.col("query").alias("description")))
    pairs = pool.join(asked, "query_id").join(features, "chunk_id")
    scored = scoring.ranked(scoring.investigation_score(pairs), "query_id", ties=("is_test", "path_key", "start_line", "chunk_id", "name"))
    likely = scored.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank", "score", "reasons")
    return _show(corpus, _with_related(corpus, likely, q, "query_id"), "query_id")


def diagnose(corpus: Corpus, failures: DataFrame, k: int = 5, repo: str | None = "repo") -> DataFrame:
    """The code behind failing tests: failures(failure_id, repo, test_name, file_path, line_number, error_type, message, traceback).

    A pool of max(8k, 40) similar chunks is scored by the failure's signals, widened by call paths, merged, and cut to k with
    source before tests; related chunks follow. Rows: (failure_id, kind, rank, chunk_id, ..., score, reasons).
    """
    c = F.col
    f = fail.with_signals(failures.where(c("failure_id").isNotNull()).dropDuplicates(["failure_id"]))
    f = settle(f.withColumn("query", fail.failure_query(f)), "failures")
    pool = block_top_k(corpus.plain, embed_queries(f.select("failure_id", "query", *([repo] if repo else [])), "query"), max(k, 8 * k, 40) if k > 0 else 0, query_key="failure_id", same=repo)
    facts = f.drop("repo", "file_path", "query")
    chunks = corpus.chunks.drop("embedding", "shown_terms", "terms")
    join = lambda rows: scoring.pair_evidence(rows.join(facts, "failure_id").join(chunks, "chunk_id"))
    scored = scoring.failure_components(join(pool.select("failure_id", "chunk_id", c("score").alias("base_score"))))
    ranked = settle(scoring.ranked(scored, "failure_id").select("failure_id", "chunk_id", "score", "rank"), "ranked")
    paths = callpath.call_path_context(ranked, corpus.edges, facts, chunks)
    none = F.array().cast("array<string>")
    merged = settle(graph.merge_results(ranked.withColumn("reasons", none), paths, key="failure_id"), "merged")
    explained = scoring.failure_components(join(merged.select("failure_id", "chunk_id", c("score").alias("total"), c("reasons").alias("extra"))).withColumn("zero", F.lit(0.0)), base="zero", extra="extra")
    explained = explain.with_reasons(explained).select("failure_id", "chunk_id", c("total").alias("score"), "reasons", "strong", "is_test", "path_key", "start_line", "infra_failure")
    likely = scoring.select_source_first(scoring.ranked(explained, "failure_id"), "failure_id", k).select("failure_id", "chunk_id", "rank", "score", "reasons")
    return _show(corpus, _with_related(corpus, likely, f.select("failure_id", "query"), "failure_id"), "failure_id")


def as_json(results: DataFrame, key: str, query: DataFrame | None = None) -> DataFrame:
    """(key, payload): one JSON document per question with its likely code and related context."""
    item = F.struct("rank", "name", F.col("chunk_type").alias("kind"), "file_path", "start_line", "end_line", F.col("kind").alias("source"), "score", "reasons")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
    g = results.groupBy(key).agg(of("semantic").alias("likely_relevant_code"), of("related").alias("related_context"))
    if query is not None:
        g = g.join(query, key)
    return g.select(key, F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit("ok").alias("status"), *[x for x in g.columns if x != key])).alias("payload"))
