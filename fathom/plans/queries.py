"""The queries of the engine's own operators over the given tables, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import paths, text
from fathom.functions import vocabulary as V
from fathom.functions.predicates import bare_name, chunk_features, contains_raise, data_access, has_validation_name, is_constructor, query_mentions
from fathom.functions.vectors import block_top_k, norm
from fathom.operators import evaluate, explain, failures, graph, packets, resolve, scoring
from fathom.plans import api, sql
from fathom.sources import extract, index
from fathom.sources.tables import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def query(statement: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if statement:
            ORACLE_SQL[f.__name__] = statement
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def joined(values: Column) -> Column:
    return F.array_join(F.array_sort(values), " ")


def once(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    """The rows of a table without repeated ones, which are equal but for the time of their delivery."""
    return table(spark, d, name).dropDuplicates([key])


_pieces, normal_sql, is_test_sql, listed, strip_sql, SPACE = sql.pieces, sql.normal, sql.is_test, sql.listed, sql.strip, sql.SPACE


# text and paths


@query(f"SELECT doc_id, len({_pieces('text')})::BIGINT AS n_tokens, array_to_string(list_sort({_pieces('text')}), ' ') AS tokens FROM documents")
def identifier_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", text.identifier_tokens(c("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), joined(c("t")).alias("tokens"))


@query(f"SELECT DISTINCT file_id, {normal_sql('file_path')} AS path_key, {is_test_sql('file_path')} AS is_test, CASE WHEN contains(file_path, '/') THEN regexp_extract(file_path, '^(.*)/[^/]*$', 1) ELSE '.' END AS folder FROM source_files")
def path_predicates(spark: SparkSession, d: str) -> DataFrame:
    p = c("file_path")
    return table(spark, d, "source_files").select("file_id", paths.normalize_path(p).alias("path_key"), paths.is_test_path(p).alias("is_test"), paths.folder(p).alias("folder")).distinct()


@query("""
    WITH f AS (SELECT DISTINCT repo, file_path, regexp_replace(file_path, '\\.[^./]*$', '') AS bare FROM source_files),
    p AS (SELECT repo, file_path, list_filter(string_split(bare, '/'), lambda x: x <> '' AND x <> '.') AS q FROM f),
    s AS (SELECT repo, file_path, CASE WHEN q[-1] = '__init__' THEN q[1:len(q) - 1] ELSE q END AS q FROM p),
    m AS (SELECT DISTINCT repo, file_path, array_to_string(q[i:], '.') AS module FROM s, unnest(range(1, len(q) + 1)) AS r(i))
    SELECT repo, module, count(*)::BIGINT AS files, min(file_path) AS first_file FROM m GROUP BY repo, module
""")
def suffix_resolve(spark: SparkSession, d: str) -> DataFrame:
    files = resolve.module_files(table(spark, d, "source_files"))
    return files.groupBy("repo", "module").agg(F.count("*").alias("files"), F.min("target_file").alias("first_file"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS flat, length(text)::BIGINT AS n FROM documents WHERE text IS NOT NULL")
def one_line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.one_line(c("text")).alias("flat"), F.length("text").cast("bigint").alias("n"))


@query(f"SELECT DISTINCT id, CASE WHEN length(source_code) <= 200 THEN source_code ELSE regexp_replace(source_code[1:197], '{SPACE}+$', '') || '...' END AS short FROM code_chunks")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "code_chunks").select("id", text.truncate_text(c("source_code"), 200).alias("short")).distinct()


_NAME = "[\\w.-]*(?:api[_-]?key|token|password|secret)[\\w.-]*"
_QUOTED = "regexp_replace({t}, '([\"'']?\\b" + _NAME + "\\b[\"'']?\\s*[:=]\\s*)(\"[^\"\\n]*\"|''[^''\\n]*'')', '\\1' || chr(1) || '\\2', 'gi')"
_MASKED = "regexp_replace(regexp_replace({q}, chr(1) || '\"[^\"\\n]*\"', '\"[REDACTED]\"', 'g'), chr(1) || '''[^''\\n]*''', '''[REDACTED]''', 'g')"
_BARE = "regexp_replace({m}, '(\\b" + _NAME + "\\b\\s*=\\s*)([^\\s,;)}\\]]+)', '\\1[REDACTED]', 'gi')"
_BEARER = "regexp_replace(regexp_replace({b}, '(authorization\\s*:\\s*bearer\\s+)([A-Za-z0-9._~+/=-]+)', '\\1[REDACTED]', 'gi'), '(\\bbearer\\s+)([A-Za-z0-9._~+/=-]+)', '\\1[REDACTED]', 'gi')"
_REDACT = lambda t: _BEARER.replace("{b}", _BARE.replace("{m}", _MASKED.replace("{q}", _QUOTED.replace("{t}", t))))


@query(f"SELECT DISTINCT context_id, {_REDACT('code_snippet')} AS snippet FROM llm_chunk_contexts WHERE code_snippet IS NOT NULL")
def redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "llm_chunk_contexts").where("code_snippet is not null").select("context_id", text.redact(c("code_snippet")).alias("snippet")).distinct()


@query("SELECT DISTINCT result_id, array_to_string(list_filter(reasons, lambda x, i: list_position(list_transform(reasons, lambda y: lower(y)), lower(x)) = i), ';') AS said FROM investigation_results")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "investigation_results").select("result_id", F.array_join(text.dedupe_ignoring_case(c("reasons")), ";").alias("said")).distinct()


@query(f"SELECT DISTINCT query_id, list_has_any(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> ''), {listed(V.TEST_QUERY_WORDS)}) AS asks_tests, list_has_any(list_filter(regexp_split_to_array(lower(query), '[^a-z0-9]+'), lambda w: w <> ''), {listed(V.INFRASTRUCTURE_QUERY_WORDS)}) AS asks_index FROM investigation_results WHERE query IS NOT NULL")
def query_intent(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "investigation_results").where("query is not null").select("query_id", "query").distinct()
    return rows.select("query_id", query_mentions(c("query"), V.TEST_QUERY_WORDS).alias("asks_tests"), query_mentions(c("query"), V.INFRASTRUCTURE_QUERY_WORDS).alias("asks_index")).distinct()


# predicates on code

_BARE_NAME = "lower(regexp_replace(name, '^_+', ''))"


@query(f"""
    SELECT DISTINCT id, regexp_matches({_BARE_NAME}, '^(?:can(?:_|$)|(?:validate|check|ensure|guard|allow|authorize))') AS guard,
        regexp_matches(coalesce(source_code, ''), '(?i)\\braise\\b') AS raises, lower(name) IN ('__init__', 'init', 'initialize') AS constructor,
        (list_has_any(string_split({normal_sql('file_path')}, '/'), {listed(V.DATA_ACCESS_FOLDERS)}) OR regexp_matches(lower(coalesce(parent, '')), '{"|".join(V.DATA_ACCESS_PARENTS)}'))
            AND regexp_matches({_BARE_NAME}, '^(?:{"|".join(V.CRUD_PREFIXES)})(?:_|$)') AS data_access,
        chunk_type IN ('function', 'method') AND regexp_matches({_BARE_NAME}, '^(?:{"|".join(V.PAIRED_WORDS)})') AS paired
    FROM code_chunks
""")
def chunk_predicates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_chunks")
    paired = c("chunk_type").isin("function", "method") & bare_name(c("name")).rlike(rf"^(?:{'|'.join(V.PAIRED_WORDS)})")
    return rows.select("id", has_validation_name(c("name")).alias("guard"), contains_raise(text.no_null(c("source_code"))).alias("raises"), is_constructor(c("name")).alias("constructor"), data_access(c("file_path"), c("parent"), c("name")).alias("data_access"), paired.alias("paired")).distinct()


@query(sql.SIGNALS)
def chunk_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = chunk_features(once(spark, d, "code_chunks", "id"))
    return rows.select("id", "guard_name", "calls_guard", joined(c("called_pairs")).alias("called_pairs"), "state_logic", "filter_logic", "business_role", "route_passthrough", "exception_class", F.size("tokens").alias("n_tokens"))


@query("SELECT repo, name, min(id) AS id FROM (SELECT DISTINCT repo, name, id FROM code_chunks WHERE chunk_type = 'method') GROUP BY repo, name HAVING count(*) = 1")
def unique_methods(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_chunks").where("chunk_type = 'method'").select("repo", "name", "id").distinct()
    return rows.groupBy("repo", "name").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").drop("n")


@query("SELECT repo, chunk_type, count(DISTINCT id)::BIGINT AS chunks, count(DISTINCT file_path)::BIGINT AS files, count(DISTINCT CASE WHEN len(decorators) > 0 THEN id END)::BIGINT AS decorated FROM code_chunks GROUP BY repo, chunk_type")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "code_chunks")
    return rows.groupBy("repo", "chunk_type").agg(F.countDistinct("id").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.when(F.size("decorators") > 0, c("id"))).alias("decorated"))


# vectors and ranks

_COSINE = "round(CASE WHEN q.n * v.n = 0 THEN 0 ELSE list_inner_product(q.e, v.e) / (q.n * v.n) END, 6)"
_VECTORS = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"


@query(f"""
    WITH {_VECTORS}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, {_COSINE} AS score FROM v, (SELECT * FROM v WHERE vec_id % 20 = 0) q)
    SELECT * FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::INT AS rank FROM s) WHERE rank <= 5
""")
def batch_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # the stated query set, against all rows
    found = block_top_k(rows.withColumnRenamed("vec_id", "item_id"), queries, 5, "item_id", digits=6)
    return found.select("query_id", "item_id", "score", "rank")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings")
def vector_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(c("embedding")), 6).alias("length"))


_RESULTS = "r AS (SELECT DISTINCT ON (result_id) * FROM investigation_results)"
_OK = "score IS NOT NULL AND NOT isnan(score)"


@query(f"""
    WITH {_RESULTS}, t AS (SELECT result_id, query_id, len(list_intersect({_pieces('query')}, {_pieces('name')}))::BIGINT AS shared FROM r WHERE query IS NOT NULL)
    SELECT query_id, result_id, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, result_id)::INT AS rank FROM t) WHERE rank <= 5
""")
def term_overlap_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "investigation_results", "result_id").where("query is not null")
    shared = F.size(F.array_intersect(text.identifier_tokens(c("query")), text.identifier_tokens(c("name")))).cast("bigint")
    rows = rows.select("query_id", "result_id", shared.alias("shared"))
    return graph.first_per_group(scoring.ranked(rows, "query_id", "shared", ("result_id",)), ("query_id",), 5, c("rank"))


@query(f"""
    WITH {_RESULTS}, t AS (SELECT query_id, result_id, round(score + CASE WHEN {is_test_sql('file_path')} THEN -1.25 ELSE 0.25 END + least(1.2, 0.12 * len(reasons)), 6) AS total, {is_test_sql('file_path')} AS is_test FROM r WHERE {_OK})
    SELECT query_id, result_id, total, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, is_test, result_id)::INT AS rank FROM t) WHERE rank <= 5
""")
def rerank_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "investigation_results", "result_id").where("score is not null and not isnan(score)").withColumn("is_test", paths.is_test_path(c("file_path")))
    parts = scoring.components(
        (F.lit(True), scoring.component("semantic_base_score", c("score"))),
        (c("is_test"), scoring.component("test_context", -1.25)),
        (~c("is_test"), scoring.component("source_context", 0.25)),
        (F.size("reasons") > 0, scoring.component("reasons", F.least(F.lit(1.2), F.size("reasons") * F.lit(0.12)))),
    )
    rows = rows.select("query_id", "result_id", "is_test", F.round(scoring.total(parts), 6).alias("total"))
    return scoring.ranked(rows, "query_id", "total", ("is_test", "result_id")).where("rank <= 5").select("query_id", "result_id", "total", "rank")


@query("""
    WITH t AS (SELECT event_id, [value, least(abs(value), 1.0) * 0.25, -0.35] AS v FROM events)
    SELECT event_id, round(list_sum(v), 6) AS total, round(CASE WHEN list_sum(v) <= 0.5 OR list_sum(v) <= 0 THEN list_sum(v) ELSE 0.5 END, 6) AS capped FROM t WHERE v[1] IS NOT NULL
""")
def score_components(spark: SparkSession, d: str) -> DataFrame:
    yes = F.lit(True)
    parts = scoring.components((yes, scoring.component("base", c("value"))), (yes, scoring.component("bonus", F.least(F.abs("value"), F.lit(1.0)) * 0.25)), (yes, scoring.component("penalty", -0.35)), (yes, scoring.component("silent", 9.0, contributes=False)))
    return table(spark, d, "events").where("value is not null").select("event_id", F.round(scoring.total(parts), 6).alias("total"), F.round(scoring.total(scoring.capped(parts, 0.5)), 6).alias("capped"))


_SELECTED = f"""
    WITH {_RESULTS}, t AS (SELECT query_id, result_id, {is_test_sql('file_path')} AS is_test, list_contains(reasons, 'called by top result') AS strong, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, result_id) AS k FROM r WHERE {_OK}),
    u AS (SELECT *, max((strong AND NOT is_test)::INT) OVER (PARTITION BY query_id) = 1 AND is_test AS late FROM t)
    SELECT query_id, result_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, k)::INT AS rank FROM u) WHERE rank <= 5
"""


@query(_SELECTED)
def source_first_select(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "investigation_results", "result_id").where("score is not null and not isnan(score)")
    rows = rows.select("query_id", "result_id", "score", paths.is_test_path(c("file_path")).alias("is_test"), F.array_contains("reasons", "called by top result").alias("strong"), F.lit(False).alias("infra_failure"))
    return scoring.select_source_first(scoring.ranked(rows, "query_id", ties=("result_id",)), "query_id", 5).select("query_id", "result_id", "rank")


@query(f"""
    WITH {_RESULTS} SELECT query_id, chunk_id, max(score) AS score, count(DISTINCT lower(reason))::BIGINT AS n_reasons
    FROM (SELECT query_id, chunk_id, score, unnest(CASE WHEN len(reasons) = 0 THEN [NULL] ELSE reasons END) AS reason FROM r WHERE {_OK}) GROUP BY query_id, chunk_id
""")
def merge_best(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "investigation_results", "result_id").where("score is not null and not isnan(score)")
    merged = graph.merge_results(rows.where("source = 'semantic'"), rows.where("source <> 'semantic'"))
    return merged.select("query_id", "chunk_id", "score", F.size("reasons").cast("bigint").alias("n_reasons"))


_CASES = "e AS (SELECT query_id, min(chunk_id) AS chunk_id FROM investigation_results WHERE query_id IS NOT NULL GROUP BY query_id), b AS (SELECT e.query_id, min(i.rank) AS rank FROM e LEFT JOIN investigation_results i ON i.query_id = e.query_id AND i.chunk_id = e.chunk_id AND i.rank <= 5 GROUP BY e.query_id), g AS (SELECT query_id, rank, CASE WHEN rank <= 3 THEN 'PASS' WHEN rank <= 5 THEN 'PARTIAL' ELSE 'FAIL' END AS result FROM b)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "investigation_results").where("query_id is not null")
    return evaluate.best_ranks(rows.groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id")), rows.select("query_id", "chunk_id", "rank"), "query_id", "chunk_id")


@query(f"WITH {_CASES} SELECT query_id, rank, result FROM g")
def rank_classify(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d)


@query(f"WITH {_CASES} SELECT count(*) FILTER (result = 'PASS')::BIGINT AS n_pass, count(*) FILTER (result = 'PARTIAL')::BIGINT AS n_partial, count(*) FILTER (result = 'FAIL')::BIGINT AS n_fail, count(*) FILTER (result <> 'PASS') = 0 AS successful FROM g")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_counts(_cases(spark, d))


# budgets

_CONTEXTS = "x AS (SELECT DISTINCT ON (context_id) context_id, failure_id, source_label, rank, coalesce(length(code_snippet), 0) AS size FROM llm_chunk_contexts)"


@query(f"WITH {_CONTEXTS} SELECT failure_id, context_id, running FROM (SELECT failure_id, context_id, sum(size) OVER (PARTITION BY failure_id ORDER BY rank, context_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM x) WHERE running + 200 <= 2000")
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "llm_chunk_contexts", "context_id").withColumn("size", F.length("code_snippet"))
    return packets.fit_budget(rows, "failure_id", "size", ("rank", "context_id"), 2000, 200).select("failure_id", "context_id", "running")


@query(f"WITH {_CONTEXTS} SELECT context_id FROM (SELECT context_id, row_number() OVER (PARTITION BY failure_id, source_label ORDER BY rank, context_id) AS k FROM x) WHERE k <= 2")
def per_kind_cap(spark: SparkSession, d: str) -> DataFrame:
    rows = once(spark, d, "llm_chunk_contexts", "context_id").withColumn("place", F.struct("rank", "context_id"))
    return packets.first_per_kind(rows, "failure_id", "source_label", "place", 2).select("context_id")


# graph and resolution


@query("SELECT l_partkey AS src, l_suppkey AS dst, min(l_linenumber) AS dep_ord FROM lineitem GROUP BY l_partkey, l_suppkey")
def forward_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), c("l_partkey").alias("src"), c("l_suppkey").alias("dst"), c("l_linenumber").alias("dep_ord"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return graph.forward(rows, "a", "b").select(F.substring("a", 2, 20).cast("bigint").alias("src"), F.substring("b", 2, 20).cast("bigint").alias("dst"), "dep_ord")


@query("SELECT DISTINCT 's' || l_suppkey AS dst, l_returnflag AS matched_name, 'p' || l_partkey AS src FROM lineitem")
def reverse_edges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), c("l_returnflag").alias("matched_name"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.reverse(rows)


@query("""
    WITH e AS (SELECT 'n' || s_nationkey AS src, 's' || s_suppkey AS dst FROM supplier UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
    h1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY paths DESC, node) AS k FROM (SELECT n_nationkey AS seed, dst AS node, count(*) AS paths FROM nation JOIN e ON e.src = 'n' || n_nationkey GROUP BY 1, 2)) WHERE k <= 10),
    h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY paths DESC, node) AS k FROM (SELECT h1.seed, e.dst AS node, count(*) AS paths FROM h1 JOIN e ON e.src = h1.node WHERE NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.node = e.dst) GROUP BY 1, 2)) WHERE k <= 10)
    SELECT seed, node, 1 AS depth, paths::BIGINT AS paths FROM h1 UNION ALL SELECT seed, node, 2, paths::BIGINT FROM h2
""")
def two_hop_best(spark: SparkSession, d: str) -> DataFrame:
    to = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    on = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    seeds = table(spark, d, "nation").select(c("n_nationkey").alias("seed"), F.concat(F.lit("n"), "n_nationkey").alias("src"))
    return graph.two_hop_best(seeds, to.unionAll(on))


@query("""
    WITH b AS (SELECT DISTINCT ON (id) id, repo, file_path, name, dependencies FROM code_chunks),
    deps AS (SELECT DISTINCT id AS src, repo, file_path, unnest(dependencies) AS dep FROM b),
    n AS (SELECT repo, name, count(*) AS n FROM b GROUP BY repo, name),
    x AS (SELECT d.src, d.dep, b.id AS dst, 1 AS rule FROM deps d JOIN b ON b.repo = d.repo AND b.file_path = d.file_path AND b.name = d.dep
          UNION ALL SELECT d.src, d.dep, b.id, 2 FROM deps d JOIN b ON b.repo = d.repo AND b.name = d.dep JOIN n ON n.repo = b.repo AND n.name = b.name AND n.n = 1)
    SELECT src, dep, dst, rule FROM (SELECT *, min(rule) OVER (PARTITION BY src, dep) AS first FROM x) WHERE rule = first
""")
def priority_resolve(spark: SparkSession, d: str) -> DataFrame:
    b = once(spark, d, "code_chunks", "id").select("id", "repo", "file_path", "name", "dependencies")
    deps = b.select(c("id").alias("src"), "repo", "file_path", F.explode("dependencies").alias("dep")).distinct()
    named = b.select(c("id").alias("dst"), "repo", "file_path", c("name").alias("dep"))
    only = named.withColumn("n", F.count("*").over(Window.partitionBy("repo", "dep"))).where("n = 1").drop("n", "file_path")
    near = deps.join(named, ["repo", "file_path", "dep"]).select("src", "dep", "dst", F.lit(1).alias("rule"))
    far = deps.join(only, ["repo", "dep"]).select("src", "dep", "dst", F.lit(2).alias("rule"))
    return resolve.first_rule(near.unionByName(far), ("src", "dep"))


@query(f"WITH {sql.EDGES} SELECT src, dep_ord, dep, matched_name, dst, rule FROM edges")
def dependency_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.edges(table(spark, d, "code_chunks"))


@query(f"WITH {sql.bindings('code_chunks')} SELECT * FROM bind")
def import_bindings(spark: SparkSession, d: str) -> DataFrame:
    return resolve.parse_imports(table(spark, d, "code_chunks").select("repo", "file_path", "imports"))


_TOP = "SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, max(score) AS score FROM investigation_results WHERE source = 'semantic' AND score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY query_id, chunk_id)) WHERE rank <= 5"


@query(sql.related(_TOP, "SELECT query_id, min(query) AS query FROM investigation_results WHERE query IS NOT NULL GROUP BY query_id"))
def related_chunks(spark: SparkSession, d: str) -> DataFrame:
    """What the five best chunks of every question lead to over dependencies."""
    rows = table(spark, d, "investigation_results").where("source = 'semantic' and score is not null and not isnan(score) and query_id is not null and chunk_id is not null")
    top = scoring.ranked(rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), "query_id", ties=("chunk_id",)).where("rank <= 5")
    chunks = _chunks(spark, d).where("name is not null and file_path is not null")
    facts = chunks.withColumn("file_path", paths.display_path(c("file_path"))).withColumn("is_test", paths.is_test_path(c("file_path")))
    return graph.related_context(settle(top, "top"), _questions(spark, d), settle(resolve.edges(chunks), "edges"), facts)


# files


@query("""
    WITH f AS (SELECT DISTINCT ON (file_id) * FROM source_files),
    a AS (SELECT file_path, sha256(source) AS h FROM f WHERE source IS NOT NULL AND mtime >= TIMESTAMP '2025-03-01'),
    b AS (SELECT file_path, sha256 AS h FROM f WHERE mtime < TIMESTAMP '2025-10-01')
    SELECT coalesce(a.file_path, b.file_path) AS rel_path, CASE WHEN b.file_path IS NULL THEN 'new' WHEN a.file_path IS NULL THEN 'deleted' WHEN a.h = b.h AND b.h <> '' THEN 'unchanged' ELSE 'changed' END AS status
    FROM a FULL JOIN b ON a.file_path = b.file_path
""")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    f = once(spark, d, "source_files", "file_id").withColumnRenamed("file_path", "rel_path")
    now = f.where("source is not null and mtime >= timestamp '2025-03-01'").select("rel_path", F.sha2("source", 256).alias("sha256"))
    return index.diff_files(now, f.where("mtime < timestamp '2025-10-01'"))


@query("SELECT count(*) FILTER (status = 'new')::BIGINT AS \"new\", count(*) FILTER (status = 'changed')::BIGINT AS \"changed\", count(*) FILTER (status = 'unchanged')::BIGINT AS \"unchanged\", count(*) FILTER (status = 'deleted')::BIGINT AS \"deleted\" FROM (" + ORACLE_SQL["incremental_diff"] + ")")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return index.diff_summary(incremental_diff(spark, d))


@query("""
    WITH f AS (SELECT DISTINCT file_id, len(string_split(source, chr(10))) AS n FROM source_files WHERE source IS NOT NULL),
    x AS (SELECT file_id, n, i::INT AS i FROM f, unnest(range(0, (n - 1) // 40 + 1)) AS r(i))
    SELECT file_id, (i + 1)::INT AS chunk_no, (i * 40 + 1)::INT AS start_line, least(i * 40 + 40, n)::INT AS end_line, sha1(file_id || ':lines::block:' || (i * 40 + 1) || ':' || least(i * 40 + 40, n)) AS id FROM x
""")
def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return extract.line_chunks(table(spark, d, "source_files").select("file_id", "source").dropDuplicates(["file_id"]), "file_id", "source", 40)


@query()
def extract_code_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = extract.extract_chunks(once(spark, d, "source_files", "file_id"), path="file_path")
    return chunks.select("id", "repo", "file_path", "chunk_type", "name", "parent", "start_line", "end_line", F.array_join("imports", "\n").alias("imports"), F.array_join("dependencies", " ").alias("dependencies"), F.array_join("decorators", "\n").alias("decorators"))


@query("""
    SELECT DISTINCT k.id, k.repo, k.file_path, k.chunk_type, k.name, k.parent, k.start_line, array_to_string(k.imports, chr(10)) AS imports
    FROM code_chunks k JOIN (SELECT DISTINCT file_path FROM source_files WHERE source IS NOT NULL) f ON f.file_path = k.file_path WHERE k.file_path LIKE '%.py' AND k.chunk_type IN ('class', 'function', 'method')
""")
def extracted_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that parsing the source files gives, held against those that the given table has of them."""
    chunks = extract.extract_chunks(table(spark, d, "source_files").where("source is not null").dropDuplicates(["file_id"]), path="file_path")
    return chunks.select("id", "repo", "file_path", "chunk_type", "name", "parent", "start_line", F.array_join("imports", "\n").alias("imports")).distinct()


@query(sql.EMBEDDING_TEXTS)
def embedding_texts(spark: SparkSession, d: str) -> DataFrame:
    """What is embedded of every chunk."""
    rows = _chunks(spark, d)
    return rows.select("id", index.embedding_text(rows).alias("content"))


@query()
def embedded_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = index.hashing_embedder(_chunks(spark, d))
    return rows.select("id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


# failures

_FAILURE_TEXT = "concat_ws(chr(10), coalesce(test_name, ''), coalesce(error_type, ''), coalesce(message, ''), coalesce(traceback, ''))"
_WITH_FORMS = sql.with_forms("t")


@query(f"""
    WITH f AS (SELECT DISTINCT ON (failure_id) * FROM test_failures), p AS (SELECT failure_id, {_FAILURE_TEXT} AS x, {_pieces(_FAILURE_TEXT)} AS t FROM f), v AS (SELECT failure_id, x, {_WITH_FORMS} AS t FROM p)
    SELECT failure_id, regexp_matches(x, '(?i)DID NOT RAISE\\s+<class\\s+''([^'']+)''>') AS did_not_raise, array_to_string(list_sort(list_intersect(t, {listed(V.BEHAVIORAL_WORDS)})), ' ') AS behavioral, array_to_string(list_sort(list_intersect(t, {listed(V.OPERATION_WORDS)})), ' ') AS operation,
        array_to_string(list_sort(list_filter(t, lambda w: length(w) > 2 AND NOT list_contains({listed(V.DOMAIN_STOP_WORDS)}, w))), ' ') AS domain FROM v
""")
def failure_signals(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.with_signals(once(spark, d, "test_failures", "failure_id"))
    return rows.select("failure_id", "did_not_raise", joined(c("behavioral")).alias("behavioral"), joined(c("operation")).alias("operation"), joined(c("domain")).alias("domain"))


@query(sql.HINTS)
def failure_hints(spark: SparkSession, d: str) -> DataFrame:
    rows = failures.with_signals(once(spark, d, "test_failures", "failure_id"))
    return rows.select("failure_id", F.array_join("trace_symbols", " ").alias("symbols"), F.array_join("source_hints", " ").alias("hints"), F.array_join("expected", " ").alias("expected"), failures.failure_query(rows).alias("query"))


_LINES = "l AS (SELECT doc_id, generate_subscripts(s, 1) AS line_no, unnest(s) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS s FROM documents WHERE text IS NOT NULL))"


@query(f"""
    WITH {_LINES}, a AS (SELECT doc_id, line_no, {strip_sql("line")} AS s FROM l), b AS (SELECT doc_id, line_no, regexp_extract(s, '^(\\w+) ', 1) AS outcome, {strip_sql("regexp_replace(s, '^\\w+ ', '')")} AS rest FROM a WHERE regexp_matches(s, '^(FAILED|ERROR) ')),
    e AS (SELECT doc_id AS log_id, line_no, outcome, {strip_sql("CASE WHEN strpos(rest, ' - ') > 0 THEN rest[1:strpos(rest, ' - ') - 1] ELSE rest END")} AS nodeid, {strip_sql("CASE WHEN strpos(rest, ' - ') > 0 THEN rest[strpos(rest, ' - ') + 3:] ELSE '' END")} AS message FROM b)
    SELECT log_id, line_no::INT AS line_no, outcome, nodeid, message FROM (SELECT *, row_number() OVER (PARTITION BY log_id, outcome, nodeid ORDER BY line_no) AS k FROM e WHERE nodeid <> '') WHERE k = 1
""")
def failed_tests(spark: SparkSession, d: str) -> DataFrame:
    return failures.summary_entries(_logs(spark, d)).select("log_id", "line_no", "outcome", "nodeid", "message")


def _logs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(c("doc_id").alias("log_id"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "line"))
    return rows.select("log_id", (c("n") + 1).alias("line_no"), "line")


@query(sql.PARSED)
def parsed_failures(spark: SparkSession, d: str) -> DataFrame:
    """The failures of test logs with their place and traceback; parse_failure_logs has their messages as well."""
    return failures.parse_logs(_logs(spark, d)).drop("message")


@query(sql.LOG_MESSAGES)
def parse_failure_logs(spark: SparkSession, d: str) -> DataFrame:
    return failures.parse_logs(_logs(spark, d))


_PLACED = "v AS (SELECT DISTINCT ON (v.chunk_id) v.vec_id, v.chunk_id, k.repo, v.embedding::DOUBLE[] AS e FROM chunk_vectors v JOIN (SELECT DISTINCT ON (id) id, repo FROM code_chunks) k ON k.id = v.chunk_id WHERE len(v.embedding) = 64 AND len(list_filter(v.embedding, lambda x: x IS NULL OR isnan(x))) = 0 ORDER BY v.chunk_id, v.vec_id), n AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM v)"


@query(f"""
    WITH {_PLACED}, s AS (SELECT q.vec_id AS query_id, n.chunk_id, round(CASE WHEN q.n * n.n = 0 THEN 0 ELSE list_inner_product(q.e, n.e) / (q.n * n.n) END, 6) AS score FROM n JOIN (SELECT * FROM n WHERE vec_id % 20 = 0) q ON q.repo = n.repo)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM s) WHERE rank <= 5
""")
def similar_in_repository(spark: SparkSession, d: str) -> DataFrame:
    """For every twentieth vector the five most similar chunks of its repository, by the search that questions use."""
    usable = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    rows = table(spark, d, "chunk_vectors").where(usable).join(once(spark, d, "code_chunks", "id").select(c("id").alias("chunk_id"), "repo"), "chunk_id")
    rows = settle(graph.best_per_key(rows, ("chunk_id",), c("vec_id")), "vectors")
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")  # the stated query set, against all rows
    return block_top_k(rows, queries, 5, same="repo", digits=6).select("query_id", "chunk_id", "score", "rank")


# questions


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    given = lambda n: F.coalesce(n, F.array().cast("array<string>")).alias(n)
    return once(spark, d, "code_chunks", "id").select("id", "repo", "file_path", "chunk_type", "name", "parent", "start_line", "end_line", "source_code", given("imports"), given("dependencies"), given("decorators"))


def _corpus(spark: SparkSession, d: str) -> api.Corpus:
    return api.Corpus(index.hashing_embedder(_chunks(spark, d)))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reasons", F.array_join("reasons", "; "))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "investigation_results").where("query is not null").groupBy("query_id").agg(F.min("query").alias("query"))


@query(sql.INVESTIGATION)
def investigation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every result of every question, scored anew by what its code does, with the reasons."""
    rows = table(spark, d, "investigation_results").where("score is not null and not isnan(score) and query_id is not null and chunk_id is not null")
    pairs = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("base_score")).join(_questions(spark, d).withColumnRenamed("query", "description"), "query_id")
    features = settle(scoring.investigation_features(chunk_features(_chunks(spark, d))).withColumnRenamed("id", "chunk_id"), "features")
    scored = scoring.investigation_score(pairs.join(features, "chunk_id"))
    return scored.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk that was kept for a failure with the components of its score."""
    rows = table(spark, d, "llm_chunk_contexts").where("score is not null and not isnan(score) and failure_id is not null and chunk_id is not null")
    pairs = rows.groupBy("failure_id", "chunk_id").agg(F.max("score").alias("base_score"))
    facts = settle(failures.with_signals(once(spark, d, "test_failures", "failure_id")).drop("repo", "file_path"), "failures")
    features = settle(chunk_features(_chunks(spark, d)).withColumnRenamed("id", "chunk_id"), "features")
    return scoring.failure_components(scoring.pair_evidence(pairs.join(facts, "failure_id").join(features, "chunk_id")))


@query(sql.FAILURE_SCORES)
def failure_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores by the failures' signals, with the names of their components."""
    return _scored(spark, d).select("failure_id", "chunk_id", F.round("score", 6).alias("score"), F.array_join(F.transform("parts", lambda p: p["name"]), ",").alias("parts"))


@query(sql.failure_reasons(explain.LABELS))
def failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    """What is told of every scored chunk."""
    rows = explain.with_reasons(_scored(spark, d).withColumn("extra", F.array().cast("array<string>")))
    return rows.select("failure_id", "chunk_id", F.array_join("reasons", "; ").alias("reasons"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """(chunk_id, vec_id, embedding): the given vector of every chunk, the one of the smallest id."""
    usable = (F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return graph.best_per_key(table(spark, d, "chunk_vectors").where(usable & c("chunk_id").isNotNull()), ("chunk_id",), c("vec_id")).select("chunk_id", "vec_id", "embedding")


def _asked(spark: SparkSession, d: str) -> tuple[api.Corpus, DataFrame]:
    """A corpus with the given vectors, and questions: every twentieth vector asks with its chunk's name, all are asked."""
    given = settle(_vectors(spark, d), "vectors")
    corpus = api.Corpus(_chunks(spark, d).join(given.select(c("chunk_id").alias("id"), "embedding"), "id", "left"))
    asked = given.where("vec_id % 20 = 0").join(corpus.named("name"), "chunk_id")  # the stated query set, against all rows
    return corpus, asked.select(c("vec_id").alias("query_id"), c("name").alias("query"), "embedding")


@query(sql.ANSWERS)
def search_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """Search with the given vectors."""
    return _shown(api.answers(*_asked(spark, d)))


@query(sql.RANKED_ANSWERS)
def investigate_by_vector(spark: SparkSession, d: str) -> DataFrame:
    """Investigation with the given vectors."""
    return _shown(api.ranked_answers(*_asked(spark, d))).withColumn("score", F.round("score", 6))


@query()
def search_code(spark: SparkSession, d: str) -> DataFrame:
    return _shown(api.search(_corpus(spark, d), _questions(spark, d)))


@query()
def investigate_code(spark: SparkSession, d: str) -> DataFrame:
    return _shown(api.investigate(_corpus(spark, d), _questions(spark, d)))


@query()
def diagnose_failures(spark: SparkSession, d: str) -> DataFrame:
    return _shown(api.diagnose(_corpus(spark, d), table(spark, d, "test_failures")))


def _kept(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that were kept for every failure; of equal ranks the smaller context goes first."""
    rows = once(spark, d, "llm_chunk_contexts", "context_id").withColumn("kind", F.when(c("source_label") == "related", "related").otherwise("semantic"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("failure_id", "kind").orderBy("rank", "context_id")))
    empty = F.array().cast("array<string>")
    return rows.select("failure_id", "kind", "rank", "chunk_id", "chunk_type", "name", F.lit(None).cast("string").alias("parent"), "file_path", paths.is_test_path(c("file_path")).alias("is_test"), "start_line", "end_line", "score", F.coalesce("reasons", empty).alias("reasons"), F.coalesce("dependencies", empty).alias("dependencies"), c("code_snippet").alias("source_code"))


@query(sql.packet_chunks(_REDACT).replace("kind, rank, name", "kind, (row_number() OVER (PARTITION BY failure_id, kind ORDER BY rank, context_id))::INT AS rank, name"))
def packet_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The redacted chunks that fit into every failure's packet."""
    f = failures.with_signals(once(spark, d, "test_failures", "failure_id"))
    rows = packets.diagnosis_packets(f, _kept(spark, d)).select("failure_id", F.explode("chunks").alias("x"))
    return rows.select("failure_id", c("x.source_label").alias("kind"), "x.rank", "x.name", "x.code_snippet", F.array_join("x.reasons", "; ").alias("reasons"))


@query(sql.SUMMARIES)
def diagnosis_summaries(spark: SparkSession, d: str) -> DataFrame:
    return explain.summaries(failures.with_signals(once(spark, d, "test_failures", "failure_id")), _kept(spark, d))


@query(sql.HYPOTHESES)
def diagnosis_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    return explain.hypotheses(failures.with_signals(once(spark, d, "test_failures", "failure_id")), _kept(spark, d).withColumn("source_code", text.no_null(c("source_code"))))


@query()
def investigation_texts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every question with the chunks that were kept for it."""
    rows = once(spark, d, "llm_investigation_chunk_contexts", "context_id").withColumn("kind", F.when(c("source_label") == "related", "related").otherwise("semantic"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("rank", "context_id")))
    rows = rows.withColumn("parent", F.lit(None).cast("string")).withColumnRenamed("code_snippet", "source_code")
    return packets.investigation_prompts(packets.investigation_packets(_questions(spark, d), rows))


@query()
def diagnosis_texts(spark: SparkSession, d: str) -> DataFrame:
    """Summary and prompt of every failure, from the chunk contexts that were kept for it."""
    f = failures.with_signals(once(spark, d, "test_failures", "failure_id"))
    rows = _kept(spark, d)
    said = explain.summaries(f, rows).join(explain.hypotheses(f, rows), "failure_id")
    return said.join(packets.diagnosis_prompts(packets.diagnosis_packets(f, rows)), "failure_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The results of every question, ranked anew by explainable components."""
    return rerank_weighted(spark, d)
