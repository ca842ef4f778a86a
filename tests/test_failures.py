"""Logs, signals, scores, call paths and packets on small cases."""

import pytest
from pyspark.sql import functions as F

from fathom.functions.predicates import chunk_features
from fathom.operators import callpath, evaluate, explain, failures, packets, resolve, scoring
from fathom.plans import api, providers
from fathom.sources.index import hashing_embedder
from tests.test_resolution import SCHEMA, chunk

LOG = """collected 3 items

=================================== FAILURES ===================================
______________________________ test_total[one] _________________________________

    def test_total():
>       assert cart.total() == 4
E       assert 3 == 4
E        +  where 3 = total()

tests/test_cart.py:14: AssertionError
______________________________ test_guard ______________________________________

E   Failed: DID NOT RAISE <class 'app.errors.LimitReached'>

tests/test_guard.py:9: Failed
=========================== short test summary info ============================
FAILED tests/test_cart.py::test_total[one] - assert 3 == 4
FAILED tests/test_cart.py::test_total[one] - assert 3 == 4
FAILED tests/test_guard.py::test_guard - Failed: DID NOT RAISE <class 'app.errors.LimitReached'>
ERROR tests/test_other.py::test_setup
"""


def logs(spark, text, log=1):
    return spark.createDataFrame([(log, i, x) for i, x in enumerate(text.split("\n"), 1)], "log_id bigint, line_no int, line string")


def test_logs_to_failures(spark):
    got = {r.test_name: r for r in failures.parse_logs(logs(spark, LOG)).collect()}
    assert set(got) == {"tests/test_cart.py::test_total[one]", "tests/test_guard.py::test_guard", "tests/test_other.py::test_setup"}
    cart, guard, other = got["tests/test_cart.py::test_total[one]"], got["tests/test_guard.py::test_guard"], got["tests/test_other.py::test_setup"]
    assert (cart.line_number, cart.error_type, cart.message) == (14, "AssertionError", "total() returned 3 instead of 4")
    assert cart.traceback.startswith("____") and "test_guard" not in cart.traceback
    assert (guard.line_number, guard.error_type) == (9, "Failed") and guard.message.startswith("Failed: DID NOT RAISE")
    assert other.line_number is None and other.traceback.startswith("collected 3 items") and other.message == "assert 3 == 4"
    assert failures.parse_logs(logs(spark, "3 passed")).count() == 0


def failing(spark, *rows):
    return spark.createDataFrame([(i, "r", *r) for i, r in enumerate(rows, 1)], "failure_id bigint, repo string, test_name string, file_path string, line_number int, error_type string, message string, traceback string")


GUARD = ("tests/test_guard.py::test_transfer_limit", "tests/test_guard.py", 9, "Failed", "Failed: DID NOT RAISE <class 'app.errors.LimitReached'>", "app/service.py:12: in transfer\n    check_limit(1)\n")


def test_signals(spark):
    r = failures.with_signals(failing(spark, GUARD, (None, None, None, None, None, None))).orderBy("failure_id").collect()
    assert r[0].did_not_raise and r[0].expected == ["LimitReached", "app.errors.LimitReached"] and r[0].exception_terms == ["limit", "reached"]
    assert r[0].trace_symbols == ["transfer", "check_limit"] and r[0].source_hints == ["app/service.py:12"] and r[0].hint_files == ["app/service.py"]
    assert not r[1].did_not_raise and r[1].expected == [] and r[1].trace_symbols == []


def test_components_and_selection(spark):
    rows = [chunk("guard", "app/rules.py", "check_limit", source="def check_limit(x):\n    if x > 1:\n        raise LimitReached()\n"), chunk("test", "tests/test_guard.py", "test_transfer_limit", source="def test_transfer_limit():\n    check_limit(1)\n"), chunk("plain", "app/other.py", "draw", source="def draw():\n    pass\n")]
    feats = chunk_features(spark.createDataFrame(rows, SCHEMA)).withColumnRenamed("id", "chunk_id").drop("repo")
    f = failures.with_signals(failing(spark, GUARD)).drop("repo", "file_path")
    scored = scoring.failure_components(scoring.pair_evidence(f.crossJoin(feats).withColumn("base_score", F.lit(0.5))))
    got = {r.chunk_id: r for r in scored.collect()}
    names = {p.name for p in got["guard"].parts}
    assert {"raises_expected_exception", "validation_helper_name", "source_first_selection_signal", "traceback_symbol_match"} <= names and got["guard"].strong and not got["test"].strong and not got["plain"].strong
    assert got["guard"].score > got["test"].score and abs(got["plain"].score - 0.6) < 0.3
    order = [r.chunk_id for r in scoring.select_source_first(scoring.ranked(scored, "failure_id"), "failure_id", 3).orderBy("rank").collect()]
    assert order[0] == "guard" and order[-1] == "test"
    said = explain.with_reasons(scored.withColumn("extra", F.array().cast("array<string>"))).where("chunk_id = 'guard'").first().reasons
    assert said[0] == "raises expected exception" and len(said) <= 4


def corpus_rows():
    return [
        chunk("transfer", "app/service.py", "transfer", "method", "TransferService", ["from app.rules import check_limit"], ["check_limit", "debit"], source="def transfer(self, amount):\n    check_limit(amount)\n    self.account.debit(amount)\n"),
        chunk("check", "app/rules.py", "check_limit", deps=["LimitReached"], source="def check_limit(x):\n    if x > 1:\n        raise LimitReached('limit')\n"),
        chunk("error", "app/errors.py", "LimitReached", "class", source="class LimitReached(Exception):\n    pass\n"),
        chunk("debit", "app/account.py", "debit", "method", "Account", source="def debit(self, amount):\n    self.balance -= amount\n"),
        chunk("credit", "app/account.py", "credit", "method", "Account", source="def credit(self, amount):\n    self.balance += amount\n"),
        chunk("test", "tests/test_guard.py", "test_transfer_limit", source="def test_transfer_limit():\n    transfer(5)\n"),
        chunk("draw", "app/draw.py", "draw", source="def draw():\n    return 1\n"),
    ]


@pytest.fixture(scope="module")
def corpus(spark):
    return api.Corpus(hashing_embedder(spark.createDataFrame(corpus_rows(), SCHEMA)))


def test_diagnosis_finds_the_guard_and_the_counterpart(spark, corpus):
    balance = ("tests/test_transfer.py::test_transfer_moves_balance", "tests/test_transfer.py", 3, "AssertionError", "assert 5 == 10", "app/service.py:3: in transfer\n")
    rows = api.diagnose(corpus, failing(spark, GUARD, balance)).collect()
    top = {(r.failure_id, r["rank"]): r.chunk_id for r in rows if r.kind == "semantic"}
    assert {top[1, 1], top[1, 2], top[1, 3]} >= {"check", "error"}
    second = {r.chunk_id: r.reasons for r in rows if r.failure_id == 2}
    assert "transfer" in second and "credit" in second
    assert len(top) == len(set(top)) and all(len(r.reasons) <= 4 for r in rows)


def test_investigation_and_search(spark, corpus):
    q = spark.createDataFrame([(1, "transfer does not credit the balance"), (2, "  ")], "query_id bigint, query string")
    rows = api.investigate(corpus, q, 3).collect()
    assert {r.query_id for r in rows} == {1} and [r.chunk_id for r in sorted(rows, key=lambda r: (r.kind != "semantic", r["rank"]))][0] in ("transfer", "credit", "debit")
    assert {r.kind for r in api.search(corpus, q, 2).collect()} <= {"semantic", "related"}
    assert api.as_json(api.investigate(corpus, q, 3), "query_id").count() == 1
    assert api.search(corpus, q, 0).count() == 0


def test_packets_stay_within_their_budget(spark):
    row = lambda i, kind: (1, kind, i, f"c{i}", "function", f"f{i}", None, "a.py", 1, 2, 0.5, ["r"], ["d"] * 20, "password = 'hunter22'\n" + "x = 1\n" * 300)
    rows = spark.createDataFrame([row(i, k) for k in ("semantic", "related") for i in range(1, 9)], "failure_id bigint, kind string, rank int, chunk_id string, chunk_type string, name string, parent string, file_path string, start_line int, end_line int, score double, reasons array<string>, dependencies array<string>, source_code string")
    f = failures.with_signals(failing(spark, GUARD))
    p = packets.diagnosis_packets(f, rows, 4000).first()
    assert p.chunks and sum(len(x.code_snippet) for x in p.chunks) < 4000 and all("hunter22" not in x.code_snippet and len(x.dependencies) == 12 for x in p.chunks)
    assert [x["rank"] for x in p.chunks] == [1, 2, 3, 4, 5, 1, 2, 3, 4, 5][: len(p.chunks)]
    assert "hunter22" not in packets.diagnosis_prompts(packets.diagnosis_packets(f, rows)).first().prompt
    assert packets.diagnosis_packets(f, rows.limit(0)).first().chunks is None


def test_texts(spark):
    f = failures.with_signals(failing(spark, ("t.py::test_is_open", "t.py", 1, "AssertionError", "assert True is False", "")))
    rows = spark.createDataFrame([(1, "semantic", 1, "is_open", "Door", "app/door.py", False, ["lock"], "def is_open(self): return 1 < 2")], "failure_id bigint, kind string, rank int, name string, parent string, file_path string, is_test boolean, dependencies array<string>, source_code string")
    said = explain.summaries(f, rows).first().summary
    assert "- Most relevant source chunk: Door.is_open in app/door.py" in said and "- Related context: <none>" in said
    assert "opposite truth value" in explain.hypotheses(f, rows).first().hypothesis
    assert "<none>" in explain.summaries(f, rows.limit(0)).first().summary and explain.hypotheses(f, rows.limit(0)).first().hypothesis is None


def test_grades(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "case_id int, item string")
    results = spark.createDataFrame([(1, "a", 2), (1, "a", 4), (2, "b", 5), (3, "c", 9)], "case_id int, item string, rank int")
    assert {(r.case_id, r.result) for r in evaluate.best_ranks(cases, results).collect()} == {(1, "PASS"), (2, "PARTIAL"), (3, "FAIL")}
    n = evaluate.outcome_counts(evaluate.best_ranks(cases, results)).first()
    assert (n.n_pass, n.n_partial, n.n_fail, n.successful) == (1, 1, 1, False)


def test_providers():
    assert providers.load_provider({}) is None and providers.ask(None, "x") == {"status": "skipped"}
    assert providers.ask(providers.load_provider({"FATHOM_LLM_PROVIDER": " Fake "}), "x")["status"] == "completed"
    with pytest.raises(ValueError):
        providers.load_provider({"FATHOM_LLM_PROVIDER": "other"})
    assert callpath and resolve


def test_counterparts_stay_in_their_repository(spark):
    from fathom.operators import callpath, failures
    from fathom.plans import api
    from fathom.sources.index import hashing_embedder

    def chunk(id, name, parent, repo, source, deps=()):
        return (id, repo, "app/store.py", "method", name, parent, 1, 4, source, [], list(deps), [])

    rows = [chunk("t1", "transfer", "Service", "one", "def transfer(self):\n    self.debit(1)\n", ["self.debit"]), chunk("d1", "debit", "Service", "one", "def debit(self, n):\n    self.balance -= n\n"), chunk("c1", "credit", "Service", "one", "def credit(self, n):\n    self.balance += n\n")]
    rows += [chunk(f"{i}x", n, "Service", "two", s, d) for i, n, s, d in (("t", "transfer", "def transfer(self):\n    self.debit(1)\n", ["self.debit"]), ("d", "debit", "def debit(self, n): ...\n", []), ("c", "credit", "def credit(self, n): ...\n", []))]
    schema = "id string, repo string, file_path string, chunk_type string, name string, parent string, start_line int, end_line int, source_code string, imports array<string>, dependencies array<string>, decorators array<string>"
    corpus = api.Corpus(hashing_embedder(spark.createDataFrame(rows, schema)))
    f = failures.with_signals(spark.createDataFrame([(1, "tests/test_transfer.py::test_transfer_moves_balance", "tests/test_transfer.py", 3, "AssertionError", "debit without credit: transfer balance", "")], "failure_id bigint, test_name string, file_path string, line_number int, error_type string, message string, traceback string"))
    ranked = spark.createDataFrame([(1, "t1", 2.0, 1)], "failure_id bigint, chunk_id string, score double, rank int")
    found = {r.chunk_id for r in callpath.call_path_context(ranked, corpus.edges, f.drop("file_path"), corpus.chunks.drop("embedding", "shown_terms", "terms")).collect()}
    assert "c1" in found and not found & {"cx", "dx", "tx"}
