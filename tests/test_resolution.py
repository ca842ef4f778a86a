"""Every rule of the resolver cascade, hops and related context."""

import pytest
from pyspark.sql import functions as F

from fathom.functions.predicates import chunk_features
from fathom.operators import graph, resolve

SCHEMA = "id string, repo string, file_path string, chunk_type string, name string, parent string, start_line int, end_line int, source_code string, imports array<string>, dependencies array<string>, decorators array<string>"


def chunk(id, path, name, kind="function", parent=None, imports=(), deps=(), repo="r", source=""):
    return (id, repo, path, kind, name, parent, 1, 2, source, list(imports), list(deps), [])


def edges(spark, *rows):
    return {(r.src, r.dep, r.dst, r.rule) for r in resolve.edges(spark.createDataFrame(list(rows), SCHEMA)).collect()}


def test_rules_in_order(spark):
    got = edges(
        spark,
        chunk("m", "pkg/a.py", "run", "method", "Job", ["import pkg.util as u", "from .helper import check as chk, other", "from pkg import store"], ["self.stop", "u.load", "local", "chk", "save", "archive_all", "far", "twice", "missing"]),
        chunk("stop", "pkg/a.py", "stop", "method", "Job"), chunk("local", "pkg/a.py", "local"), chunk("load", "pkg/util.py", "load"), chunk("load2", "other/x.py", "load"),
        chunk("check", "pkg/helper.py", "check"), chunk("save", "pkg/store.py", "save"), chunk("save2", "elsewhere.py", "save"), chunk("arch", "z.py", "archive_all", "method", "Z"), chunk("far", "q.py", "far"), chunk("t1", "t1.py", "twice"), chunk("t2", "t2.py", "twice"),
    )
    assert got == {("m", "self.stop", "stop", resolve.SELF), ("m", "u.load", "load", resolve.DOTTED), ("m", "local", "local", resolve.SAME_FILE), ("m", "chk", "check", resolve.FROM_IMPORT), ("m", "save", "save", resolve.IMPORTED_MODULE), ("m", "archive_all", "arch", resolve.UNIQUE_METHOD), ("m", "far", "far", resolve.FALLBACK)}


def test_ambiguous_modules_prefer_the_own_folder(spark):
    a = chunk("a", "one/x.py", "f", imports=["import util"], deps=["util.g"])
    both = [chunk("g1", "one/util.py", "g"), chunk("g2", "two/util.py", "g")]
    assert edges(spark, a, *both) == {("a", "util.g", "g1", resolve.DOTTED)}
    b = chunk("b", "three/x.py", "f", imports=["import util"], deps=["util.g"])
    assert edges(spark, b, *both) == set()


def test_repositories_do_not_mix_and_dirty_rows_do_no_harm(spark):
    rows = [chunk("a", "x.py", "f", deps=["g", "", "  "]), chunk("g", "y.py", "g", repo="q"), chunk("a", "x.py", "f", deps=["g"]), (None, "r", "x.py", "function", "h", None, 1, 2, "", None, None, None), ("z", None, None, None, "z", None, None, None, None, None, None, None)]
    assert edges(spark, *rows) == set()
    assert resolve.edges(spark.createDataFrame([], SCHEMA)).count() == 0


def test_relative_imports(spark):
    got = edges(spark, chunk("a", "p/q/x.py", "f", imports=["from ..m import g", "from . import n"], deps=["g", "n.h"]), chunk("g", "p/m.py", "g"), chunk("h", "p/q/n.py", "h"))
    assert {(d, t) for _, d, t, _ in got} == {("g", "g"), ("n.h", "h")}


def test_related_context_walks_two_hops(spark):
    rows = [chunk("a", "s/x.py", "a", deps=["b"]), chunk("b", "s/x.py", "b", deps=["c", "t"]), chunk("c", "s/y.py", "c", deps=["d"]), chunk("d", "s/z.py", "d"), chunk("t", "tests/t.py", "t")]
    df = spark.createDataFrame(rows, SCHEMA)
    feats, e = chunk_features(df), resolve.edges(df)
    results = spark.createDataFrame([(1, "a", 1)], "query_id bigint, chunk_id string, rank int")
    q = lambda s: spark.createDataFrame([(1, s)], "query_id bigint, query string")
    got = {(r.chunk_id, r.depth, r.score) for r in graph.related_context(results, q("why"), e, feats).collect()}
    assert got == {("b", 1, 7), ("c", 2, 5)}
    assert "t" in {r.chunk_id for r in graph.related_context(results, q("which tests"), e, feats).collect()}


def test_results_of_several_rankings_merge(spark):
    a = spark.createDataFrame([(1, "x", 1.0, ["A", "b"])], "query_id bigint, chunk_id string, score double, reasons array<string>")
    b = spark.createDataFrame([(1, "x", 2.0, ["a", "c"]), (1, "y", 0.5, [])], "query_id bigint, chunk_id string, score double, reasons array<string>")
    got = {r.chunk_id: (r.score, r.reasons) for r in graph.merge_results(a, b).collect()}
    assert got == {"x": (2.0, ["A", "b", "c"]), "y": (0.5, [])}
    assert pytest and F
