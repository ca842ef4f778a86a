"""Problems 1 and 2 against plain Python."""

import random

from pyspark.sql import functions as F

from fathom.llm.split_pieces import split_oversized
from fathom.llm.top_groups import LoserTree, top_per_group

PIECES = "id string, source_code string, start_line int, k0 string, piece string"


def rebuilt(text, pieces):
    """The text from its pieces' offsets: nothing lost, only whole line ends between pieces."""
    at = 0
    for p in sorted(pieces, key=lambda p: p.piece_no):
        assert text[p.start_char : p.end_char] == p.piece
        assert p.start_char <= at or text[at : p.start_char] == "\n"
        at = p.end_char
    return text[at:] == ""


def texts():
    rng = random.Random(5)
    line = lambda n: "x" * n
    out = {
        "lines": "\n".join(f"a{i} = {i}" for i in range(500)),
        "one_long": "z" * 10_000,
        "minified": "".join(f"var a{i}=b({i});" for i in range(900)),
        "crlf": "\r\n".join(f"row {i}" for i in range(300)),
        "final_newline": "a\n" * 81,
        "eighty_one_blank": "\n" * 80,
        "unicode": "é中😀" * 1200,
        "wide_lines": "\n".join(line(rng.randint(0, 900)) for _ in range(60)),
        "long_then_short": "q" * 7000 + "\nx = 1\n" + "y" * 3500,
    }
    out["classes"] = "\n\n".join("class A%d:\n    def f(self):\n" % i + "\n".join(f"        x{j} = {j}" for j in range(25)) for i in range(12))
    for i in range(25):
        out[f"random{i}"] = "".join(rng.choice("ab \n\t;{})é") * rng.randint(1, 40) for _ in range(rng.randint(300, 900)))
    return out


def test_pieces_hold_the_limits_and_lose_nothing(spark):
    ts = texts()
    df = spark.createDataFrame([(k, v, 11, "clash", "clash") for k, v in ts.items()] + [("null", None, 1, "", ""), ("empty", "", 1, "", ""), ("small", "x = 1\n" * 20, 1, "", "")], PIECES)
    got = split_oversized(df).collect()
    by = {}
    for p in got:
        by.setdefault(p.id, []).append(p)
    big = {k for k, v in ts.items() if len(v) > 3000 or v.count("\n") + 1 > 80}
    assert set(by) == big
    for k, ps in by.items():
        assert rebuilt(ts[k], ps), k
        assert sorted(p.piece_no for p in ps) == list(range(1, len(ps) + 1)) and all(p.n_pieces == len(ps) for p in ps)
        for p in ps:
            assert 0 < len(p.piece) <= 3000 and p.piece.count("\n") + 1 <= 80, (k, p.piece_no)
            assert p.start_line == 11 + ts[k].count("\n", 0, p.start_char), k


def test_neighbours_share_five_whole_lines(spark):
    text = "\n".join(f"a{i} = {i}" for i in range(500))
    ps = sorted(split_oversized(spark.createDataFrame([("a", text, 1)], "id string, source_code string, start_line int")).collect(), key=lambda p: p.piece_no)
    for a, b in zip(ps, ps[1:]):
        assert b.shared_lines == 5 and a.piece.split("\n")[-5:] == b.piece.split("\n")[:5]
        assert b.start_line == a.end_line - 4


def test_cuts_fall_before_definitions(spark):
    text = texts()["classes"]
    ps = sorted(split_oversized(spark.createDataFrame([("a", text, 1)], "id string, source_code string, start_line int")).collect(), key=lambda p: p.piece_no)
    lines = text.split("\n")
    for p in ps[1:]:
        assert lines[p.start_line - 1 + p.shared_lines].startswith("class ") or not lines[p.start_line - 1 + p.shared_lines].strip()


def test_pieces_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, source_code string, start_line int")
    assert split_oversized(empty).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted((rng.randint(0, 20),) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def brute_top(rows, n):
    best = {}
    for g, i, s, t in rows:
        if g is None or i is None or s is None or s != s:
            continue
        key = (-s, (t is not None, t or ""), i)
        if (g, i) not in best or key < best[g, i]:
            best[g, i] = key
    out = set()
    for g in {g for g, _ in best}:
        for r, (k, i) in enumerate(sorted((k, i) for (h, i), k in best.items() if h == g)[:n], 1):
            out.add((g, i, -k[0] + 0.0, r))
    return out


def test_top_per_group_with_ties_nulls_and_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None, 9]), rng.choice([None, *"abcdefghijklmnopqrstuvwxyzé中"]), rng.choice([None, float("nan"), 0.5, 0.25, 0.0, -0.0, 1.0, float("inf"), float("-inf")]), rng.choice([None, "p", "q", "Q"])) for _ in range(4000)]
    rows += rows[:300]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "g bigint, i string, s double, t string, rank string, run int").repartition(7)
    got = {(r.g, r.i, r.s, r.rank) for r in top_per_group(df, "g", "i", "s", ("t",), n=10).collect()}
    assert got == brute_top(rows, 10)
    again = {(r.g, r.i, r.s, r.rank) for r in top_per_group(df.repartition(2), "g", "i", "s", ("t",), n=10).collect()}
    assert again == got


def test_top_of_nothing(spark):
    df = spark.createDataFrame([], "g bigint, i string, s double")
    assert top_per_group(df, "g", "i", "s").count() == 0
    small = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "g bigint, i string, s double")
    assert [(r.i, r["rank"]) for r in top_per_group(small, "g", "i", "s").orderBy("rank").collect()] == [("b", 1), ("a", 2)]


def test_the_limits_are_checked():
    import pytest

    with pytest.raises(ValueError):
        top_per_group(None, "g", "i", "s", n=0)
    with pytest.raises(ValueError):
        split_oversized(None, max_lines=5, overlap=5)
    assert F is not None


def test_groups_of_many_runs_meet_in_buckets(spark, monkeypatch):
    from fathom.llm import top_groups

    monkeypatch.setattr(top_groups, "FAN", 3)
    monkeypatch.setattr(top_groups, "RUN_ROWS", 20)
    rng = random.Random(12)
    rows = [(rng.choice([1, 1, 1, 2, rng.randint(3, 40)]), f"c{rng.randint(0, 300)}", rng.choice([None, float("nan"), 0.5, 0.25, rng.random()])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g bigint, i string, s double").repartition(23)
    want = {}
    for g, i, s in rows:
        if s is not None and s == s:
            want.setdefault(g, {}).setdefault(i, []).append(s)
    want = {(g, i, n) for g, items in want.items() for n, (_, i) in enumerate(sorted((-max(s), i) for i, s in items.items())[:5], 1)}
    for hot_rows in (15, 10**6):  # with hot groups, and without
        assert {(r.g, r.i, r["rank"]) for r in top_per_group(df, "g", "i", "s", n=5, hot_rows=hot_rows).collect()} == want
