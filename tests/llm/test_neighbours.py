"""Problem 6 against brute force."""

import numpy as np

from fathom.llm import neighbours


def brute(rows, k=5, least=0.85):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v):
            seen.setdefault(i, v)
    ids = np.array(sorted(seen))
    m = np.array([seen[i] for i in ids], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 7)
    np.fill_diagonal(s, -2)
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(min(a, ids[j]), max(a, ids[j])) for r, a in enumerate(ids) for j in top[r] if s[r, j] >= least}


def vectors(n_groups, size, rng):
    out = []
    for g in range(n_groups):
        c = rng.standard_normal(64)
        for _ in range(rng.integers(1, size)):
            out.append((rng.uniform(0.1, 9) * (c + 0.25 * rng.standard_normal(64))).astype(np.float32).tolist())
    return out


def test_recall_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)  # cells of several blocks
    rng = np.random.default_rng(3)
    vs = vectors(220, 14, rng)
    rows = [(i * 3, v) for i, v in enumerate(vs)]
    hot = np.round(rng.standard_normal(64), 3)
    rows += [(100_000 + i, (hot * (i + 1)).tolist()) for i in range(700)]  # a third of all rows in one direction
    rows += rows[:40]
    rows += [(None, vs[0]), (200_001, None), (200_002, [1.0] * 63), (200_003, [0.0] * 64), (200_004, [float("nan")] + [1.0] * 63), (200_005, [None] + [1.0] * 63), (200_006, [float("inf")] + [1.0] * 63), (200_007, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, other string, rank int").repartition(3)
    found = neighbours.most_similar(df)
    got = {tuple(r) for r in neighbours.similar_pairs(found).collect()}
    true = brute(rows)
    assert len(got & true) / len(true) >= 0.98 and len(got & true) / len(got) >= 0.99
    assert found.groupBy("vec_id").count().where("count > 5").count() == 0


def test_all_five_whatever_their_cosine(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 60)
    rng = np.random.default_rng(5)
    vs = vectors(150, 6, rng) + rng.standard_normal((150, 64)).tolist()  # small groups and vectors without any near one
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id bigint, embedding array<float>").repartition(3)
    m = np.array(vs)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -2)
    true = {(r, int(j)) for r, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    found = neighbours.most_similar(df)
    got = {(r["vec_id"], r["other"]) for r in found.collect()}
    assert found.count() == len(got) == 5 * len(vs)
    assert len(got & true) / len(true) >= 0.98
    floor = neighbours.most_similar(df, min_cosine=0.85).collect()
    assert 0 < len(floor) < len(got) and min(r["cosine"] for r in floor) >= 0.85


def test_no_usable_vector(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    assert neighbours.most_similar(df).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64)], "vec_id bigint, embedding array<float>")
    assert neighbours.most_similar(one).count() == 0


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(8, 1.645) - 15.507) < 0.05
