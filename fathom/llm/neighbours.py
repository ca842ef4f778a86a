"""Problem 6: the most similar vectors of every vector.

Unit vectors are projected on a few directions of normal random numbers. Such projections are 2-stable: seen from a query, a
neighbour at a known true distance lies in projected space by a normal law of that width, and the squared projected distance,
divided by the true one, follows a chi-square law. A kd-tree over projected points cuts the corpus into cells, and within a
cell into buckets; a query takes buckets in order of their projected distance, verifies their vectors with the true cosine
and stops when the chi-square test says that a nearer vector would already have been seen.

Each query first searches its home cell, which bounds the distance that still matters. It then travels to the cells that a
neighbour at this distance may lie in, most likely first, until the normal law leaves too little beside them. Where a least
cosine is given, two trees of independent directions are travelled less far each: a pair is met in either tree and from
either side, and the number of cells a query visits does not grow with their number. The top of a tree is fitted on a bounded
sample; all vectors are indexed. Vectors of one direction are one point of the index, so that many copies cost no more than
one. Cells that are too large for a task are split into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathom.sources.tables import settle

DIMENSIONS, K, MIN_COSINE = 64, 5, 0.85
PROJECTED, TREES, SEED = 8, 2, 7
CONFIDENCE = 2.3263  # of the test inside of a cell, as a normal quantile: 99 %
MASS = 0.6  # of where a neighbour may lie, so much is travelled to in each of several trees
ALL_MASS, ALL_CONFIDENCE = 0.98, 3.719  # where no least cosine is given: one tree, and the test at 99.99 %
LEAST_MASS = 0.0005  # a cell less likely than this is not followed, nor one of less than a twentieth of its even share
SAMPLE, CELL_ROWS, MIN_CELLS, MAX_CELLS, BLOCK_ROWS, BUCKET_ROWS = 20_000, 4_000, 1, 1 << 16, 60_000, 128


def chi_square_quantile(m: int, z: float) -> float:
    """Wilson and Hilferty's approximation of the quantile at the normal quantile z."""
    return m * (1 - 2 / (9 * m) + z * math.sqrt(2 / (9 * m))) ** 3


def directions(dimensions: int, projected: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimensions, projected)).astype(np.float32)


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, to four digits."""
    t = 1 / (1 + np.float32(0.33267) * np.abs(z))
    p = np.exp(-z * z / 2) * np.float32(0.3989423) * t * (np.float32(0.4361836) + t * (np.float32(-0.1201676) + t * np.float32(0.937298)))
    return np.where(z > 0, 1 - p, p)


def fixed_binary(column: pa.Array, width: int, dtype: type) -> np.ndarray:
    """A binary column, all values of one size, as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def clean_units(df: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """(id, direction, unit): usable vectors at length one, each id once; direction is equal for parallel vectors."""
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dimensions)).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            if not b.num_rows:
                continue
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)
            x = np.where(np.isfinite(x).all(axis=1, keepdims=True), x, 0)
            top = np.abs(x).max(axis=1)
            ok = top > 0
            x = x[ok] / top[ok, None]
            u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            near = np.round(u, 5) + np.float32(0)  # no -0.0
            if len(u):
                yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([r.tobytes() for r in u], pa.binary())], names=["id", "near", "unit"])

    out = rows.mapInArrow(run, "id bigint, near binary, unit binary")
    return out.select("id", F.xxhash64("near").alias("direction"), "unit").dropDuplicates(["id"])


class Cells:
    """The top of the kd-tree: splits at medians of the widest direction, and each cell's box over all its points."""

    def __init__(self, sample: np.ndarray, count: int):
        self.splits: list[tuple[int, int, float]] = []  # (node, direction, value); children of node i are 2i + 1 and 2i + 2
        depth = max(0, round(math.log2(max(1, count))))
        self.depth = depth
        m = sample.shape[1]
        self.axis, self.value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.float32)
        parts = {0: sample}
        for node in range((1 << depth) - 1):
            part = parts.pop(node)
            axis = int(np.argmax(part.var(axis=0))) if len(part) > 1 else node % m
            value = float(np.median(part[:, axis])) if len(part) else 0.0
            self.axis[node], self.value[node] = axis, value
            right = part[:, axis] > value
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]

    def find(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.value[node])
        return node - ((1 << self.depth) - 1)


    def likely(self, points: np.ndarray, bound: np.ndarray, mass: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of the likeliest cells that hold so much of the normal law around each point with variance bound."""
        n, m = points.shape
        least = min(LEAST_MASS, 0.05 / (1 << self.depth))
        width = np.sqrt(np.maximum(bound, 1e-6)).astype(np.float32)
        q, node, share = np.arange(n), np.zeros(n, np.int64), np.ones(n, np.float32)
        low, high = np.zeros((n, m), np.float32), np.ones((n, m), np.float32)
        for _ in range(self.depth):
            rows, axis = np.arange(len(q)), self.axis[node]
            cut = np.clip(normal((self.value[node] - points[q, axis]) / width[q]), low[rows, axis], high[rows, axis])
            span = np.maximum(high[rows, axis] - low[rows, axis], 1e-12)
            left = share * (cut - low[rows, axis]) / span
            right = share - left
            low_right, high_left = low.copy(), high.copy()
            low_right[rows, axis], high_left[rows, axis] = cut, cut
            keep = np.concatenate([left, right]) >= least
            q, node, share = np.tile(q, 2)[keep], np.concatenate([2 * node + 1, 2 * node + 2])[keep], np.concatenate([left, right])[keep]
            low, high = np.concatenate([low, low_right])[keep], np.concatenate([high_left, high])[keep]
        order = np.lexsort((-share, q))
        q, cell, share = q[order], node[order] - ((1 << self.depth) - 1), share[order]
        total = np.cumsum(share, dtype=np.float64)
        first = np.searchsorted(q, np.arange(n))
        before = total - share - np.concatenate([[0.0], total])[first][q]
        enough = before < mass
        return q[enough], cell[enough]


class Buckets:
    """A kd-tree's leaves over the points of one block, in order, with their boxes."""

    def __init__(self, projected: np.ndarray, unit: np.ndarray, rows: int):
        order = np.arange(len(projected))
        leaves, stack = [], [order]
        while stack:
            part = stack.pop()
            if len(part) <= rows:
                leaves.append(part)
                continue
            p = projected[part]
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            half = len(part) // 2
            ranked = np.argpartition(p[:, axis], half)
            stack += [part[ranked[half:]], part[ranked[:half]]]
        self.order = np.concatenate(leaves)
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
        self.p, self.u = projected[self.order], np.ascontiguousarray(unit[self.order])
        self.low = np.minimum.reduceat(self.p, self.starts[:-1], axis=0)
        self.high = np.maximum.reduceat(self.p, self.starts[:-1], axis=0)

    def search(self, p: np.ndarray, u: np.ndarray, k: int, own: np.ndarray | None, bound: np.ndarray, quantile: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar points (positions in the block, cosines of at least least) of a group of near-by queries.

        own has each query's position in this block, None if they are elsewhere; bound is the greatest squared distance that
        still matters. A query goes on while the next bucket is nearer than its test's radius.
        """
        n = len(p)
        floor = np.maximum(np.float32(least), 1 - bound / 2 - np.float32(1e-5))  # what is farther than bound has k nearer ones elsewhere
        best, where = np.full((n, k), -2, np.float32), np.full((n, k), -1, np.int64)
        gap = np.maximum(0, np.maximum(self.low - p.max(axis=0), p.min(axis=0) - self.high))
        near = np.einsum("bm,bm->b", gap, gap)
        turn = np.argsort(near, kind="stable")
        at, step = 0, 4
        active = np.arange(n)
        while at < len(turn) and len(active):
            radius = quantile * np.minimum(bound[active], np.maximum(0, 2 - 2 * best[active, k - 1]))
            take = turn[at : at + step]
            take = take[near[take] <= radius.max()]
            if not len(take):
                break
            # of those, the buckets that some query's own radius touches, and the queries that touch any
            gap = np.maximum(0, np.maximum(self.low[take][None] - p[active][:, None], p[active][:, None] - self.high[take][None]))
            touched = np.einsum("qbm,qbm->qb", gap, gap) <= radius[:, None]
            who, take = active[touched.any(axis=1)], np.sort(take[touched.any(axis=0)])
            if len(take):
                sizes = self.starts[take + 1] - self.starts[take]
                sims = u[who] @ np.concatenate([self.u[self.starts[b] : self.starts[b + 1]] for b in take]).T
                q, c = np.nonzero(sims > np.maximum(best[who, k - 1], floor[who])[:, None])
                if len(q):
                    ends = np.cumsum(sizes)
                    b = np.searchsorted(ends, c, side="right")
                    found, value = self.starts[take][b] + c - (ends - sizes)[b], sims[q, c]
                    if own is not None:
                        other = found != own[who][q]
                        q, found, value = q[other], found[other], value[other]
                    order = np.lexsort((found, -value, q))
                    q, found, value = q[order], found[order], value[order]
                    rows, first = np.unique(q, return_index=True)
                    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
                    keep = place < k
                    s, w = np.full((len(rows), 2 * k), -2, np.float32), np.full((len(rows), 2 * k), -1, np.int64)
                    mine = who[rows]
                    s[:, :k], w[:, :k] = best[mine], where[mine]
                    r = np.searchsorted(rows, q[keep])
                    s[r, k + place[keep]], w[r, k + place[keep]] = value[keep], found[keep]
                    o = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    best[mine], where[mine] = np.take_along_axis(s, o, axis=1), np.take_along_axis(w, o, axis=1)
            at += step
            step = min(step * 2, 64)
            if at < len(turn):
                radius = quantile * np.minimum(bound[active], np.maximum(0, 2 - 2 * best[active, k - 1]))
                active = active[near[turn[at]] <= radius]
        return where, best


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Consecutive rows of equal keys, as slices of the sorted batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        bounds = [0, *change.tolist(), b.num_rows]
        for a, e in zip(bounds, bounds[1:]):
            now = tuple(c[a] for c in cols)
            if last is not None and now != last:
                yield last, held
                held = []
            last = now
            held.append(b.slice(a, e - a))
    if last is not None:
        yield last, held


FOUND = "me bigint, other bigint, cosine float"


def _found(me: np.ndarray, ids: np.ndarray, where: np.ndarray, best: np.ndarray, least: float) -> pa.RecordBatch:
    ok = (where >= 0) & (best >= least - 1e-5)
    q, _ = np.nonzero(ok)
    return pa.RecordBatch.from_arrays([pa.array(me[q], pa.int64()), pa.array(ids[where[ok]], pa.int64()), pa.array(best[ok], pa.float32())], names=["me", "other", "cosine"])


def neighbour_directions(points: DataFrame, n: int, dimensions: int, k: int, min_cosine: float | None, projected: int, trees: int, mass: float, confidence: float, seed: int) -> DataFrame:
    """(me, other, cosine) of the k most similar points of every point(direction, unit), of at least min_cosine if that is given."""
    min_cosine = -1.0 if min_cosine is None else min_cosine
    spark = points.sparkSession
    axes = [directions(dimensions, projected, seed + t) for t in range(trees)]
    quantile = chi_square_quantile(projected, confidence)
    widest = 2 - 2 * min_cosine

    rows = points.orderBy(F.xxhash64("direction", F.lit(seed))).limit(SAMPLE).select("unit").toArrow() if n > SAMPLE else points.select("unit").toArrow()
    sample = fixed_binary(rows.column("unit").combine_chunks() if rows.num_rows else pa.array([], pa.binary()), dimensions, np.float32)
    tops = [Cells(sample @ a, min(MAX_CELLS, max(MIN_CELLS, n // CELL_ROWS))) for a in axes]
    depth = tops[0].depth

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every point once in each tree; the tree is the cell's first bits."""
        for b in batches:
            if b.num_rows:
                u = fixed_binary(b.column("unit"), dimensions, np.float32)
                for t, (a, top) in enumerate(zip(axes, tops)):
                    yield pa.RecordBatch.from_arrays([b.column("direction"), b.column("unit"), pa.array(top.find(u @ a) + (t << depth), pa.int32())], names=["direction", "unit", "cell"])

    placed = settle(points.mapInArrow(place, "direction bigint, unit binary, cell int"), "points")
    # one row per cell: at most MAX_CELLS a tree
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).collect()
    blocks_of = np.ones(trees << depth, np.int64)
    for r in sizes:
        blocks_of[r["cell"]] = -(-r["n"] // BLOCK_ROWS)
    if blocks_of.max() > 1:
        blocks = spark.createDataFrame(pa.table({"cell": pa.array(np.flatnonzero(blocks_of > 1), pa.int32()), "blocks": pa.array(blocks_of[blocks_of > 1], pa.int64())}))
        placed = placed.join(F.broadcast(blocks), "cell", "left").withColumn("block", F.pmod(F.xxhash64("direction"), F.coalesce("blocks", F.lit(1))).cast("int")).drop("blocks")
    else:
        placed = placed.withColumn("block", F.lit(0))
    parts = int(max(placed.sparkSession.sparkContext.defaultParallelism * 2, min(blocks_of.sum(), n // 20_000)))

    names = ["me", "other", "cosine", "places", "bound", "unit"]

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours inside the own block, and one row with the bound and the blocks for the search elsewhere."""
        for (cell, block), held in _groups(batches, ("cell", "block")):
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            ids = t.column("direction").to_numpy()
            u = fixed_binary(t.column("unit"), dimensions, np.float32)
            tree = Buckets(u @ axes[cell >> depth], u, BUCKET_ROWS)
            ids = ids[tree.order]
            bound = np.empty(len(ids), np.float32)
            for a, e in zip(tree.starts, tree.starts[1:]):
                where, best = tree.search(tree.p[a:e], tree.u[a:e], k, np.arange(a, e), np.full(e - a, widest, np.float32), quantile, min_cosine - 1e-5)
                bound[a:e] = np.minimum(widest, np.maximum(0, 2 - 2 * best[:, k - 1]))
                q, c = np.nonzero((where >= 0) & (best >= min_cosine - 1e-5))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:e][q]), pa.array(ids[where[q, c]]), pa.array(best[q, c]), pa.nulls(len(q), pa.list_(pa.int64())), pa.nulls(len(q), pa.float32()), pa.nulls(len(q), pa.binary())], names=names)
            for a in range(0, len(ids), 2048):
                e = min(a + 2048, len(ids))
                q, to = tops[cell >> depth].likely(tree.p[a:e], bound[a:e], mass)
                to = to + (cell >> depth << depth)
                q, to = np.repeat(q, blocks_of[to]), np.repeat(to, blocks_of[to])
                first = np.concatenate([[True], (q[1:] != q[:-1]) | (to[1:] != to[:-1])]) if len(q) else np.zeros(0, bool)
                number = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
                away = ~((to == cell) & (number == block))
                q, to, number = q[away], to[away], number[away]
                who, starts = np.unique(q, return_index=True)
                places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(q)), pa.int32()), pa.array(to << 32 | number, pa.int64()))
                n = len(who)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:e][who]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float32()), places, pa.array(bound[a:e][who]), pa.array([r.tobytes() for r in tree.u[a:e][who]], pa.binary())], names=names)

    homes = placed.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block").mapInArrow(home, FOUND + ", places array<bigint>, bound float, unit binary")
    homes = settle(homes, "home")
    near = homes.where("places is null").select("me", "other", "cosine")
    sent = homes.where("places is not null").select(F.explode("places").alias("place"), "me", "unit", "bound")
    visitors = sent.select(F.shiftright("place", 32).cast("int").alias("cell"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("block"), F.lit(1).alias("visit"), F.col("me").alias("direction"), "unit", "bound")
    hosts = placed.select("cell", "block", F.lit(0).alias("visit"), "direction", "unit", F.lit(0.0).cast("float").alias("bound"))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's points come first and are held; its visitors stream past them."""
        tree, ids, of = None, None, None
        held: list[pa.RecordBatch] = []

        def part(b: pa.RecordBatch, cell: int) -> tuple[np.ndarray, np.ndarray]:
            u = fixed_binary(b.column("unit"), dimensions, np.float32)
            return u, u @ axes[cell >> depth]

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in ("cell", "block", "visit")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for a, e in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
                piece, where = b.slice(a, e - a), (cols[0][a], cols[1][a])
                if not cols[2][a]:
                    if of != where:
                        held, of, tree = [], where, None
                    held.append(piece)
                    continue
                if of != where:
                    continue  # no points here
                if tree is None:
                    t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    u, p = part(t, where[0])
                    tree = Buckets(p, u, BUCKET_ROWS)
                    ids, held = t.column("direction").to_numpy()[tree.order], []
                u, p = part(piece, where[0])
                me, bound = piece.column("direction").to_numpy(), piece.column("bound").to_numpy()
                visit = Buckets(p, u, BUCKET_ROWS)  # near-by visitors search together
                me, bound = me[visit.order], bound[visit.order]
                for x, y in zip(visit.starts, visit.starts[1:]):
                    pos, best = tree.search(visit.p[x:y], visit.u[x:y], k, None, bound[x:y], quantile, min_cosine - 1e-5)
                    yield _found(me[x:y], ids, pos, best, min_cosine)

    far = hosts.unionByName(visitors).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "visit").mapInArrow(away, FOUND)
    best = Window.partitionBy("me").orderBy(F.col("cosine").desc(), "other")
    met = near.unionByName(far)
    met = met.unionByName(met.select(F.col("other").alias("me"), F.col("me").alias("other"), "cosine"))  # who is met has met as well
    once = met.repartition("me").groupBy("me", "other").agg(F.max("cosine").alias("cosine"))
    return once.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def most_similar(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, k: int = K, min_cosine: float | None = None, projected: int = PROJECTED, trees: int | None = None, mass: float | None = None, confidence: float | None = None, seed: int = SEED) -> DataFrame:
    """The k most similar other vectors of every usable vector as (key, rank, other, cosine).

    With min_cosine only those of at least this cosine; the search then goes no farther, in TREES trees. Without, the k-th best
    found so far sets how far it goes, in one tree and by stricter tests (ALL_MASS, ALL_CONFIDENCE): vectors without near
    neighbours then travel to most cells, for in many dimensions nothing tells where their nearest ones lie.

    Unusable are a null key, and vectors that are null, of another length, all zero or with a null, NaN or infinite
    element; they take no part. A repeated key counts once. Equal similarity: the smaller key first. Vectors that are parallel to
    five digits count as equal. Recall is that of the stopping test: see the tests for its measure against brute force.
    """
    every = min_cosine is None
    trees, mass, confidence = trees or (1 if every else TREES), mass or (ALL_MASS if every else MASS), confidence or (ALL_CONFIDENCE if every else CONFIDENCE)
    usable = df.where(~F.exists(vector, lambda x: x.isNull()))
    units = settle(clean_units(usable, key, vector, dimensions), "vectors")
    by = Window.partitionBy("direction").orderBy("id")
    firsts = units.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    points = firsts.groupBy("direction").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("unit", "id").alias("unit"))
    points = settle(points, "directions")
    n = points.count()
    if not n:
        return units.select(F.col("id").alias(key), F.lit(1).alias("rank"), F.col("id").alias("other"), F.lit(1.0).alias("cosine")).where("false")
    found = neighbour_directions(points, n, dimensions, k, min_cosine, projected, trees, mass, confidence, seed)
    ids = points.select("direction", "ids")
    others = found.join(ids.withColumnRenamed("direction", "other"), "other").groupBy("me").agg(F.collect_list(F.struct((-F.col("cosine").cast("double")).alias("c"), F.col("ids"))).alias("lists"))
    flat = F.flatten(F.transform("lists", lambda x: F.transform(x["ids"], lambda i: F.struct(x["c"].alias("c"), i.alias("id")))))
    own = F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("id")))
    lists = ids.join(others, ids["direction"] == others["me"], "left").select("direction", F.slice(F.array_sort(F.concat(own, F.coalesce(flat, F.array().cast("array<struct<c:double,id:bigint>>")))), 1, 2 * k + 2).alias("near"))
    each = units.select("id", "direction").join(lists, "direction").select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    out = each.select(F.col("id").alias(key), F.posexplode("near").alias("i", "x")).select(key, (F.col("i") + 1).alias("rank"), F.col("x.id").alias("other"), (-F.col("x.c")).alias("cosine"))
    return out if min_cosine is None else out.where(F.col("cosine") >= min_cosine)


def similar_pairs(found: DataFrame, key: str = "vec_id", min_cosine: float = MIN_COSINE) -> DataFrame:
    """The pairs (key_a < key_b) of at least min_cosine in which at least one is among the other's most similar."""
    return found.where(F.col("cosine") >= min_cosine).select(F.least(key, "other").alias(f"{key}_a"), F.greatest(key, "other").alias(f"{key}_b")).distinct()
