"""Problem 2: the N best items of every group, by merging sorted runs with a loser tree.

Every input task turns its rows into a run: sorted by group and order, cut after the N best distinct items of each group, and
stored in the cluster's shared folder. One shuffle then brings the runs of a group together; a loser tree merges FAN of them
at a time with the best so far and seeks to the next group after N outputs, so that a task never holds more than FAN + 1 runs
of N rows. Groups of which more than HOT_ROWS rows are left, as many tasks had some, first meet in buckets of their runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.tables import settle

TOP_N, FAN, RUN_ROWS, HOT_ROWS, SMALL_LIST = 10, 64, 100_000, 100_000, 100_000


class LoserTree:
    """Multiway merge of sorted lists: inner nodes keep the losers, so a pop replays one path from leaf to root."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a], self.runs[b]
        if self.at[a] >= len(x) or self.at[b] >= len(y):
            return self.at[a] < len(x)
        return (x[self.at[a]], a) < (y[self.at[b]], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:  # while the tree fills, the first to come waits here
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.at[w := self.tree[0]] < len(self.runs[w]):
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


def cut(held: list[pa.Table], n: int, names: list[str]) -> pa.Table:
    """Rows in order of group and names, the n best distinct items of each group; the item is the last name."""
    t = pa.concat_tables(held)
    t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("g", *names)], null_placement="at_start")).combine_chunks()
    group, item = (t.column(c).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("g", names[-1]))
    first = np.sort(np.unique(group * (item.max(initial=0) + 1) + item, return_index=True)[1])  # of an item its best row
    group = group[first]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
    return t.take(pa.array(first[place < n]))


def top_per_group(df: DataFrame, group: str, item: str, score: str, ties: tuple[str, ...] = (), n: int = TOP_N, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The n best distinct items of every group as (group, item, score, ties..., rank).

    An item counts once, with its best score. Order: score descending, then the ties and at last the item, ascending
    (strings by bytes, nulls first), so equal scores come out alike on every run. Rows with a null or NaN score, a null
    group or a null item take no part. Repeated rows count once; groups with fewer than n items come out whole.
    n must be at least 1. Other columns of df are left out.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    s = F.col(score).cast("double")
    order = [*ties, item]
    rows = df.where(s.isNotNull() & ~F.isnan(s) & F.col(group).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), (-s).alias("o"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(order)])
    names = ["o", *(f"t{i}" for i in range(len(order)))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    ranked = schema + ", rank int"

    def key(row: tuple) -> tuple:
        # strings compare by code point as by UTF-8 bytes; nulls first
        return tuple((v is not None, v) if v is None or i else v for i, v in enumerate(row))

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The task's run; what was cut is cut again with what follows, unless that leaves almost all of it."""
        held, size, kept = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
                size += b.num_rows
            if size >= kept + RUN_ROWS:
                held = [cut(held, n, names)]
                size = kept = held[0].num_rows
                if kept > 10 * RUN_ROWS:
                    yield from held[0].to_batches()
                    held, size, kept = [], 0, 0
        if held:
            yield from cut(held, n, names).to_batches()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come ordered by group and run; a group may span batches, so the last one waits for more."""
        like = None
        now, last, runs, ready = None, None, [], []

        def best(runs: list) -> list[tuple]:
            out, seen = [], set()
            for x in LoserTree(runs):
                if x[1][-1] not in seen:
                    seen.add(x[1][-1])
                    out.append(x)
                    if len(out) == n:
                        break
            return out

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*ready), like)], schema=like)

        for b in batches:
            like = like or pa.schema([pa.field(c, b.schema.field(c).type) for c in ("g", *names)] + [pa.field("rank", pa.int32())])
            for g, run, *row in zip(*(b.column(c).to_pylist() for c in ("g", "run", *names))):
                if g != now:
                    ready += [(now, *x[1], i) for i, x in enumerate(best(runs), 1)]
                    now, last, runs = g, run, [[]]
                elif run != last:
                    if len(runs) > FAN:
                        runs = [best(runs)]
                    last = run
                    runs.append([])
                row = tuple(row)
                runs[-1].append((key(row), row))
            if len(ready) >= 10_000:
                yield emit()
                ready.clear()
        ready += [(now, *x[1], i) for i, x in enumerate(best(runs), 1)]
        if ready:
            yield emit()

    def merged(runs: DataFrame, *keys: str) -> DataFrame:
        return runs.repartition(*keys).sortWithinPartitions(*keys, "run", *names).select("g", "run", *names).mapInArrow(merge, ranked)

    runs = settle(rows.mapInArrow(make_runs, schema).withColumn("run", F.spark_partition_id().cast("bigint")), "runs")
    hot = settle(runs.groupBy("g").agg(F.count("*").alias("left")).where(F.col("left") > hot_rows), "hot")
    many = hot.count()
    if many:
        marked = runs.join(F.broadcast(hot) if many <= SMALL_LIST else hot, "g", "left")
        half = merged(marked.where("left is not null").withColumn("b", F.pmod("run", F.ceil(F.col("left") / hot_rows))), "g", "b")
        half = half.drop("rank").withColumn("run", F.spark_partition_id().cast("bigint"))
        runs = marked.where("left is null").drop("left").unionByName(half)
    top = merged(runs, "g")
    return top.select(F.col("g").alias(group), F.col(f"t{len(order) - 1}").alias(item), (-F.col("o")).alias(score), *[F.col(f"t{i}").alias(c) for i, c in enumerate(ties)], "rank")
