"""Cosine similarity, top-k searches and a deterministic embedder."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from fathom.sources.tables import shared_folder

HASH_DIMENSIONS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length; an error if their sizes differ."""
    product = norm(a) * norm(b)
    value = F.when(product == 0, F.lit(0.0)).otherwise(dot(a, b) / product)
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@F.pandas_udf(ArrayType(DoubleType()))
def _hashed(texts: pd.Series, sizes: pd.Series) -> pd.Series:
    known: dict[str, int] = {}
    out = []
    for text, size in zip(texts, sizes):
        v = np.zeros(size)
        for t in PIECE.findall(text or ""):
            h = known.get(t)
            if h is None:
                h = known[t] = zlib.crc32(t.lower().encode())
            v[(h >> 1) % size] += 1.0 if h & 1 else -1.0
        n = np.linalg.norm(v)
        out.append(v / n if n else v)
    return pd.Series(out)


def hashing_embedding(text: Column, dimensions: int = HASH_DIMENSIONS) -> Column:
    """A unit vector of hashed token counts with hashed signs: deterministic, needs no model. Null and empty texts give zeros."""
    return _hashed(text, F.lit(dimensions))


QUESTION_ROWS, ITEM_ROWS, HELD_ROWS, KEPT_BLOCKS = 4096, 16_384, 500_000, 8
TILE_QUESTIONS, TILE_ITEMS, PAIRS = 512, 2048, 16_384  # products at a time, and pairs whose cosines are taken exactly at a time


def _units(vectors: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    m = np.array(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, size)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m[~(length[:, 0] > 0)] = 0.0
    np.divide(m, length, out=m, where=length > 0)
    return np.nan_to_num(m, copy=False, nan=0.0)


def _best(found: list[pa.Table], k: int) -> pa.Table:
    """Of rows (q, i, score) the k best of each q; ties by i."""
    t = pa.concat_tables(found)
    order = pc.sort_indices(t, sort_keys=[("q", "ascending"), ("score", "descending"), ("i", "ascending")])
    t = t.take(order).combine_chunks()
    q = t.column("q").combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return t.filter(pa.array(place < k))


def _first(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row by score, ties by column, in order; and their places."""
    order = np.lexsort((columns, -scores, rows))
    rows = rows[order]
    start = np.flatnonzero(np.diff(rows, prepend=-1))
    place = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
    kept = place < k
    order = order[kept]
    return rows[kept], columns[order], scores[order], place[kept]


def _nearest(questions: np.ndarray, units: np.ndarray, k: int, digits: int | None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, item, cosine): places of the k most similar items of each question, ties by place; what lies below least, a
    bound for each question, may be missing.

    Products are taken tile by tile in single precision. What comes within their error and that of the rounding of the k-th
    best so far is taken again in double precision, and only that decides: memory is that of a tile and k items a question.
    """
    error = 2 * (units.shape[1] + 4) * 2.0**-24 + (10.0**-digits if digits is not None else 0)
    small, out = units.astype(np.float32), []
    for top in range(0, len(questions), TILE_QUESTIONS):
        mine = questions[top : top + TILE_QUESTIONS]
        single = mine.astype(np.float32)
        floor = np.full(len(mine), -np.inf) if least is None else least[top : top + TILE_QUESTIONS].copy()
        held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        waiting, count = [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            *best, place = _first(*(np.concatenate([x[n] for x in (held, *waiting)]) for n in range(3)), k)
            full = place == k - 1
            floor[best[0][full]] = np.maximum(floor[best[0][full]], best[2][full])
            return tuple(best)

        for left in range(0, len(units), TILE_ITEMS):
            sims = single @ small[left : left + TILE_ITEMS].T
            if np.isneginf(floor).any() and sims.shape[1] > k:
                floor = np.maximum(floor, np.partition(sims, -k, axis=1)[:, -k] - error)
            rows, columns = np.nonzero(sims >= (floor - error)[:, None])
            for at in range(0, len(rows), PAIRS):
                r, c = rows[at : at + PAIRS], columns[at : at + PAIRS] + left
                exact = np.einsum("ij,ij->i", mine[r], units[c])
                waiting.append((r, c, np.round(exact, digits) if digits is not None else exact))
                count += len(r)
                if count > max(8 * PAIRS, 2 * k * len(mine)):
                    held, waiting, count = settled(), [], 0
        best = settled()
        out.append((best[0] + top, *best[1:]))
    return tuple(np.concatenate([x[n] for x in out]) for n in range(3))


def _by_size(table: pa.Table, *keys: str) -> Iterator[tuple[str, int, list[pa.Array], np.ndarray]]:
    """The rows (..., v, s) by s and by the length of v: s, the length, the key columns and unit vectors, in order of the first key."""
    vectors, columns = table.column("v").combine_chunks(), [table.column(x).combine_chunks() for x in keys]
    sizes, names = np.diff(vectors.offsets.to_numpy()), table.column("s").combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy()
    for code, name in enumerate(names.dictionary.to_pylist()):
        for size in np.unique(sizes[codes == code]):
            at = np.flatnonzero((codes == code) & (sizes == size))
            at = at[pc.sort_indices(columns[0].take(pa.array(at))).to_numpy()]
            if size:
                yield name, int(size), [x.take(pa.array(at)) for x in columns], _units(vectors, at, int(size))


def _compared(keys: pa.Array, questions: np.ndarray, ids: pa.Array, units: np.ndarray, k: int, digits: int | None, least: np.ndarray | None = None) -> pa.Table:
    q, i, score = _nearest(questions, units, k, digits, least)
    return pa.table({"q": keys.take(pa.array(q)), "i": ids.take(pa.array(i)), "score": pa.array(score)})


def _least(best: pa.Table, keys: pa.Array, k: int) -> np.ndarray:
    """The k-th best score of every key, of rows as _best gives them; of keys with fewer rows minus infinity."""
    counts = pc.value_counts(best.column("q").combine_chunks())
    many, out = counts.field("counts").to_numpy(), np.full(len(keys), -np.inf)
    full = many == k
    out[pc.index_in(counts.field("values"), keys).to_numpy()[full]] = best.column("score").to_numpy()[np.cumsum(many)[full] - 1]
    return out


def block_top_k(items: DataFrame, queries: DataFrame, k: int, item_key: str = "chunk_id", query_key: str = "query_id", vector: str = "embedding", same: str | None = None, digits: int | None = None) -> DataFrame:
    """The k items of highest cosine of each query, for many queries: (query_key, item_key, score, rank), ties by item_key.

    Queries are written to the shared folder in blocks, and so are the items' vectors. A task takes one block through all
    items, or a share of them if there are few blocks, and holds k per query; a window chooses among the shares. With same,
    only rows equal in that column meet: blocks are cut by its hash, and every task takes its items to the blocks that they
    ask for. Matrix products are cut into tiles, so that a task's memory depends on neither side's number of rows.
    With digits, cosines are rounded before they are ranked.
    Null vectors and vectors of another length than the query's take no part; vectors without length have cosine 0.
    """
    spark = items.sparkSession
    equal = F.coalesce(F.col(same).cast("string"), F.lit("")) if same else F.lit("")
    q = queries.where(F.col(vector).isNotNull() & F.col(query_key).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v"), equal.alias("s"))
    rows = items.where(F.col(vector).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).alias("i"), F.col(vector).cast("array<double>").alias("v"), equal.alias("s"))
    kind, qkind = items.schema[item_key].dataType.simpleString(), q.schema["q"].dataType.simpleString()
    folder = shared_folder(spark, "queries")
    n = q.count() if k > 0 else 0
    blocks = max(1, math.ceil(n / max(1, min(QUESTION_ROWS, HELD_ROWS // max(k, 1)))))
    block_of = lambda value: F.pmod(F.crc32(value), F.lit(blocks)).cast("int")
    if n:
        q.withColumn("block", block_of(F.col("s") if same else F.col("q").cast("string"))).repartition(min(blocks, 2000), "block").write.partitionBy("block").parquet(folder)
    item_rows, held_rows, kept_blocks, question_rows = ITEM_ROWS, HELD_ROWS, KEPT_BLOCKS, QUESTION_ROWS

    def opened(at: str) -> tuple:
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(at if "://" in at else f"file://{at.removeprefix('file:')}")

    def block(number: int) -> dict[tuple[str, int], tuple[pa.Array, np.ndarray]]:
        """Keys and unit vectors of a block's queries by what must be equal and by length."""
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        files, path = opened(folder)
        at = f"{path}/block={number}"
        if files.get_file_info(at).type == FileType.NotFound:
            return {}
        t = ds.dataset(at, filesystem=files, format="parquet").to_table().combine_chunks()
        return {(name, size): (keys[0], units) for name, size, keys, units in _by_size(t, "q")}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """The batches together, some thousand rows each."""
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            waiting.append(b)
            if sum(x.num_rows for x in waiting) >= item_rows:
                yield pa.Table.from_batches(waiting)
                waiting = []
        if sum(x.num_rows for x in waiting):
            yield pa.Table.from_batches(waiting)

    def stored(share: int, shares: int) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        files, path = opened(item_folder)
        for info in sorted((x for x in files.get_file_info(FileSelector(path)) if x.path.endswith(".parquet")), key=lambda x: x.path)[share::shares]:
            with files.open_input_file(info.path) as source:
                yield from pq.ParquetFile(source).iter_batches(item_rows, use_threads=False)

    def through_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number in (x for b in batches for x in b.column("id").to_pylist()):
            asked = block(number // shares)
            found: dict[tuple[str, int], list[pa.Table]] = {}
            least: dict[tuple[str, int], np.ndarray] = {}
            for table in gathered(stored(number % shares, shares)) if asked else ():
                for name, size, ids, units in _by_size(table, "i"):
                    if (name, size) not in asked:
                        continue
                    keys, questions = asked[name, size]
                    mine = found.setdefault((name, size), [])
                    mine.append(_compared(keys, questions, ids[0], units, k, digits, least.get((name, size))))
                    if len(mine) == 1 or sum(x.num_rows for x in mine[1:]) > k * len(keys):
                        mine[:] = [_best(mine, k)]
                        least[name, size] = _least(mine[0], keys, k)
            for mine in found.values():
                yield from _best(mine, k).to_batches(item_rows)

    def through_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        asked = lru_cache(kept_blocks)(block)
        for table in gathered(batches) if n else ():
            groups = list(_by_size(table, "i"))
            for number in sorted({zlib.crc32(name.encode()) % blocks for name, *_ in groups}):
                found, count = [held[number]] if number in held else [], 0
                for name, size, ids, units in groups:
                    keys, questions = asked(number).get((name, size), ((), ()))
                    for at in range(0, len(keys), question_rows):
                        found.append(_compared(keys[at : at + question_rows], questions[at : at + question_rows], ids[0], units, k, digits))
                        count += found[-1].num_rows
                        if count > held_rows:
                            found, count = [_best(found, k)], 0
                if found:
                    held[number] = _best(found, k)
                if sum(x.num_rows for x in held.values()) > held_rows:
                    for x in held.values():
                        yield from x.to_batches()
                    held = {}
        for x in held.values():
            yield from x.to_batches()

    schema = f"q {qkind}, i {kind}, score double"
    if same or not n:
        found = rows.mapInArrow(through_blocks, schema)
    else:
        item_folder = shared_folder(spark, "items")
        rows.write.parquet(item_folder)
        shares = math.ceil(2 * spark.sparkContext.defaultParallelism / blocks)
        found = spark.range(0, blocks * shares, 1, blocks * shares).mapInArrow(through_items, schema)
    found = found.select(F.col("q").alias(query_key), F.col("i").alias(item_key), "score")
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), item_key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(k, 0))
