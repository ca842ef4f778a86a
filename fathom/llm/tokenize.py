"""Problem 7: encode texts with a public byte-level BPE vocabulary.

Pre-tokenisation works on arrays: every code point gets a class, every class is a transition function on a few states,
and functions compose associatively. Blocks of code points are composed side by side, a scan over the blocks' functions
gives each block its first state, and a second pass yields the places where a pre-token begins. The slices between
them go through pair merging once each; a cache in the worker keeps their ids.
"""

from __future__ import annotations

import base64
import heapq
import os
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import batch_codepoints

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
CHARS_A_BATCH, CACHE_SIZE, CACHE_IDS, BLOCK = 1_000_000, 400_000, 4_000_000, 128

# classes of code points
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_IN, SPACE_LAST, BLANK_LAST = range(8)  # SHORT, LONG: an apostrophe before a contraction of one or two letters
FIRST = 8  # added to the class of a text's first code point
# states: what the code point before belongs to
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_SPACE, ONE_MORE, TWO_MORE, CLOSED = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins, by class and state."""
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for state in range(8):
        for kind, inside in ((LETTER, IN_LETTER), (NUMBER, IN_NUMBER), (OTHER, IN_OTHER)):
            step[kind, state], begins[kind, state] = inside, state not in (inside, AFTER_SPACE)
        for kind, rest in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
            goes_on = state in (IN_OTHER, AFTER_SPACE)
            step[kind, state], begins[kind, state] = (IN_OTHER if goes_on else rest), not goes_on
        step[SPACE_IN, state], begins[SPACE_IN, state] = IN_SPACE, state != IN_SPACE
        step[SPACE_LAST, state], begins[SPACE_LAST, state] = AFTER_SPACE, True
        step[BLANK_LAST, state], begins[BLANK_LAST, state] = CLOSED, True
    step[LETTER, TWO_MORE], begins[LETTER, TWO_MORE] = ONE_MORE, False
    step[LETTER, ONE_MORE], begins[LETTER, ONE_MORE] = CLOSED, False
    for kind in range(8):  # whatever came before, a text begins afresh
        step[FIRST + kind, :], begins[FIRST + kind, :] = step[kind, CLOSED], True
    return step, begins


STEP, BEGINS = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_IN of every code point."""
    import regex

    every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(sys.maxunicode + 1)]
    text = "".join(every)
    table = np.full(len(every), OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE_IN, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[m.start() : m.end()] = kind
    table[0xD800:0xE000] = OTHER
    return table


def _scan(classes: np.ndarray) -> np.ndarray:
    """The state before every code point, by composing the classes' transition functions."""
    n = len(classes)
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, 255, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)
    step = np.concatenate([STEP, np.tile(np.arange(8, dtype=np.uint8), (240, 1))])
    flat = step.reshape(-1)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # each block's function
    for column in grid:
        whole = flat[column.astype(np.int32)[:, None] * 8 + whole]
    width = 1
    while width < rows:  # inclusive scan of the blocks' functions
        later = np.take_along_axis(whole[width:], whole[:-width].astype(np.intp), axis=1)
        whole = np.concatenate([whole[:width], later])
        width *= 2
    state = np.concatenate([[CLOSED], whole[:-1, CLOSED]]).astype(np.uint8)
    before = np.empty((BLOCK, rows), np.uint8)
    for k, column in enumerate(grid):
        before[k] = state
        state = flat[column.astype(np.int32) * 8 + state]
    return before.T.reshape(-1)[:n]


def pretoken_starts(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts laid end to end begin."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts = np.zeros(n + 1, bool)
    starts[firsts] = True
    starts[n] = True
    space = kind == SPACE_IN
    follows = np.append(kind[1:] != SPACE_IN, False) & ~starts[1:]  # a code point that is no space follows in the same text
    kind = np.where(space & follows, np.where(cp == 32, SPACE_LAST, BLANK_LAST), kind)

    def ahead(k: int) -> np.ndarray:
        out = np.zeros(n, np.uint32)
        out[: n - k] = cp[k:] if k else cp
        return out

    quotes = np.flatnonzero(cp == 39)
    if len(quotes):
        a, b = ahead(1)[quotes], ahead(2)[quotes]
        one = ~starts[quotes + 1]
        two = one & ~starts[np.minimum(quotes + 2, n)] & (quotes + 2 <= n)
        is_in = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        kind[quotes[one & is_in(a, "stmd")]] = SHORT
        pair = (is_in(a, "rv") & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        kind[quotes[two & pair]] = LONG
    kind[firsts] += FIRST
    return np.flatnonzero(BEGINS.reshape(-1)[kind.astype(np.int32) * 8 + _scan(kind)])


class Merger:
    """Byte pair merging by rank with a cache of pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: list[int] = []
        self.ends: list[int] = [0]

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair is in the vocabulary."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n = len(piece)
        ranks = self.ranks
        nxt, prev, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := nxt[i]) >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def entry(self, piece: str) -> int:
        self.ids += self.merge(piece.encode())
        self.ends.append(len(self.ids))
        self.known[piece] = len(self.ends) - 2
        return len(self.ends) - 2

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the n + 1 offsets of the texts."""
        if len(self.known) > CACHE_SIZE or len(self.ids) > CACHE_IDS:
            self.clear()
        cp, offsets = batch_codepoints(texts)
        starts = pretoken_starts(cp, offsets)
        joined = "".join(texts)
        cuts = starts.tolist() + [len(joined)]
        known, entry = self.known.get, self.entry
        rows = np.fromiter((e if (e := known(s)) is not None else entry(s) for s in (joined[a:b] for a, b in zip(cuts, cuts[1:]))), dtype=np.int64, count=len(starts))
        ends, flat = np.array(self.ends), np.array(self.ids, dtype=np.int32)
        sizes = ends[rows + 1] - ends[rows]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(ends[rows] - total[:-1], sizes) + np.arange(total[-1])] if len(rows) else np.zeros(0, np.int32)
        return ids, total[np.searchsorted(starts, offsets)]


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(2)
def token_bytes(path: str) -> dict[int, bytes]:
    return {i: b for b, i in merger(path).ranks.items()}


def in_shares(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in runs of about most characters; a longer text stands alone."""
    share: list[str] = []
    size = 0
    for t in texts:
        if share and size + len(t) > most:
            yield share
            share, size = [], 0
        share.append(t)
        size += len(t)
    if share:
        yield share


def _arranged(df: DataFrame, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, str]:
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    return rows, "".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))


def encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = TOKENIZERS, offsets: bool = False) -> DataFrame:
    """The kept columns and ids, the text's token ids (array<int>) without special tokens.

    Null and empty texts give an empty array. The text is encoded as it stands; strings that look like special tokens are
    ordinary text. With offsets, starts (array<int>) has the UTF-8 byte at which each token begins. Repeated rows stay
    repeated; other columns of df are left out.
    """
    rows, kept = _arranged(df, text, keep)
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            done = 0
            for texts in in_shares(batch.column("body").to_pylist(), CHARS_A_BATCH):
                ids, at = m.encode(texts)
                at = at.astype(np.int32)
                out = [pa.ListArray.from_arrays(pa.array(at), pa.array(ids))]
                if offsets:
                    names = token_bytes(path)
                    size = np.fromiter((len(names[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids))
                    first = np.concatenate([[0], np.cumsum(size)])
                    out.append(pa.ListArray.from_arrays(pa.array(at), pa.array((first[:-1] - np.repeat(first[at[:-1]], np.diff(at))).astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(f"k{i}").slice(done, len(texts)) for i in range(len(keep))] + out, names=[f"k{i}" for i in range(len(keep))] + ["ids", "starts"][: len(out)])
                done += len(texts)

    out = rows.mapInArrow(run, f"{kept}ids array<int>" + ", starts array<int>" * offsets)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", *["starts"] * offsets)


def count_tokens(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The kept columns and n_tokens (bigint), 0 for null and empty texts."""
    rows, kept = _arranged(df, text, keep)
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            sizes = [np.diff(m.encode(texts)[1]) for texts in in_shares(batch.column("body").to_pylist(), CHARS_A_BATCH)]
            n = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(keep))] + [pa.array(n, pa.int64())], names=[f"k{i}" for i in range(len(keep))] + ["n_tokens"])

    out = rows.mapInArrow(run, f"{kept}n_tokens bigint")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens")


def decode(df: DataFrame, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The kept columns and text, the ids read back; null ids give null, bytes that are no UTF-8 become U+FFFD."""
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(ids).cast("array<int>").alias("ids"))
    kept = "".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    path = f"{folder}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_bytes(path)
        for batch in batches:
            texts = [None if x is None else b"".join(names[i] for i in x).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f"k{i}") for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[f"k{i}" for i in range(len(keep))] + ["text"])

    out = rows.mapInArrow(run, f"{kept}text string")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text")
