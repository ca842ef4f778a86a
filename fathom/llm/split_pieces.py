"""Problem 1: cut oversized texts into overlapping pieces at natural boundaries.

Every place where a text may be cut is a boundary. Each boundary gets its farthest legal successor (the start of
the following piece, overlap included); squaring that successor table marks every start reached from the beginning
of each text in a logarithmic number of steps, for all texts of an Arrow batch at once. No row leaves its task, so
the operator needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import batch_codepoints, steps

MAX_CHARS, MAX_LINES, OVERLAP = 3000, 80, 5
#: Levels of a boundary: 0-3 item after a blank line by depth, 4 statement, 5 line, 6 after a separator, 7 anywhere.
STATEMENT, LINE, SOFT, HARD = 4, 5, 6, 7
SEPARATORS = np.array([ord(c) for c in " \t;,{}()[]"], dtype=np.uint32)


def oversized(text: Column, max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES) -> Column:
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (F.length(text) > max_chars) | (lines > max_lines)


def boundaries(cp: np.ndarray, offsets: np.ndarray, max_chars: int) -> dict[str, np.ndarray]:
    """Positions where the texts may be cut, with line number (global in the batch), level and end of the piece before."""
    newline = np.flatnonzero(cp == 10) + 1
    # an empty last line after a final newline starts where the next text starts; it adds no boundary
    line_at = np.unique(np.concatenate([offsets[:-1], newline]))
    line_at = line_at[line_at < offsets[-1]]
    ends = np.append(line_at[1:], offsets[-1])
    blank_char = (cp == 32) | (cp == 9) | (cp == 13) | (cp == 10)
    solid = np.append(np.flatnonzero(~blank_char), len(cp))
    first = solid[np.searchsorted(solid, line_at)]
    blank = first >= ends
    indent = np.where(blank, 0, first - line_at)
    before_blank = np.append(True, blank[:-1])
    before_indent = np.append(0, indent[:-1])
    level = np.where(before_blank, np.minimum(indent // 4, 3), np.where(indent <= before_indent, STATEMENT, LINE))
    level = np.where(blank, LINE, level)
    level[np.isin(line_at, offsets[:-1])] = 0

    extra, kind = [], []
    for k in np.flatnonzero(ends - line_at > max_chars):
        a, b = line_at[k], ends[k]
        soft = np.flatnonzero(np.isin(cp[a : b - 1], SEPARATORS)) + a + 1
        gaps = np.concatenate([[a], soft, [b]])
        wide = np.flatnonzero(np.diff(gaps) > max_chars // 4)
        hard = [np.arange(gaps[w] + max_chars // 4, gaps[w + 1], max_chars // 4) for w in wide]
        for part, lv in ((soft, SOFT), (np.concatenate(hard) if hard else np.array([], dtype=np.int64), HARD)):
            part = part[(part > a) & (part < b)]
            extra.append(part)
            kind.append(np.full(len(part), lv))
    pos, lev = np.concatenate([line_at, *extra]), np.concatenate([level, *kind])
    is_line = np.concatenate([np.ones(len(line_at), bool), *(np.zeros(len(x), bool) for x in extra)])
    order = np.argsort(pos, kind="stable")
    pos, lev, is_line = pos[order], lev[order], is_line[order]
    pos, keep = np.unique(pos, return_index=True)
    lev, is_line = lev[keep], is_line[keep]
    return {"pos": pos, "level": lev, "is_line": is_line, "line": np.cumsum(is_line) - 1}


def cut(texts: list[str], max_chars: int, max_lines: int, overlap: int) -> dict[str, np.ndarray]:
    """Pieces of all texts (none empty): text index, first and end character, first and last line, shared lines."""
    cp, offsets = batch_codepoints(texts)
    b = boundaries(cp, offsets, max_chars)
    # one row per boundary and a closing one per text, so that a text's own end never mixes with the next text's start
    text = np.searchsorted(offsets, b["pos"], side="right") - 1
    n_of = np.bincount(text, minlength=len(texts))
    closing = np.cumsum(n_of + 1) - 1
    at = np.arange(len(text)) + text
    n = len(text) + len(texts)

    def spread(values: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(n, dtype=np.int64)
        out[at], out[closing] = values, last
        return out

    first_of = closing - n_of
    pos = spread(b["pos"], offsets[1:])
    level = spread(b["level"], np.zeros(len(texts)))
    line = spread(b["line"], np.zeros(len(texts)))
    is_line = spread(b["is_line"], np.ones(len(texts))).astype(bool)
    is_close = np.zeros(n, bool)
    is_close[closing] = True
    line[closing] = line[closing - 1] + 1
    who = spread(text, np.arange(len(texts)))
    starts = np.zeros(n, bool)
    starts[first_of] = True
    ends_nl = cp[np.maximum(offsets[1:] - 1, 0)] == 10
    # end of the piece that stops here: without the newline before a line start; a final newline stays, so does its line
    end = np.where(is_line & ~starts & ~is_close, pos - 1, pos)
    end_line = np.where(is_line & ~starts, line - 1, line)
    end_count = end_line.copy()
    end_count[closing] += ends_nl  # the text counts one more, empty, line after a final newline
    shift = who * (max_chars + 1)  # keeps the searches below inside one text

    far = np.searchsorted(end + shift, pos + shift + max_chars, side="right") - 1
    line_shift = who * (max_lines + 2)
    far = np.minimum(far, np.searchsorted(end_count + line_shift, line + line_shift + max_lines - 1, side="right") - 1)
    far = np.minimum(far, closing[who])
    far = np.maximum(far, np.minimum(np.arange(n) + 1, closing[who]))
    half = np.searchsorted(end + shift, (pos + end[far]) // 2 + shift, side="right")
    best = far.copy()
    open_ = far != closing[who]
    for lv in range(HARD + 1):
        last = np.maximum.accumulate(np.where((level <= lv) & ~is_close & ~starts, np.arange(n), -1))
        hit = open_ & (last[far] >= half) & (last[far] > np.arange(n))
        best[hit] = last[far][hit]
        open_ &= ~hit

    line_index = np.flatnonzero(is_line & ~is_close)  # boundary where each line of the batch starts
    nxt, shared = best.copy(), np.zeros(n, dtype=np.int64)
    free = is_line[best] & ~is_close[best]
    for k in range(overlap, 0, -1):
        back = line_index[np.maximum(line[best] - k, 0)]
        ok = free & (back > np.arange(n)) & (who[back] == who) & (best[back] > best)
        nxt[ok], shared[ok] = back[ok], k
        free &= ~ok
    done = is_close[best]
    nxt[done] = np.arange(n)[done]

    reached, table = starts & ~is_close, nxt
    while True:
        reached[table[np.flatnonzero(reached)]] = True
        squared = table[table]
        if np.array_equal(squared, table):
            break
        table = squared
    reached &= ~is_close
    i = np.flatnonzero(reached)
    before = np.zeros(n, dtype=np.int64)
    go_on = i[~done[i]]
    before[nxt[go_on]] = shared[go_on]
    last_line = np.minimum(end_line[best[i]], line[np.maximum(closing[who[i]] - 1, 0)])
    base_line = line[first_of][who[i]]
    return {"text": who[i], "start": pos[i] - offsets[who[i]], "end": end[best[i]] - offsets[who[i]], "line": line[i] - base_line, "last": last_line - base_line, "shared": before[i]}


def split_oversized(df: DataFrame, text: str = "source_code", start_line: str = "start_line", keys: tuple[str, ...] = ("id",), max_chars: int = MAX_CHARS, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every row whose text has more than max_chars code points or max_lines lines.

    Result: the keys, piece_no (from 1), n_pieces, start_line, end_line, start_char, end_char (offsets in the text,
    end excluded), shared_lines (whole lines repeated from the piece before) and piece. A piece ends without the newline
    that parts it from the next one. Null and empty texts, and texts within both limits, give no rows; repeated rows give
    their pieces once each; a null start_line counts as 1. A line longer than max_chars is cut after separators, and
    where there are none, anywhere; such cuts share no lines. Other columns of df are left out, whatever their names.
    """
    if max_chars < 4 or max_lines < 2 or not 0 <= overlap < max_lines:
        raise ValueError("limits too small for a piece")
    big = df.where(oversized(F.col(text), max_chars, max_lines)).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(start_line).cast("int"), F.lit(1)).alias("first"), F.col(text).alias("body"))
    key_types = ", ".join(f"k{i} {big.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for done, texts in steps(batch.column("body").to_pylist()):
                p = cut(texts, max_chars, max_lines, overlap)
                rows = pa.array(p["text"] + done)
                counts = np.bincount(p["text"], minlength=len(texts))
                number = np.arange(len(p["text"])) - np.concatenate([[0], np.cumsum(counts)[:-1]])[p["text"]] + 1
                first = batch.column("first").to_numpy()[p["text"] + done]
                body = [texts[t][a:e] for t, a, e in zip(p["text"].tolist(), p["start"].tolist(), p["end"].tolist())]
                i32 = lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(f"k{i}").take(rows) for i in range(len(keys))] + [i32(number), i32(counts[p["text"]]), i32(first + p["line"]), i32(first + p["last"]), i32(p["start"]), i32(p["end"]), i32(p["shared"]), pa.array(body, pa.string())],
                    names=[f"k{i}" for i in range(len(keys))] + ["piece_no", "n_pieces", "start_line", "end_line", "start_char", "end_char", "shared_lines", "piece"],
                )

    out = big.mapInArrow(run, f"{key_types}, piece_no int, n_pieces int, start_line int, end_line int, start_char int, end_char int, shared_lines int, piece string")
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *out.columns[len(keys) :])
