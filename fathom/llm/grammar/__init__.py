"""Recursive-descent recognisers of the languages that source files are written in."""

from __future__ import annotations

import sys
from collections.abc import Callable

FRAMES_A_CHARACTER = 20  # no recogniser opens more calls for one token


def unbounded[T](read: Callable[[str], T], source: str) -> T:
    """The result of a recogniser that calls itself for what is nested: where the interpreter's limit is met, read again with
    a limit that the text can't meet. Calls of Python functions take memory, but no stack of the thread."""
    try:
        return read(source)
    except RecursionError:
        kept = sys.getrecursionlimit()
        sys.setrecursionlimit(min(2**31 - 1, kept + FRAMES_A_CHARACTER * len(source)))
        try:
            return read(source)
        finally:
            sys.setrecursionlimit(kept)
