"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fathom.sources.tables import shared_folder

__all__ = ["batch_codepoints", "codepoints", "shared_folder", "steps", "table"]

CHARS_A_STEP = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codepoints(text: str) -> np.ndarray:
    """The text as an array of Unicode code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def batch_codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the n + 1 offsets of the texts."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    return codepoints("".join(texts)), np.concatenate([[0], np.cumsum(sizes)])


def steps(texts: list[str], most: int = CHARS_A_STEP) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts of at most so many characters together, or one longer text, each with the number of texts before."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
