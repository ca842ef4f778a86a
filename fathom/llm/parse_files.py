"""Problem 3: source files that are not valid for the language of their extension.

Each task parses its files with the recognisers of fathom.llm.grammar, which alone decide. They recover and go on to the end
of a file, however many faults it has. Rates are plain grouped counts over the verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.grammar import data, javascript, python

LANGUAGES = {"py": "python", "js": "javascript", "json": "json", "toml": "toml"}
RECOGNISERS: dict[str, Callable[[str], list[tuple[int, str]]]] = {"python": python.faults, "javascript": javascript.faults, "json": data.json_faults, "toml": data.toml_faults}


def language(path: Column) -> Column:
    """The language a path's extension stands for; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z]+)$", 1))
    return F.coalesce(*[F.when(ext == e, F.lit(name)) for e, name in LANGUAGES.items()])


def verdicts(df: DataFrame, keep: tuple[str, ...] = ("file_id", "repo"), path: str = "file_path", source: str = "source") -> DataFrame:
    """One row per file with a source and a known extension: the kept columns, language, accepted, first_line, first_fault,
    faults (array of "line: message").

    A null source gives no row. An empty text is accepted except for JSON. Line ends may be mixed; a file with a NUL
    character is not valid. Repeated rows give their verdict again.
    """
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], language(F.col(path)).alias("language"), F.col(source).alias("body")).where("language is not null and body is not null")
    kept = "".join(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}, " for i in range(len(keep)))
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lang, text in zip(b.column("language").to_pylist(), b.column("body").to_pylist()):
                found.append(RECOGNISERS[lang](text))
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names]
                + [b.column("language"), pa.array([not f for f in found]), pa.array([f[0][0] if f else None for f in found], pa.int32()), pa.array([f[0][1] if f else None for f in found], pa.string()), pa.array([[f"{n}: {what}" for n, what in f] for f in found], pa.list_(pa.string()))],
                names=[*names, "language", "accepted", "first_line", "first_fault", "faults"],
            )

    out = rows.mapInArrow(run, f"{kept}language string, accepted boolean, first_line int, first_fault string, faults array<string>")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "language", "accepted", "first_line", "first_fault", "faults")


def rates(found: DataFrame, key: str = "file_id", repo: str = "repo") -> DataFrame:
    """Per repository and language: files, invalid files and their rate; a file that occurs twice counts once, and is
    invalid if one of its rows is. A null repo is a group of its own."""
    files = found.groupBy(repo, "language", key).agg(F.min("accepted").alias("ok"))
    return files.groupBy(repo, "language").agg(F.count("*").alias("files"), F.count_if(~F.col("ok")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
