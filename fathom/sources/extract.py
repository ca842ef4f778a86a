"""Source trees to rows: scan files, read text, parse Python, cut it into chunks with their imports and calls."""

from __future__ import annotations

import ast
import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.paths import is_excluded

CHUNK_SCHEMA = "id string, repo string, file_path string, chunk_type string, name string, parent string, start_line int, end_line int, source_code string, imports array<string>, dependencies array<string>, decorators array<string>"


def scan(spark: SparkSession, root: str, repo: str = "", pattern: str = "*.py") -> DataFrame:
    """(repo, rel_path, source, size, mtime, sha256) of the files below root, without the folders that scans leave out.

    Bytes that are no UTF-8 become U+FFFD. A missing root raises FileNotFoundError, a file NotADirectoryError.
    """
    local = root.removeprefix("file://")
    if "://" not in local:
        if not os.path.exists(local):
            raise FileNotFoundError(root)
        if not os.path.isdir(local):
            raise NotADirectoryError(root)
        root = "file://" + os.path.abspath(local)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = F.regexp_replace("path", "^file:/+", "file:///")
    rel = F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))
    rows = raw.select(F.lit(repo).alias("repo"), rel.alias("rel_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    return rows.where(~is_excluded(F.col("rel_path")))


def chunk_id(path: Column, kind: Column, parent: Column, name: Column, start: Column, end: Column) -> Column:
    """The identity of a chunk: SHA-1 of its place, not of its text."""
    return F.sha1(F.concat_ws(":", path, kind, F.coalesce(parent, F.lit("")), name, start.cast("string"), end.cast("string")))


class _Calls(ast.NodeVisitor):
    """Names that a definition calls, each with its shorter forms, and local definitions that it mentions."""

    def __init__(self, local: set[str]):
        self.local, self.seen = local, {}

    def note(self, *names: str) -> None:
        self.seen.update((n, None) for n in names if n)

    def visit_Call(self, node: ast.Call) -> None:
        target, tail = node.func, []
        while isinstance(target, ast.Attribute):
            tail.append(target.attr)
            target = target.value
        if isinstance(target, ast.Name):
            whole = ".".join([target.id, *reversed(tail)])
            self.note(whole, *([tail[0]] if tail else []), *([whole.split(".", 1)[1]] if tail and target.id in ("self", "cls") else []))
        elif tail:
            self.note(tail[0])
        self.generic_visit(node)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load) and node.id in self.local:
            self.note(node.id)


FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def import_lines(tree: ast.Module) -> list[str]:
    """The imports at the top level, one normal line each."""
    out = []
    for node in tree.body:
        if isinstance(node, ast.Import | ast.ImportFrom):
            names = ", ".join(a.name + (f" as {a.asname}" if a.asname else "") for a in node.names)
            out.append(f"import {names}" if isinstance(node, ast.Import) else f"from {'.' * node.level}{node.module or ''} import {names}")
    return out


def chunks_of(path: str, source: str) -> list[tuple]:
    """Functions, classes and methods of a file, as they come; empty if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, imports = source.splitlines(), import_lines(tree)
    local = {n.name for n in tree.body if isinstance(n, (*FUNCTIONS, ast.ClassDef))}
    out = []

    def add(node: ast.AST, kind: str, parent: str | None) -> None:
        start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        end = node.end_lineno or node.lineno
        marks = ["@" + " ".join((ast.get_source_segment(source, d) or ast.unparse(d)).split()) for d in node.decorator_list]
        calls = _Calls(local)
        if kind != "class":
            calls.visit(node)
        key = f"{path}:{kind}:{parent or ''}:{node.name}:{start}:{end}"
        out.append((hashlib.sha1(key.encode()).hexdigest(), kind, node.name, parent, start, end, "\n".join(lines[start - 1 : end]), imports, list(calls.seen), marks))

    for node in tree.body:
        if isinstance(node, FUNCTIONS):
            add(node, "function", None)
        elif isinstance(node, ast.ClassDef):
            add(node, "class", None)
            for inner in node.body:
                if isinstance(inner, FUNCTIONS):
                    add(inner, "method", node.name)
    return out


def extract_chunks(files: DataFrame, path: str = "rel_path", source: str = "source", repo: str = "repo") -> DataFrame:
    """The chunks of every Python file, as CHUNK_SCHEMA. Files that do not parse and null sources have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "repo", "file_path", "chunk_type", "name", "parent", "start_line", "end_line", "source_code", "imports", "dependencies", "decorators"]
        for pdf in batches:
            rows = [(c[0], r, p, *c[1:]) for r, p, s in zip(pdf["repo"], pdf["path"], pdf["body"]) for c in chunks_of(p, s)]
            yield pd.DataFrame(rows, columns=names)

    rows = files.where(F.col(source).isNotNull() & F.endswith(F.lower(path), F.lit(".py"))).select(F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(source).alias("body"))
    return rows.mapInPandas(run, CHUNK_SCHEMA)


def line_chunks(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, chunk_no, start_line, end_line, id) of consecutive blocks of size lines; null texts have none."""
    rows = df.where(F.col(text).isNotNull()).select(key, F.size(F.split(text, "\n")).alias("n"))
    rows = rows.select(key, "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))).alias("i"))
    rows = rows.select(key, (F.col("i") + 1).alias("chunk_no"), (F.col("i") * size + 1).alias("start_line"), F.least(F.col("i") * size + size, F.col("n")).alias("end_line"))
    return rows.withColumn("id", chunk_id(F.col(key).cast("string"), F.lit("lines"), F.lit(None).cast("string"), F.lit("block"), F.col("start_line"), F.col("end_line")))
