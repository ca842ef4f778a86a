"""The index of a source tree: chunks with their embeddings in Parquet, kept up to date file by file."""

from __future__ import annotations

import json
import os
import time
import uuid
from datetime import UTC, datetime

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import dedupe_stripped, no_null, strip
from fathom.functions.vectors import HASH_DIMENSIONS, hashing_embedding
from fathom.sources.extract import CHUNK_SCHEMA, extract_chunks

# Versions by which an index is found out of date.
SCHEMA_VERSION, TEXT_VERSION, MODEL = 2, 3, f"hashing-{HASH_DIMENSIONS}"
FILE_SCHEMA = "rel_path string, size bigint, mtime timestamp, sha256 string"


def embedding_text(df: DataFrame) -> Column:
    """What is embedded of a chunk: kind, name, place, imports, decorators, route hints, at most twelve calls, source."""
    c = F.col
    listed = lambda title, values: F.when(F.size(values) > 0, F.concat_ws("\n", F.lit(title), F.transform(values, lambda x: F.concat(F.lit("- "), x))))
    name = F.when(no_null(c("parent")) != "", F.concat_ws(".", "parent", "name")).otherwise(c("name"))
    place = F.concat(c("file_path"), F.lit(":"), c("start_line").cast("string"), F.lit("-"), no_null(c("end_line").cast("string")))
    parts = F.array_compact(F.array(
        F.concat(F.lit("type: "), c("chunk_type")), F.concat(F.lit("name: "), name), F.concat(F.lit("path: "), place), listed("imports:", c("imports")), listed("decorators:", c("decorators")),
        listed("framework hints:", route_hints(c("decorators"))), listed("dependencies:", dedupe_stripped(c("dependencies"), 12)), F.lit("source:"), F.regexp_replace(no_null(c("source_code")), r"\n+\z", ""),
    ))
    return F.concat(strip(F.array_join(parts, "\n")), F.lit("\n"))


def route_hints(decorators: Column) -> Column:
    """Two hints for each decorator that routes a request."""
    pattern = r"(?i)^@\w+\.(get|post|put|patch|delete)\(\s*(['\"])([^'\"]*)\2"
    routed = F.filter(decorators, lambda d: d.rlike(pattern))

    def hints(d: Column) -> Column:
        method = F.upper(F.regexp_extract(d, pattern, 1))
        return F.array(F.concat(F.lit("FastAPI route handler: "), method, F.lit(" "), F.regexp_extract(d, pattern, 3)), F.concat(method, F.lit(" route endpoint")))

    return F.flatten(F.transform(routed, hints))


def hashing_embedder(chunks: DataFrame) -> DataFrame:
    """Chunks with an embedding of their text; any function of this kind may take its place."""
    return chunks.withColumn("embedding", hashing_embedding(embedding_text(chunks)))


def diff_files(now: DataFrame, before: DataFrame, key: str = "rel_path", digest: str = "sha256") -> DataFrame:
    """(key, status) of every file: new, changed, unchanged or deleted. Without an old digest a file counts as changed."""
    a = now.select(F.col(key).alias("k"), F.col(digest).alias("new"), F.lit(True).alias("here"))
    b = before.select(F.col(key).alias("k"), F.col(digest).alias("old"), F.lit(True).alias("there"))
    c = F.col
    status = F.when(c("there").isNull(), "new").when(c("here").isNull(), "deleted").when(F.coalesce(c("new") == c("old"), F.lit(False)) & (no_null(c("old")) != ""), "unchanged").otherwise("changed")
    return a.join(b, "k", "full_outer").select(c("k").alias(key), status.alias("status"))


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: how many files are new, changed, unchanged and deleted."""
    return diff.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "unchanged", "deleted")])


class Index:
    """A folder of versions on storage that all executors share (a path without a scheme is a local one). A version is valid from
    when a pointer with its name is there; the newest pointer holds. A failed write leaves the index as it was."""

    def __init__(self, spark: SparkSession, folder: str, model: str = MODEL):
        self.spark, self.model = spark, model
        self.folder = folder.rstrip("/") if "://" in folder else "file://" + os.path.abspath(folder)
        self.files_of, self.path = FileSystem.from_uri(self.folder)

    def _current(self) -> str | None:
        """The name of the valid version."""
        found = self.files_of.get_file_info(FileSelector(self.path, allow_not_found=True))
        pointers = sorted(f.base_name for f in found if f.type == FileType.File and f.base_name.startswith("CURRENT-"))
        return pointers[-1].split("-", 2)[2] if pointers else None

    def exists(self) -> bool:
        at = self._current()
        return at is not None and all(f.type != FileType.NotFound for f in self.files_of.get_file_info([f"{self.path}/{at}/{x}" for x in ("chunks", "files", "meta.json")]))

    def metadata(self) -> dict:
        with self.files_of.open_input_stream(f"{self.path}/{self._current()}/meta.json") as f:
            return json.loads(f.read())

    def _write(self, name: str, text: str) -> None:
        with self.files_of.open_output_stream(f"{self.path}/{name}") as f:
            f.write(text.encode())

    def compatibility(self) -> str:
        """missing, outdated or compatible."""
        if not self.exists():
            return "missing"
        m = self.metadata()
        same = (m.get("index_schema_version"), m.get("embedding_text_version"), m.get("embedding_model_name")) == (SCHEMA_VERSION, TEXT_VERSION, self.model)
        return "compatible" if same else "outdated"

    def chunks(self) -> DataFrame:
        schema = CHUNK_SCHEMA + ", embedding array<double>"
        df = self.spark.read.schema(schema).parquet(f"{self.folder}/{self._current()}/chunks")
        return df.withColumn("decorators", F.coalesce("decorators", F.array().cast("array<string>")))

    def files(self) -> DataFrame:
        return self.spark.read.schema(FILE_SCHEMA).parquet(f"{self.folder}/{self._current()}/files")

    def save(self, chunks: DataFrame, files: DataFrame, created: str | None = None) -> dict:
        version = f"v-{uuid.uuid4().hex}"
        at = f"{self.folder}/{version}"
        chunks.write.parquet(f"{at}/chunks")
        files.select("rel_path", "size", "mtime", "sha256").write.parquet(f"{at}/files")
        now = datetime.now(UTC)
        counts = {"chunks_indexed": self.spark.read.parquet(f"{at}/chunks").count(), "files_indexed": self.spark.read.parquet(f"{at}/files").count()}
        meta = {"index_schema_version": SCHEMA_VERSION, "embedding_text_version": TEXT_VERSION, "embedding_model_name": self.model, "created_at": created or now.isoformat(), "updated_at": now.isoformat()} | counts
        self._write(f"{version}/meta.json", json.dumps(meta))
        self._write(f"CURRENT-{time.time_ns():020d}-{version}", "")
        return meta

    def update(self, files: DataFrame, rebuild: bool = False, embedder=hashing_embedder) -> dict:
        """Bring the index in line with files(repo, rel_path, source, size, mtime, sha256): parse and embed what is new or
        changed, keep the rest, drop what is gone. Everything is made anew if asked for, if the index is missing, outdated or
        empty. Returns the counts of the four kinds and the metadata."""
        state = self.compatibility()
        full = rebuild or state != "compatible" or self.metadata()["files_indexed"] == 0
        if full:
            meta = self.save(embedder(extract_chunks(files)), files)
            return {"new": meta["files_indexed"], "changed": 0, "unchanged": 0, "deleted": 0, "rebuilt": True} | meta
        diff = diff_files(files, self.files()).persist()
        counts = diff_summary(diff).first().asDict()
        fresh = files.join(diff.where("status in ('new', 'changed')").select("rel_path"), "rel_path", "left_semi")
        kept = self.chunks().join(diff.where("status = 'unchanged'").select(F.col("rel_path").alias("file_path")), "file_path", "left_semi")
        meta = self.save(kept.unionByName(embedder(extract_chunks(fresh))), files, self.metadata()["created_at"])
        diff.unpersist()
        return counts | {"rebuilt": False} | meta
