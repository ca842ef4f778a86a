"""Streams of changed files and of test logs: each micro-batch goes through the same operators as a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.sources.extract import extract_chunks
from fathom.sources.index import hashing_embedder


def stream_chunks(files: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Parse and embed files(repo, rel_path, source, sha256) as they arrive; chunks are appended by batch to target.

    A file that comes several times in a batch counts once, with its latest mtime if there is one, else its greatest digest. A
    null source says that the file is gone. Every file of a batch leaves a row without an id besides its chunks, so that files
    that have none any more are known as well. Readers keep each file's newest batch (latest_chunks).
    """

    def write(batch: DataFrame, epoch: int) -> None:
        age = [c for c in ("mtime", "sha256") if c in batch.columns]
        fresh = batch.groupBy("repo", "rel_path").agg(F.max_by("source", F.struct(*age, F.col("source").isNotNull())).alias("source"))
        chunks = hashing_embedder(extract_chunks(fresh))
        seen = fresh.select("repo", F.col("rel_path").alias("file_path"))
        rows = chunks.unionByName(seen, allowMissingColumns=True).withColumn("batch", F.lit(epoch).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{target}/batch={epoch}")  # a repeated batch replaces itself

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """Of each file the chunks of its newest batch; none of files that were emptied, broken or deleted in it."""
    newest = chunks.groupBy("repo", "file_path").agg(F.max("batch").alias("batch"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("repo", "file_path", "batch")]
    return chunks.where("id is not null").alias("c").join(newest.alias("n"), same, "left_semi")


def failure_counts(failures: DataFrame, time: str = "failed_at", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Failures per window, repository and error type; rows later than the watermark are left out when streamed."""
    return failures.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "repo", "error_type").agg(F.count("*").alias("failures")).select(F.col("w.start").alias("window_start"), "repo", "error_type", "failures")
