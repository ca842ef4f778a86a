"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []  # folders of this process, in order


def remove_tables() -> int:
    """Removes the intermediate tables that this process has made; for callers whose results are written. How many there were."""
    count = len(_MADE)
    while _MADE:
        folder = _MADE.pop()
        files, path = FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        if files.get_file_info(path).type == FileType.Directory:
            files.delete_dir(path)
    return count


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; in local mode below a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            base = kept.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            base = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _MADE.append(folder)
    return folder


def settle(df: DataFrame, purpose: str = "step") -> DataFrame:
    """The rows, written once and read back: what follows neither repeats their work nor depends on lost executors."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
