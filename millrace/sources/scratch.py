"""Places for written tables: the shared folder that the session names, or, with a local master only, one of its own."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path, removed when the driver ends. On a cluster the session must name a shared folder in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    if not _written:
        atexit.register(_remove_all)
    _written.append(f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written once and read back, for what several steps work on."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    with suppress(Exception):
        spark = SparkSession.getActiveSession()
        for path in _written:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
