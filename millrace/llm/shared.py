"""Written intermediate tables in the cluster's shared folder, and a size-bounded Bloom filter built by Spark."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_tables: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir if the session names one, else a set checkpoint folder, else, with a
    local master only, a fresh local one. On a cluster without either this raises: executors don't see each other's local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, removed when the driver ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written = path
    return out


def bucketed(df: DataFrame, by: str, label: str) -> DataFrame:
    """Write df to the shared folder as a table bucketed and sorted by a column, with a bucket for each shuffle partition, and read
    it back: joins and aggregates by that column need no shuffle of it. df should come from an aggregate by that column, whose
    partitions are the buckets; else each task writes a file for each bucket."""
    spark = df.sparkSession
    path, name, n = shared_path(spark, label), f"{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(name)
    _tables.append(name)
    out = spark.table(name)
    out.written, out.table = path, name
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what materialise or bucketed wrote, once nothing will read it again."""
    for df in tables:
        if table := getattr(df, "table", None):
            df.sparkSession.sql(f"drop table if exists {table}")
            _tables.remove(table)
        _remove(df.sparkSession, df.written)
        _written.remove(df.written)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    with suppress(Exception):
        spark = SparkSession.getActiveSession()
        for table in _tables:
            spark.sql(f"drop table if exists {table}")
        for path in _written:
            _remove(spark, path)


def least_of_most_frequent(table: DataFrame, column: str, most: int) -> int:
    """The least count in a column of counts such that no more than `most` rows have it or a higher one, told from a histogram of at
    most 512 bars; greater than any count if even the highest are too many."""
    bar = F.floor(F.log2(F.col(column)) * 8).alias("bar")
    bars = table.where(F.col(column) > 0).groupBy(bar).agg(F.min(column).alias("least"), F.count("*").alias("rows")).collect()
    total, least = 0, np.iinfo(np.int64).max
    for r in sorted(bars, key=lambda r: -r["bar"]):
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return int(least)


def lean(run: Callable) -> Callable:
    """A task's function over batches that gives the memory which it no longer needs back to the system: workers are kept and used again."""

    def held(batches: Iterator) -> Iterator:
        yield from run(batches)
        _release()

    return held


def lean_frame(run: Callable) -> Callable:
    """The same for a function of a group's frame."""

    def held(frame):
        out = run(frame)
        _release()
        return out

    return held


def _release() -> None:
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


class BloomFilter:
    """Two-probe bit table over 64-bit keys, of 24 bits for each key but at most 2**most_log2_bits in all (2**28 bits are 32 MB), so
    that it can be broadcast; keys beyond that only mean more false hits, which the exact join that follows drops."""

    def __init__(self, words: np.ndarray, log2_bits: int):
        self.words, self.log2_bits = words, log2_bits

    @classmethod
    def build(cls, keys: DataFrame, column: str, most_log2_bits: int = 28) -> "BloomFilter":
        """Spark sets the bits (bitmap_construct_agg, 4 KB for each of 2**(log2_bits-15) buckets); only the table comes to the driver."""
        keys = materialise(keys.select(column), "keys")
        log2_bits = min(most_log2_bits, max(20, (24 * keys.count()).bit_length()))
        mask = (1 << log2_bits) - 1
        k = F.col(column)
        probes = keys.select(F.explode(F.array(k.bitwiseAND(mask), F.shiftrightunsigned(k, 64 - log2_bits))).alias("p")).select((F.col("p") + 1).alias("p"))
        rows = probes.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")).collect()
        table = np.zeros(1 << (log2_bits - 3), dtype=np.uint8)
        for b, m in rows:
            table[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(m), dtype=np.uint8)
        discard(keys)
        return cls(table, log2_bits)

    def hits(self, keys: np.ndarray) -> np.ndarray:
        """Which of the uint64 keys may be in the set."""
        a = (keys & np.uint64((1 << self.log2_bits) - 1)).astype(np.int64)
        b = (keys >> np.uint64(64 - self.log2_bits)).astype(np.int64)
        first = (self.words[a >> 3] >> (a & 7).astype(np.uint8)) & 1
        out = np.zeros(len(keys), dtype=bool)
        at = np.flatnonzero(first)
        b = b[at]
        out[at] = ((self.words[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)
        return out
