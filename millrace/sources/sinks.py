"""Tables out: append, overwrite of partitions, validated and partitioned writes. Row counts come from the write itself."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.scratch import kept


def append(df: DataFrame, table: str) -> int:
    """Append to a table that exists and return the rows written, observed by the write's own job; an empty frame is no error."""
    if not df.sparkSession.catalog.tableExists(table):
        raise ValueError(f"no table {table}")
    seen = Observation(f"append-{uuid.uuid4().hex}")
    df.select(df.sparkSession.table(table).columns).observe(seen, F.count("*").alias("rows")).write.mode("append").format("parquet").saveAsTable(table)
    return seen.get["rows"]


def create_if_absent(spark: SparkSession, table: str, schema: T.StructType, path: str | None = None) -> bool:
    """Create an empty Parquet table of a declared schema unless it exists; whether it was created."""
    if spark.catalog.tableExists(table):
        return False
    spark.catalog.createTable(table, path=path, source="parquet", schema=schema)
    return True


def append_or_create(df: DataFrame, table: str, schema: T.StructType, path: str | None = None) -> int:
    """Append, to a table that is created with the declared schema on the first write."""
    create_if_absent(df.sparkSession, table, schema, path)
    return append(df, table)


def write_batch(frames: dict[str, DataFrame]) -> DataFrame:
    """Append to several tables: (table_name, success, records, seconds, error) for each; one failure leaves the others alone. Loops
    over tables; each write is a Spark job."""
    log = []
    for table, df in frames.items():
        began = time.perf_counter()
        try:
            log.append((table, True, append(df, table), time.perf_counter() - began, None))
        except Exception as e:  # whatever a write raises is its entry in the log
            log.append((table, False, 0, time.perf_counter() - began, str(e).split("\n")[0][:200]))
    spark = next(iter(frames.values())).sparkSession
    return spark.createDataFrame(log, "table_name string, success boolean, records long, seconds double, error string")


def table_statistics(spark: SparkSession, tables: list[str]) -> DataFrame:
    """Fields, rows and place of each catalog table."""
    out = None
    for table in tables:
        df = spark.table(table)
        where = spark.sql(f"describe formatted {table}").where("col_name = 'Location'").select(F.col("data_type").alias("location"))
        one = df.agg(F.count("*").alias("rows")).select(F.lit(table).alias("table_name"), F.lit(len(df.columns)).alias("fields"), "rows").join(F.broadcast(where))  # one row by one row
        out = one if out is None else out.unionByName(one)
    return out


def merge(df: DataFrame, table: str) -> tuple[int, str]:
    """Merging is not supported by Parquet tables: an append, and the warning that says so."""
    return append(df, table), "merge is written as append"


def write_partitioned(df: DataFrame, path: str, columns: list[str]) -> None:
    """One task writes each partition's file; a hot partition is split by Spark (rebalance)."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"no such columns: {missing}")
    df.hint("rebalance", *columns).write.partitionBy(*columns).mode("overwrite").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, columns: list[str]) -> None:
    df.write.partitionBy(*columns).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def validated(df: DataFrame, declared: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    """The declared columns that are there, those missing, and those dropped."""
    return df.select([c for c in declared if c in df.columns]), [c for c in declared if c not in df.columns], [c for c in df.columns if c not in declared]


def within(expected: DataFrame, written: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Whether the numbers of rows differ by no more than the tolerance."""
    both = expected.agg(F.count("*").alias("expected")).crossJoin(written.agg(F.count("*").alias("written")))  # one row by one row
    return both.withColumn("valid", F.abs(F.col("written") - F.col("expected")) <= tolerance * F.col("expected"))


# ---- appends that may be run again


def append_run(df: DataFrame, root: str, run: str) -> int:
    """Append df to the table of runs below root as one run, and return that run's rows. Rows are first written to a folder of their own; the run
    counts once its manifest stands, which is put in place by one rename. A run that is committed is not written again, so
    a retry adds nothing, and an attempt that fails leaves files that no reader takes."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    manifest = path(f"{root}/manifest/{run}.json")
    if fs.exists(manifest):
        return json.loads(_text(spark, fs, manifest))["rows"]
    attempt = uuid.uuid4().hex
    seen = Observation(f"run-{attempt}")
    df.observe(seen, F.count("*").alias("rows")).write.parquet(f"{root}/data/run={run}/attempt={attempt}")
    entry = {"run": run, "attempt": attempt, "rows": seen.get["rows"]}
    staged = path(f"{root}/staged/{attempt}.json")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    fs.mkdirs(manifest.getParent())
    if not fs.exists(manifest) and fs.rename(staged, manifest):
        return entry["rows"]
    return json.loads(_text(spark, fs, manifest))["rows"]  # another attempt was first


def _text(spark: SparkSession, fs, path) -> str:
    with_stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_stream)).decode()
    finally:
        with_stream.close()


def committed(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all committed runs below root, with the column `run`. Which attempts count comes from the manifests (a line for each run); the
    folders of other attempts are neither listed nor read."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    full = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    if not fs.exists(path(f"{root}/manifest")):
        return spark.createDataFrame([], full)
    runs = spark.read.schema("run string, attempt string").json(f"{root}/manifest").collect()
    folders = [f"{root}/data/run={r['run']}/attempt={r['attempt']}" for r in runs]
    if not folders:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(T.StructType([*full.fields, T.StructField("attempt", T.StringType())])).option("basePath", f"{root}/data").parquet(*folders)
    return rows.select(*schema.names, "run")


# ---- a table of current rows, kept up by batches


def apply_batch(batch: DataFrame, root: str, keys: list[str], order: list[str], buckets: int = 64) -> int:
    """Bring the current table below root (one row a key, that of the highest order) up to date with a batch, and return how many of its buckets were rewritten.
    Rows are dealt to buckets by key; the batch is cut to its latest row a key, and only the buckets that it has keys of are read,
    joined with it and written again. Applying a batch twice changes nothing."""
    spark = batch.sparkSession
    newest = [F.desc(c) for c in order]
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
    new = kept(_latest(batch.select("*", place), keys, newest), "batch")
    touched = sorted(r["bucket"] for r in new.select("bucket").distinct().collect())  # at most `buckets`
    if not touched:
        return 0
    full = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])
    try:
        old = spark.read.schema(full).parquet(root).where(F.col("bucket").isin(touched))
        new = kept(_latest(old.unionByName(new), keys, newest), "merged")
    except AnalysisException:  # the first batch
        pass
    new.repartition(min(len(touched), buckets), "bucket").write.partitionBy("bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)
    return len(touched)


def _latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def current(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(root).select(*schema.names)
