"""Files in: scans, inventories and content checks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Formats that are read, and size limits in bytes.
FORMATS = ("csv", "xlsx", "xls", "parquet", "json")
LARGEST, LARGE = 100 * 1024 * 1024, 50 * 1024 * 1024


def read_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Header, quotes doubled or escaped by a quote; with a schema there is no pass to infer one."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def _named(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(file_name, path) of all files that a frame would read, empty ones included, from its listing, as they are named (a listing encodes them)."""
    return spark.createDataFrame([(unquote(p.rsplit("/", 1)[-1]), unquote(p)) for p in df.inputFiles()], "file_name string, path string")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below path; contents are not read. Empty files, which Spark's readers skip, have no modification time."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = read.select("path", "modificationTime", "length")
    # the listing writes file:/// where the reader writes file:/
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/").alias("path")
    empty = _named(spark, read).select(same("path")).join(files.select(same("path")), "path", "left_anti")
    files = files.unionByName(empty.select("path", F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(0).cast("long").alias("length")))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("file_name"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("extension"), "length", "modificationTime").withColumn("supported", F.col("extension").isin(*FORMATS))


def job_files(files: DataFrame, job: str) -> DataFrame:
    """The files of an inventory (path) below `jobs/<job>/`, of supported formats."""
    return files.where(F.col("path").contains(f"jobs/{job}/") & F.col("supported"))


def folder_bytes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files and bytes of each table's folder or file."""
    out = None
    for name, path in paths.items():
        one = inventory(spark, path).agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(F.lit(name).alias("table_name"), "files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def accessible(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """The wanted files (path) that the inventory still has, with what it knows of them now; files without a size are left out."""
    return files.where(F.col("length").isNotNull()).join(wanted.select("path").distinct(), "path", "left_semi")


def read_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows; all of them if n isn't positive."""
    return df.limit(n) if n > 0 else df


def schema_probe(df: DataFrame) -> DataFrame:
    """Ordinal, name, type and nullability of each column; no data is read."""
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string, nullable boolean")


def file_statistics(df: DataFrame) -> DataFrame:
    """Rows, columns and types of each file that a frame is read from."""
    return df.select(F.col("_metadata.file_path").alias("path")).groupBy("path").agg(F.count("*").alias("rows")).select("path", "rows", F.lit(len(df.columns)).alias("columns"), F.lit(",".join(t for _, t in df.dtypes)).alias("types"))


def checksums(text: Column) -> list[Column]:
    return [F.md5(text).alias("md5"), F.sha2(text, 256).alias("sha256"), F.sha1(text).alias("sha1")]


# Characters that make trouble in file names.
ODD_CHARACTERS = '[<>:"|?*]'


def file_checks(files: DataFrame, now: Column | None = None) -> DataFrame:
    """Errors and warnings for each row of (file_name, length): no name, no or an unsupported extension, size, odd characters. Where the
    table has them, also is_directory, last_modified (a warning if it lies after `now`) and readable_columns (of a sample; an error if
    the sample has none)."""
    name = F.coalesce(F.trim("file_name"), F.lit(""))
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    have = set(files.columns)
    errors = [F.when(name == "", "no name"), F.when(ext == "", "no extension").when(~ext.isin(*FORMATS), "unsupported extension"), F.when(F.col("length") < 1, "too small"), F.when(F.col("length") > LARGEST, "too large")]
    warnings = [F.when(F.col("length").isNull(), "no size"), F.when(F.col("length").between(LARGE + 1, LARGEST), "large file"), F.when(name.rlike(ODD_CHARACTERS), "odd characters")]
    if "is_directory" in have:
        errors.append(F.when(F.col("is_directory"), "a directory"))
    if "last_modified" in have and now is not None:
        warnings.append(F.when(F.col("last_modified") > now, "modified in the future"))
    if "readable_columns" in have:
        errors.append(F.when(F.coalesce("readable_columns", F.lit(0)) < 1, "no readable columns"))
    errors, warnings = (F.array_compact(F.array(*x)) for x in (errors, warnings))
    return files.select("*", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"))


def ingest_seconds(length: Column, extension: Column) -> Column:
    """Estimated seconds: 5 MB a second, times 0.8 for csv, 0.5 for Excel and 2 for Parquet."""
    rate = F.when(extension == "csv", 0.8).when(extension.isin("xls", "xlsx"), 0.5).when(extension == "parquet", 2.0).otherwise(1.0)
    return length / (5 * 1024 * 1024 * rate)


def valid_json(text: Column) -> Column:
    """Whether a text is a JSON document."""
    return F.try_parse_json(text).isNotNull()


def csv_shapes(spark: SparkSession, path: str) -> DataFrame:
    """For each CSV file below path its rows, whether it is empty or has a header only, how many rows have another number of fields than
    the header, and the numbers of the first five of those (the row after the header is 1). Rows are lines; fields in quotes hold no separators.

    A file's lines are numbered by their byte offset, so a file of any size can be split: only its ragged rows are ranked."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    outside = F.regexp_replace("value", r"\"(?:[^\"]|\"\")*\"", "")
    fields = lines.select("file_name", "block", "id", F.size(F.split(outside, ",")).alias("fields"))
    place = F.struct("block", "id")
    header = fields.groupBy("file_name").agg(F.min_by("fields", place).alias("wanted"), F.count("*").alias("lines"))
    before = fields.groupBy("file_name", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file_name", "block", "first", "before")
    # ids of a task's lines go up by one
    odd = fields.join(header.select("file_name", "wanted"), "file_name").where("fields != wanted").join(before, ["file_name", "block"])
    odd = odd.select("file_name", (F.col("before") + F.col("id") - F.col("first")).alias("row"))
    ranked = odd.withColumn("k", F.row_number().over(Window.partitionBy("file_name").orderBy("row"))).where("k <= 5").groupBy("file_name").agg(F.array_sort(F.collect_list("row")).alias("first_ragged"))
    counted = odd.groupBy("file_name").agg(F.count("*").alias("ragged")).join(ranked, "file_name")
    out = _named(spark, spark.read.text(path)).select("file_name").join(header, "file_name", "left").join(counted, "file_name", "left")
    rows = F.greatest(F.coalesce("lines", F.lit(0)) - 1, F.lit(0))
    return out.select("file_name", rows.alias("rows"), F.col("lines").isNull().alias("empty"), F.coalesce(F.col("lines") == 1, F.lit(False)).alias("header_only"), F.coalesce("ragged", F.lit(0)).alias("ragged"), F.coalesce("first_ragged", F.array().cast("array<bigint>")).alias("first_ragged"))
