"""Profiles and quality checks: one scan and one aggregate for all columns, then an unpivot of the single row."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _per_column(df: DataFrame, measures: dict, wanted=None) -> DataFrame:
    """measures: name to a function (field -> aggregate). One aggregate over df, returned as a row for each column."""
    fields = [f for f in df.schema.fields if wanted is None or wanted(f)]
    one = df.agg(F.count("*").alias("__rows"), *(F.struct(*(m(f).alias(k) for k, m in measures.items())).alias(f"__{i}") for i, f in enumerate(fields)))
    rows = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.col(f"__{i}").alias("m")) for i, f in enumerate(fields)))
    return one.select("__rows", F.explode(rows).alias("r")).select("r.column_name", "r.ordinal", F.col("__rows").alias("total"), "r.m.*")


def _nulls(f: T.StructField) -> Column:
    return F.count_if(F.col(f.name).isNull())


def _numeric(f: T.StructField) -> bool:
    return isinstance(f.dataType, T.NumericType)


def profile_columns(df: DataFrame, exact: bool = False) -> DataFrame:
    """Nulls, null share in percent, and distinct values of each column. Distinct values are estimated (one pass that shuffles sketches
    only); exact ones are made distinct in one shuffle (exact_counts)."""
    if exact:
        names = F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal")) for i, f in enumerate(df.schema.fields)))
        counts = exact_counts({"": df}).drop("table_name")
        out = df.sparkSession.range(1).select(F.inline(names)).join(counts, "ordinal", "left").na.fill(0, ["total", "null_count", "distinct_count"]).select("column_name", "ordinal", "total", "null_count", "distinct_count")
    else:
        out = _per_column(df, {"null_count": _nulls, "distinct_count": lambda f: F.approx_count_distinct(F.col(f.name))})
    return out.withColumn("null_pct", F.round(F.when(F.col("total") > 0, F.col("null_count") * 100.0 / F.col("total")).otherwise(0.0), 2))


def _long(df: DataFrame, table: str = "") -> DataFrame:
    """(table_name, ordinal, value): every value of every column as text that is equal for equal values only, NULLs included."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (c + F.lit(0.0)).cast("string")  # -0.0 is 0.0
        if isinstance(f.dataType, T.BinaryType):
            return F.hex(c)
        return c.cast("string") if isinstance(f.dataType, T.AtomicType) else F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))

    each = F.array(*(F.struct(F.lit(i).alias("ordinal"), text(f).alias("value")) for i, f in enumerate(df.schema.fields)))
    return df.select(F.lit(table).alias("table_name"), F.inline(each))


def exact_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, total, null_count, distinct_count) of all columns of all tables, exact. The values of all columns are made distinct in one
    shuffle, by (table, column, value) and after each task has done so for its own; what is left to add up is a row for each column and partition. A value
    that a third of all rows share is one row from each task."""
    long = reduce(DataFrame.unionByName, [_long(df, name) for name, df in tables.items()])
    once = long.groupBy("table_name", "ordinal", "value").agg(F.count("*").alias("n"))
    return once.groupBy("table_name", "ordinal").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"), F.count("value").alias("distinct_count"))


# ---- profiles that are kept for each file and united


def _sketched(df: DataFrame) -> list[Column]:
    """Of each column: rows, NULLs, blanks, and a sketch of its distinct values."""
    hashed = lambda f: F.when(F.col(f.name).isNotNull(), F.xxhash64(F.col(f.name)))
    blank = lambda f: F.count_if(F.trim(F.col(f.name)) == "") if isinstance(f.dataType, T.StringType) else F.count_if(F.lit(False))
    return [F.struct(F.lit(f.name).alias("column_name"), F.lit(i).alias("ordinal"), F.count("*").alias("total"), _nulls(f).alias("null_count"), blank(f).alias("blank_count"), F.hll_sketch_agg(hashed(f), F.lit(SKETCH)).alias("sketch")) for i, f in enumerate(df.schema.fields)]


#: Log2 of the buckets of a sketch: a standard error of about 1.6 %, and at most 2 KB a column and file.
SKETCH = 12
_KEPT = "path string, length long, modified timestamp, column_name string, ordinal int, total long, null_count long, blank_count long, sketch binary"


def file_profiles(df: DataFrame) -> DataFrame:
    """A row for each file that df is read from and each column: rows, NULLs, blanks, sketch. One pass; tasks shuffle sketches only."""
    m = F.col("_metadata")
    by_file = df.select("*", m["file_path"].alias("__path"), m["file_size"].alias("__length"), m["file_modification_time"].alias("__modified"))
    one = by_file.groupBy("__path", "__length", "__modified").agg(F.array(*_sketched(df)).alias("each"))
    return one.select(F.url_decode(F.replace("__path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("__length").alias("length"), F.col("__modified").alias("modified"), F.inline("each"))


def united_profile(kept: DataFrame) -> DataFrame:
    """Rows of file_profiles to a row for each column of all files: sums, and the estimate of the united sketches."""
    out = kept.groupBy("column_name", "ordinal").agg(F.sum("total").alias("total"), F.sum("null_count").alias("null_count"), F.sum("blank_count").alias("blank_count"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))
    share = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(0.0), 2)
    return out.withColumns({"null_pct": share("null_count"), "blank_pct": share("blank_count")})


def refresh_profile(spark: SparkSession, path: str, schema: T.StructType, store: str, folders: bool = False) -> tuple[DataFrame, int]:
    """The profile of the Parquet files below path, and how many of them (or, with folders, in how many folders) were read for it: those that the store
    (a folder of earlier profiles, made by the first call) doesn't have, or has of another size or time. Files that are gone no longer count. Only the
    listing and the names of new files come to the driver. A call that fails has added nothing."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    same = F.regexp_replace("path", "^file:/+", "file:/")
    listing = listing.withColumn("key", same)
    try:
        kept = spark.read.schema(_KEPT).parquet(store)
        known = kept.select(same.alias("key"), "length", "modified").distinct()
        new = listing.join(known, ["key", "length", "modified"], "left_anti")
    except AnalysisException:
        new = listing
    paths = [r["path"] for r in new.select("path").collect()]
    if paths:
        file_profiles(spark.read.schema(schema).parquet(*paths)).write.mode("append").parquet(store)
    kept = spark.read.schema(_KEPT).parquet(store).withColumn("key", same)
    now = kept.join(listing.select("key", "length", "modified"), ["key", "length", "modified"], "left_semi")
    return united_profile(now), len({p.rsplit("/", 1)[0] for p in paths}) if folders else len(paths)


def profile_numeric(df: DataFrame) -> DataFrame:
    measures = {"min_value": lambda f: F.min(F.col(f.name).cast("double")), "max_value": lambda f: F.max(F.col(f.name).cast("double")), "mean_value": lambda f: F.avg(F.col(f.name).cast("double"))}
    return _per_column(df, measures, _numeric)


def quality_stats(df: DataFrame, exact: bool = False) -> DataFrame:
    blank = lambda f: F.count_if(F.trim(F.col(f.name)) == "") if isinstance(f.dataType, T.StringType) else F.lit(0).cast("long") + F.count_if(F.lit(False))
    out = _per_column(df, {"null_count": _nulls, "blank_count": blank, "unique_count": lambda f: F.approx_count_distinct(F.col(f.name))})
    if exact:
        counts = profile_columns(df, exact=True).select("ordinal", F.col("distinct_count").alias("unique_count"))
        out = out.drop("unique_count").join(counts, "ordinal").select("column_name", "ordinal", "total", "null_count", "blank_count", "unique_count")
    share = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) * 100.0 / F.col("total")).otherwise(0.0), 2)
    return out.withColumns({"null_pct": share("null_count"), "blank_pct": share("blank_count")})


def quality_verdict(df: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """Each column's verdict and why: over 90 % NULL, missing though declared, or an empty frame is an error; over 50 % NULL, over 95 %
    blank, or not declared a warning. A missing column has no shares."""
    s = quality_stats(df)
    extra = ~F.col("column_name").isin(*declared) if declared is not None else F.lit(False)
    why = F.coalesce(F.when(F.col("total") == 0, "empty"), F.when(F.col("null_pct") > 90, "null"), F.when(F.col("null_pct") > 50, "null"), F.when(F.col("blank_pct") > 95, "blank"), F.when(extra, "extra"))
    bad = (F.col("total") == 0) | (F.col("null_pct") > 90)
    out = s.select("column_name", "null_pct", F.when(bad, "error").when(why.isNotNull(), "warning").otherwise("ok").alias("verdict"), F.coalesce(why, F.lit("")).alias("reason"))
    missing = [c for c in declared or [] if c not in df.columns]
    if not missing:
        return out
    rows = df.sparkSession.createDataFrame([(c, None, "error", "missing") for c in missing], out.schema)
    return out.unionByName(rows)


def constraint_violations(df: DataFrame, required: list[str]) -> DataFrame:
    out = _per_column(df.select(required), {"violations": _nulls})
    return out.select("column_name", "violations", (F.col("violations") == 0).alias("is_valid"))


_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Tokens that make a column boolean, words in a name that make it an identifier, and the date formats tried.
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "y", "n", "t", "f", "0", "1")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy")


def infer_types(df: DataFrame) -> DataFrame:
    """Inferred type of each column: by Spark type first, strings by what all their values parse as."""

    def kind(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.BooleanType):
            return F.max(F.lit("boolean"))
        if isinstance(f.dataType, (T.TimestampType, T.DateType, T.TimestampNTZType)):
            return F.max(F.lit("datetime"))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            return F.max(F.lit("float"))
        if isinstance(f.dataType, T.NumericType):
            return F.max(F.lit("integer"))
        c = F.col(f.name).cast("string")
        value = F.when(c.rlike(_NUMBER), c.try_cast("double"))
        known = F.count(c)
        date = F.coalesce(*(F.try_to_timestamp(c, F.lit(x)) for x in DATE_FORMATS))
        named = "identifier" if "id" in f.name.lower() else "string"
        return (
            F.when(known == 0, "unknown")
            .when(F.count(value) == known, F.when(F.count_if(value == F.floor(value)) == known, "integer").otherwise("float"))
            .when(F.count(date) == known, "datetime")
            .when(F.count_if(F.lower(c).isin(*BOOLEAN_TOKENS)) == known, "boolean")
            .otherwise(named)
        )

    return _per_column(df, {"inferred_type": kind}).select("column_name", "inferred_type")


#: Rows, first by the order, in which samples are looked for before a column's own first values are.
FIRST_ROWS = 1000


def column_samples(df: DataFrame, columns: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The first n non-null values of each column by the given order, as text. Rows that the order leaves equal are told apart by their other columns,
    so that all values come from the same rows, however df is dealt. Every task keeps its first rows only (orderBy().limit()): the first FIRST_ROWS
    serve all columns but those with fewer than n values in them, which have a pass of their own. Counts those values at once."""
    order = [*order, *(f.name for f in df.schema.fields if f.name not in order and isinstance(f.dataType, T.AtomicType))]
    head = df.orderBy(*order).limit(max(FIRST_ROWS, n))
    counts = head.agg(F.count("*"), *(F.count(c) for c in columns)).first()
    some = [c for c, k in zip(columns, counts[1:], strict=True) if k >= n or counts[0] < FIRST_ROWS]
    keys = [F.col(c).alias(f"__{i}") for i, c in enumerate(order)]

    def values(rows: DataFrame, of: list[str]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in of))
        return rows.select(*keys, F.inline(each)).where("value is not null")

    long = [values(head, some)] if some else []
    long += [values(df.where(F.col(c).isNotNull()).orderBy(*order).limit(n), [c]) for c in columns if c not in some]
    w = Window.partitionBy("column_name").orderBy(*(f"__{i}" for i in range(len(order))))
    return reduce(DataFrame.unionByName, long).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("column_name", "rank", "value")


def profile_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        out = one if out is None else out.unionByName(one)
    return out


def column_catalog(tables: dict[str, DataFrame], exact: bool = False, comments: bool = False) -> DataFrame:
    """One row for each column of each table with its type, ordinal and profile: one scan of each table, and exact distinct counts of all tables
    in one shuffle (exact_counts). Write it once where more than one operator works on it. With comments, also whether the schema lets the column be NULL, and its comment."""
    out, counts = None, exact_counts(tables) if exact else None
    for name, df in tables.items():
        if exact:
            facts = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.lit(f.nullable).alias("nullable"), F.lit(f.metadata.get("comment", "")).alias("comment")) for i, f in enumerate(df.schema.fields)))
            one = df.sparkSession.range(1).select(F.lit(name).alias("table_name"), F.inline(facts))
            out = one if out is None else out.unionByName(one)
            continue
        fields = F.create_map(*(x for f in df.schema.fields for x in (F.lit(f.name), F.struct(F.lit(f.dataType.simpleString()).alias("t"), F.lit(f.nullable).alias("n"), F.lit(f.metadata.get("comment", "")).alias("c")))))
        of = fields[F.col("column_name")]
        more = [of["n"].alias("nullable"), of["c"].alias("comment")] if comments else []
        one = profile_columns(df, exact).select(F.lit(name).alias("table_name"), "column_name", "ordinal", of["t"].alias("data_type"), "total", "null_count", "distinct_count", *more)
        out = one if out is None else out.unionByName(one)
    if not exact:
        return out
    # a table without rows has no counts
    full = out.join(counts, ["table_name", "ordinal"], "left").na.fill(0, ["total", "null_count", "distinct_count"])
    return full.select("table_name", "column_name", "ordinal", "data_type", "total", "null_count", "distinct_count", *(["nullable", "comment"] if comments else []))


def total_profile(tables: DataFrame) -> DataFrame:
    """profile_tables's rows (table_name, row_count, column_count) and a last one, named `total`, that sums them."""
    total = tables.agg(F.lit("total").alias("table_name"), F.sum("row_count").alias("row_count"), F.sum("column_count").cast("int").alias("column_count"))
    return tables.unionByName(total)
