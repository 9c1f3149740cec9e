"""Reports over tables of files, mappings, writes and runs: each is one aggregate, or one window, over its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- files


def file_statistics(files: DataFrame, size: str = "length", supported: str = "supported") -> DataFrame:
    """One row for a table of files (file_name): how many, their bytes, how many are of supported and other formats, and the largest
    and smallest file; of equally large ones the first by name."""
    by = F.struct(F.col(size), "file_name")
    down = F.struct(-F.col(size), "file_name")
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.count_if(F.col(supported)).alias("supported"),
        F.count_if(~F.col(supported)).alias("unsupported"),
        F.min_by("file_name", down).alias("largest"),
        F.min_by("file_name", by).alias("smallest"),
    )


def statistics_by(df: DataFrame, by: str, size: str) -> DataFrame:
    """Count, total, largest and smallest size for each kind."""
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(size), 2).alias("total"), F.round(F.max(size), 4).alias("largest"), F.round(F.min(size), 4).alias("smallest"))


# Upper bounds of the ages, in days.
AGES = ((1, "<1d"), (7, "1-7d"), (30, "7-30d"))


def age_bucket(days: Column) -> Column:
    return F.coalesce(*(F.when(days < upto, name) for upto, name in AGES), F.lit(">30d"))


def age_buckets(files: DataFrame, days: Column) -> DataFrame:
    """Files of each age."""
    return files.groupBy(age_bucket(days).alias("bucket")).agg(F.count("*").alias("n"))


def ages_by(files: DataFrame, by: str, at: str, name: str) -> DataFrame:
    """For each kind its files, and the oldest and newest of them; of equally old ones the first by name, of equally new ones the last."""
    place = F.struct(at, name)
    return files.groupBy(by).agg(F.count("*").alias("n"), F.min_by(name, place).alias("oldest"), F.max_by(name, place).alias("newest"))


def run_parts(folder: Column) -> tuple[Column, Column]:
    """Job and run of an archive's folder `job_run`: split at the last underscore."""
    return F.regexp_extract(folder, "^(.+)_([^_]+)$", 1), F.regexp_extract(folder, "^(.+)_([^_]+)$", 2)


def archive_statistics(files: DataFrame, path: str, size: str) -> DataFrame:
    """Files, bytes, jobs and runs of an archive (paths `archived_jobs/job_run/file`), in one row."""
    folder = F.split_part(F.col(path), F.lit("/"), F.lit(2))
    job, run = run_parts(folder)
    return files.select(job.alias("job"), folder.alias("run"), F.col(size).alias("size")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct("job").alias("jobs"), F.count_distinct("run").alias("runs"))


def archived_jobs(folders: DataFrame, folder: str, at: str) -> DataFrame:
    """For each job its archived runs, oldest first, and their number. Folders without an underscore are no archives. Runs are first
    made distinct, so that a job's list has an entry for each run, not for each file."""
    job, run = run_parts(F.col(folder))
    runs = folders.select(job.alias("job"), run.alias("run"), F.col(at).alias("at")).where("run != ''").groupBy("job", "run").agg(F.max("at").alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "run"))), lambda x: x["run"])
    return runs.groupBy("job").agg(listed.alias("runs"), F.count("*").alias("total_runs"))


def restore_manifest(archived: DataFrame, path: str) -> DataFrame:
    """The inverse of archive_manifest, from the archive's paths alone: (job, run, archive_path, path) of each file of an archived run. Folders
    and the archive's own manifests are not restored."""
    job, run = run_parts(F.split_part(F.col(path), F.lit("/"), F.lit(2)))
    inside = F.regexp_extract(path, "^archived_jobs/[^/]+/(.+)$", 1)
    found = archived.select(job.alias("job"), run.alias("run"), F.col(path).alias("archive_path"), inside.alias("inside")).where("run != '' and inside != '' and not endswith(inside, '/') and not endswith(inside, '_manifest.json')")
    return found.select("job", "run", "archive_path", F.concat_ws("/", F.lit("jobs"), "job", "inside").alias("path"))


def files_of_jobs(manifest: DataFrame, job: str, run: str) -> DataFrame:
    """archive_manifest's rows to a row for each job and run: its files, and the first and last of them by path."""
    return manifest.groupBy(F.col(job).alias("job"), F.col(run).alias("run")).agg(F.count("*").alias("files"), F.min("archive_path").alias("first"), F.max("archive_path").alias("last"))


def archive_manifest(files: DataFrame, job: str, run: str, path: str) -> DataFrame:
    """Where each of a job's files (path `jobs/job/...`) goes in the archive: (job, run, path, archive_path)."""
    inside = F.replace(F.col(path), F.concat(F.lit("jobs/"), F.col(job).cast("string"), F.lit("/")), F.lit(""))
    return files.select(job, run, path, F.concat_ws("/", F.lit("archived_jobs"), F.concat_ws("_", job, run), inside).alias("archive_path"))


def stored_jobs(records: DataFrame, job: str, run: str, at: str) -> DataFrame:
    """Records of each job and run, and the latest of them, newest first."""
    return records.groupBy(F.col(job).alias("job"), F.col(run).alias("run")).agg(F.count("*").alias("records"), F.max(at).alias("latest")).orderBy(F.desc("latest"), "job", "run")


# ---- mappings of entities to files

# From where on a confidence is high, and medium; below the latter it is low.
HIGH, MEDIUM = 0.8, 0.5


def mapping_statistics(mappings: DataFrame) -> DataFrame:
    """(entity, confidence; null if it has no file) to one row: entities, mapped ones, their share in percent, mean confidence, and how
    many are high, medium and low."""
    c = F.col("confidence")
    mapped = F.count(c)
    return mappings.agg(
        F.count("*").alias("entities"),
        mapped.alias("mapped"),
        F.round(F.when(F.count("*") > 0, mapped * 100.0 / F.count("*")).otherwise(0.0), 2).alias("rate"),
        F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3).alias("mean"),
        F.count_if(c >= HIGH).alias("high"),
        F.count_if((c >= MEDIUM) & (c < HIGH)).alias("medium"),
        F.count_if(c < MEDIUM).alias("low"),
    )


def mapping_validation(mappings: DataFrame) -> DataFrame:
    """(entity, file, score), file null where an entity has none, to a row for each entity: files, mean confidence, and whether it is
    unmapped, of low confidence (below MEDIUM), or of several files."""
    m = mappings.groupBy("entity").agg(F.count("file").alias("files"), F.round(F.avg("score"), 4).alias("confidence"))
    return m.select("entity", "files", "confidence", (F.col("files") == 0).alias("unmapped"), F.coalesce((F.col("files") > 0) & (F.col("confidence") < MEDIUM), F.lit(False)).alias("low"), (F.col("files") > 1).alias("several"))


# ---- writes and runs


def write_statistics(writes: DataFrame) -> DataFrame:
    """(table_name, success, records, seconds, error) to one row: writes, how many succeeded and failed, share in percent, records, seconds in
    all and on average, and records a second. Records of failed writes don't count."""
    n, ok = F.count("*"), F.count_if(F.col("success"))
    records, seconds = F.coalesce(F.sum(F.when(F.col("success"), F.col("records"))), F.lit(0)), F.coalesce(F.sum("seconds"), F.lit(0.0))
    return writes.agg(
        n.alias("writes"), ok.alias("succeeded"), (n - ok).alias("failed"), F.round(F.when(n > 0, ok * 100.0 / n).otherwise(0.0), 2).alias("rate"),
        records.alias("records"), F.round(seconds, 4).alias("seconds"), F.round(F.when(n > 0, seconds / n).otherwise(0.0), 4).alias("mean_seconds"), F.round(F.when(seconds > 0, records / seconds).otherwise(0.0), 2).alias("per_second"),
    )


def write_errors(writes: DataFrame) -> DataFrame:
    """Failed writes by error: how many, and how many tables."""
    return writes.where("not success").groupBy(F.coalesce("error", F.lit("unknown")).alias("error")).agg(F.count("*").alias("failures"), F.count_distinct("table_name").alias("tables"))


def run_progress(statuses: DataFrame, run: str, status: str, stages: int) -> DataFrame:
    """(run, stage's status: failed, started, completed or none) to a row for each run: completed stages, and overall failed, running,
    completed (all of `stages`) or pending."""
    s = F.col(status)
    counted = statuses.groupBy(run).agg(F.count_if(s == "completed").alias("completed_stages"), F.count_if(s == "failed").alias("f"), F.count_if(s == "started").alias("s"))
    done = F.col("completed_stages")
    overall = F.when(F.col("f") > 0, "failed").when(F.col("s") > 0, "running").when(done >= stages, "completed").when(done > 0, "running").otherwise("pending")
    return counted.select(run, "completed_stages", overall.alias("overall"))


# ---- shapes of results


def axis_statistics(df: DataFrame, column: str) -> DataFrame:
    """Number of categories, the longest label, and whether labels should be turned (over 10 or over 15 characters) or cut (over 30)."""
    return df.agg(F.count_distinct(column).alias("categories"), F.max(F.length(column)).alias("longest")).select("*", ((F.col("categories") > 10) | (F.col("longest") > 15)).alias("rotate"), (F.col("categories") > 30).alias("truncate_labels"))


def category_label(columns: list[str]) -> Column:
    """All columns' values joined by a space; NULLs are skipped."""
    return F.concat_ws(" ", *columns)


def series(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """One row for each numeric column: its values in the order of another column, as text joined by commas. For results as small as a chart."""
    long = df.unpivot(by, columns, "series", "value")
    points = F.transform(F.array_sort(F.collect_list(F.struct(by, "value"))), lambda p: p["value"].cast("string"))
    return long.groupBy("series").agg(F.array_join(points, ",").alias("points"))


def nested_listing(parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, order: list[str], payload: dict[str, Column], first: int | None = None) -> DataFrame:
    """Each parent with the number of its children and a list of them, in order, as structs of the payload; no children are an empty list.

    With `first`, the list is a preview of so many children, beside the exact number of all: each task ranks what it has and hands on at
    most `first` children of a parent, and counts are summed in tasks first, so a parent with a third of all children is no larger
    than another. Without it the list is whole, and as long as the parent's children are many."""
    entry = F.struct(*order, F.struct(*(c.alias(n) for n, c in payload.items())).alias("entry"))
    rows = child.select(F.col(child_key).alias("__key"), entry.alias("__entry"))
    if first is None:
        lists = rows.groupBy("__key").agg(F.array_sort(F.collect_list("__entry")).alias("held"), F.count("*").alias("children"))
    else:
        ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("__entry"))).where(F.col("__n") <= first)
        counts = rows.groupBy("__key").agg(F.count("*").alias("children"))
        lists = counts.join(ranked.groupBy("__key").agg(F.array_sort(F.collect_list("__entry")).alias("held")), "__key")
    joined = parent.join(lists, parent[parent_key] == F.col("__key"), "left")
    none = F.array().cast(T.ArrayType(child.select(*(c.alias(n) for n, c in payload.items())).schema))
    return joined.select(parent["*"], F.coalesce("children", F.lit(0)).alias("children"), F.coalesce(F.transform("held", lambda x: x["entry"]), none).alias("preview"))
