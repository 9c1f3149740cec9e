"""Advice on how to show a result, from one row for each result: rows, columns, and how many of each role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds that a request may hint at, and widths by number of points.
HINTS = ("line", "bar", "pie", "scatter", "area", "table")
TABLE_WIDTHS = ((10, 12), (50, 16))
CHART_WIDTHS = ((5, 8), (12, 12), (30, 16))
WIDEST = 24
TIME_WORDS = ("year", "quarter", "month", "date", "time")


def _first(points: Column, widths) -> Column:
    return F.coalesce(*(F.when(points <= upto, width) for upto, width in widths), F.lit(WIDEST))


def chart_advice(results: DataFrame) -> DataFrame:
    """results (result, n_rows, n_columns, n_numeric, n_categorical, n_time, hint, wanted, and, if there, time_dimension: the request's) to (result,
    chart, confidence, width, height). A request with a time dimension counts as one with a time column. Sizes are of the rule that chose the chart: fixed for
    no rows, a single value, two numbers and what is wide or long; by the number of rows for the others.

    What the user wants comes first, then: no rows, a single value, a course over time, the request's hint, one category with
    numbers, two numbers, and a table for what is wide or long. Null counts stand for none."""
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_rows", "n_columns", "n_numeric", "n_categorical", "n_time")}
    numbers, words = n["n_numeric"], n["n_categorical"]
    timed = n["n_time"] > 0
    if "time_dimension" in results.columns:
        timed = timed | F.col("time_dimension").isNotNull()
    # when, chart, confidence, and the fixed size (columns, rows) of the rule
    rules = (
        (F.col("wanted").isNotNull(), F.col("wanted"), 1.0, None),
        (n["n_rows"] == 0, F.lit("table"), 0.5, (12, 6)),
        ((n["n_rows"] == 1) & (n["n_columns"] == 1), F.lit("kpi"), 0.95, (6, 4)),
        (timed & (numbers > 0), F.lit("line"), 0.9, None),
        (F.col("hint").isin(*HINTS), F.col("hint"), 0.85, None),
        ((words == 1) & (numbers > 0), F.lit("bar"), 0.85, None),
        ((words == 0) & (numbers > 1), F.lit("scatter"), 0.8, (12, 8)),
        ((n["n_columns"] > 5) | (n["n_rows"] > 100), F.lit("table"), 0.7, (16, 8)),
    )
    chosen = F.coalesce(*(F.when(when, F.struct(what.alias("chart"), F.lit(x).alias("confidence"), *(F.lit(size[i] if size else None).cast("int").alias(c) for i, c in enumerate(("width", "height"))))) for when, what, x, size in rules), F.struct(F.lit("bar").alias("chart"), F.lit(0.6).alias("confidence"), *(F.lit(None).cast("int").alias(c) for c in ("width", "height"))))
    out = results.select("result", n["n_rows"].alias("n_rows"), chosen.alias("c")).select("result", "n_rows", "c.*")
    by_rows = F.when(F.col("chart") == "kpi", 6).when(F.col("chart") == "pie", 8).when(F.col("chart") == "table", _first(F.col("n_rows"), TABLE_WIDTHS)).otherwise(_first(F.col("n_rows"), CHART_WIDTHS))
    high = F.when(F.col("chart") == "kpi", 4).when(F.col("chart") == "pie", 6).when(F.col("n_rows") <= F.when(F.col("chart") == "table", 10).otherwise(12), 6).otherwise(8)
    return out.select("result", "chart", "confidence", F.coalesce("width", by_rows).alias("width"), F.coalesce("height", high).alias("height"))


def chart_title(metrics: Column, dimensions: Column, filters: Column, chart: Column) -> Column:
    """"Metric, Metric by Dimension - Year 2024" from arrays of names and a map of filters; without any of them, "Line Chart"."""
    names = lambda a: F.initcap(F.array_join(F.coalesce(a, F.array().cast("array<string>")), ", "))
    in_time = F.filter(F.map_entries(filters), lambda e: F.lower(e["key"]).rlike("|".join(TIME_WORDS)))
    when = F.array_join(F.transform(in_time, lambda e: F.concat_ws(" ", F.initcap(e["key"]), e["value"])), ", ")
    title = F.concat(names(metrics), F.when(names(dimensions) != "", F.concat(F.lit(" by "), names(dimensions))).otherwise(""), F.when(when != "", F.concat(F.lit(" - "), when)).otherwise(""))
    return F.when(title != "", title).otherwise(F.concat(F.initcap(chart), F.lit(" Chart")))
