"""A structured request (metrics, dimensions, filters, aggregations) as one DataFrame plan."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.clean import filter_equal_ci
from millrace.operators.relate import capped

AGGREGATES = {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count}


@dataclass(frozen=True)
class Relation:
    """A dimension table and the keys that lead to it."""

    table: DataFrame
    foreign_key: str
    key: str


@dataclass(frozen=True)
class Intent:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    filters: dict = field(default_factory=dict)
    aggregations: dict[str, str] = field(default_factory=dict)
    order_by: str | None = None
    limit: int = 10_000
    #: Whether a column `truncated` says if there were more rows than the limit. Without it rows are cut silently.
    flag: bool = True


def join_relation(fact: DataFrame, r: Relation) -> DataFrame:
    """Facts with the columns of a dimension that a relationship leads to; Spark picks the kind of join."""
    return fact.join(r.table, fact[r.foreign_key] == r.table[r.key])


def run_intent(fact: DataFrame, intent: Intent, relations: tuple[Relation, ...] = ()) -> DataFrame:
    """Join only what the request needs, filter, group and cap. A metric that no table has counts rows."""
    needed = {*intent.metrics, *intent.dimensions, *intent.filters}

    def needs(at: int) -> bool:
        # a relation is taken if it has a wanted column, or leads to one that is taken
        r = relations[at]
        return bool(needed & set(r.table.columns)) or any(x.foreign_key in r.table.columns and needs(at + 1 + k) for k, x in enumerate(relations[at + 1 :]))

    df = fact
    for i, r in enumerate(relations):
        if needs(i):
            df = join_relation(df, r)
    df = filter_equal_ci(df, intent.filters)
    measures = [(AGGREGATES[intent.aggregations.get(m, "SUM").upper()](m) if m in df.columns else F.count("*")).alias(m) for m in intent.metrics]
    out = df.groupBy(*intent.dimensions).agg(*measures) if intent.dimensions else df.agg(*measures)
    if intent.order_by:
        out = out.orderBy(F.desc(intent.order_by), *intent.dimensions)
    return capped(out, intent.limit) if intent.flag else out.limit(intent.limit)


#: What the parsed plan of a query begins with.
_QUERY_NODES = {"Aggregate", "Distinct", "Except", "Filter", "GlobalLimit", "Intersect", "Join", "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Project", "ResolvedInlineTable", "Sort", "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedWith", "Window", "WithWindowDefinition"}


def read_only(spark: SparkSession, sql: str) -> bool:
    """Whether Spark's parser reads the text as a query, not as a command, an insert or a script. Words in literals and names don't matter."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return False
    return plan.getClass().getSimpleName() in _QUERY_NODES and not re.search(r"(?m)^[\s:+|'-]*Insert\w+ ", plan.toString())


def pass_through(spark: SparkSession, sql: str, tables: dict[str, DataFrame], cap: int = 10_000, flag: bool = True) -> DataFrame:
    """The query's rows up to the cap, and in a column `truncated` whether there were more; without the flag they are cut silently."""
    if not read_only(spark, re.sub(r"\{(\w+)\}", r"\1", sql)):
        raise ValueError("only SELECT statements are run")
    rows = spark.sql(sql, **tables)
    return capped(rows, cap) if flag else rows.limit(cap)


def refresh_saved(spark: SparkSession, saved: dict[str, str], tables: dict[str, DataFrame], cap: int = 1000) -> DataFrame:
    """Rows that each saved query now gives, up to the cap, whether there were more (`truncated`), the seconds it took, or that it failed and
    with which error; a failure leaves the others alone. Loops over the saved queries only; each is a Spark job of which a count comes back."""
    log = []
    for name, sql in saved.items():
        began = time.perf_counter()
        try:
            n = pass_through(spark, sql, tables, cap + 1, flag=False).count()
            log.append((name, "success", min(n, cap), n > cap, time.perf_counter() - began, None))
        except Exception as e:  # whatever a stored query may raise is its entry in the log
            log.append((name, "error", 0, False, time.perf_counter() - began, str(e).split("\n")[0][:200]))
    return spark.createDataFrame(log, "query_name string, status string, n_rows long, truncated boolean, seconds double, error string")


# The codes of a result's outcome.
NO_DATA, HAS_DATA = "NO_DATA", "OK"


def outcome(df: DataFrame) -> DataFrame:
    """One row on a result: its rows, and a code that tells an empty one apart from an error."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("code", F.when(F.col("n_rows") == 0, NO_DATA).otherwise(HAS_DATA))
