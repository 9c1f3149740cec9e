"""Cleaning, rules and schemas: each function is one projection or one aggregate over its input."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import columns as C

NUMERIC = (T.NumericType,)
FLOATING = (T.DoubleType, T.FloatType)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str = "string"
    nullable: bool = True
    default_value: object = None
    rules: dict = field(default_factory=dict)


@dataclass(frozen=True)
class EntitySpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    computed: dict[str, tuple[str, ...]] = field(default_factory=dict)


def to_schema(df: DataFrame, specs: tuple[ColumnSpec, ...]) -> DataFrame:
    """The declared columns in order: cast where the type differs (NULL where it fails), NULL where missing, others dropped."""
    have = {f.name: f for f in df.schema.fields}
    return df.select([(C.as_type(have[s.name], C.engine_type(s.data_type)) if s.name in have else F.lit(None).cast(C.engine_type(s.data_type))).alias(s.name) for s in specs])


def _ruled(c: Column, rules: dict) -> Column:
    if rules.get("trim"):
        c = F.trim(c)
    if rules.get("case") in ("upper", "lower"):
        c = getattr(F, rules["case"])(c)
    if rules.get("remove_special"):
        c = C.strip_special(c)
    if rules.get("no_negatives"):
        c = C.nonnegative(c)
    if "min" in rules or "max" in rules:
        c = C.clamp(c, rules.get("min"), rules.get("max"))
    if "date_format" in rules:
        c = C.parse_date(c, rules["date_format"])
    if "timestamp_format" in rules:
        c = C.parse_timestamp(c, rules["timestamp_format"])
    return c


def transform_entity(df: DataFrame, spec: EntitySpec) -> DataFrame:
    """All column rules and computed columns in one select."""
    rules = {s.name: s.rules for s in spec.columns}
    out = df.select([_ruled(F.col(c), rules.get(c, {})).alias(c) for c in df.columns])
    return out.select("*", *(C.concatenated(parts, out.columns).alias(name) for name, parts in spec.computed.items())) if spec.computed else out


def fill_defaults(df: DataFrame, specs: tuple[ColumnSpec, ...]) -> DataFrame:
    """Defaults for NULLs of columns that may hold none; timestamps and dates are left."""
    by_type = {"string": "", "int": 0, "bigint": 0, "double": 0.0, "boolean": False}
    values = {s.name: s.default_value if s.default_value is not None else by_type.get(C.engine_type(s.data_type)) for s in specs if not s.nullable and s.name in df.columns}
    values = {k: v for k, v in values.items() if v is not None}
    return df.fillna(values) if values else df


def clean_entity(df: DataFrame, spec: EntitySpec, infinite_to_null: bool = False) -> DataFrame:
    """Drop all-NULL rows, fill defaults, blank and NaN (if asked for, infinite values, too) to NULL, standard values, then drop duplicates."""
    df = fill_defaults(df.dropna(how="all"), spec.columns)
    specs = {s.name: s for s in spec.columns}

    def one(f: T.StructField) -> Column:
        c, s = F.col(f.name), specs.get(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.trim(c)
            if s is None or s.nullable:
                c = C.empty_to_null(c)
        if isinstance(f.dataType, FLOATING):
            c = C.nan_to_null(c, infinite_to_null)
        if s is not None and "standardize" in s.rules:
            c = C.standardised(c, s.rules["standardize"])
        return c.alias(f.name)

    return df.select([one(f) for f in df.schema.fields]).dropDuplicates()


def clean_and_prepare(df: DataFrame, fill: dict) -> DataFrame:
    """Trim strings and fill, then drop all-NULL rows, then drop duplicates."""
    trimmed = df.select([(F.trim(F.col(f.name)) if isinstance(f.dataType, T.StringType) else F.col(f.name)).alias(f.name) for f in df.schema.fields])
    return trimmed.fillna(fill).dropna(how="all").dropDuplicates()


def rule_filter(df: DataFrame, column: str, op: str, value=None) -> DataFrame:
    """One of the rule filters; a NULL passes no comparison, and an unknown operator passes all."""
    c = F.col(column)
    tests = {"equals": lambda: c == value, "not_equals": lambda: c != value, "greater_than": lambda: c > value, "less_than": lambda: c < value, "contains": lambda: c.contains(value), "not_null": c.isNotNull, "is_null": c.isNull}
    return df.where(tests[op]()) if op in tests else df


def replace_rule(df: DataFrame, column: str, old, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == old, F.lit(new)).otherwise(F.col(column)))


def calculate_rule(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    return df.withColumn(target, F.col(a) + F.col(b))


def apply_rules(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Filters, replacements and sums in their order; Spark folds them into one stage. A validation drops nothing: its counts are in
    rule_violations. A rule of any other type is an error."""

    def one(d: DataFrame, r: dict) -> DataFrame:
        if r["type"] == "filter":
            return rule_filter(d, r["column"], r["operator"], r.get("value"))
        if r["type"] == "replace":
            return replace_rule(d, r["column"], r["old"], r["new"])
        if r["type"] == "calculate":
            return calculate_rule(d, r["target"], r["a"], r["b"])
        if r["type"] == "validation":
            return d
        raise ValueError(f"no rule type {r['type']!r}")

    return reduce(one, rules, df)


def rule_violations(df: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule, column_name, violations): rows outside [min, max] for each validation rule, counted on the rows that reach it; the
    validations between two other rules are one scan."""
    out, done, held = None, df, []

    def counted() -> DataFrame:
        one = done.agg(*(F.count_if(_outside(r)).alias(f"v{i}") for i, r in held))
        rows = F.array(*(F.struct(F.lit(i).alias("rule"), F.lit(r["column"]).alias("column_name"), F.col(f"v{i}").alias("violations")) for i, r in held))
        return one.select(F.explode(rows).alias("r")).select("r.*")

    for i, r in [*enumerate(rules), (len(rules), {"type": "end"})]:
        if r["type"] == "validation":
            held.append((i, r))
            continue
        if held:
            out, held = counted() if out is None else out.unionByName(counted()), []
        done = done if r["type"] == "end" else apply_rules(done, [r])
    return out if out is not None else df.sparkSession.createDataFrame([], "rule int, column_name string, violations long")


def _outside(r: dict) -> Column:
    c = F.col(r["column"])
    low, high = (F.lit(False) if k not in r else c < r[k] if k == "min" else c > r[k] for k in ("min", "max"))
    return low | high


def deduplicated_counts(df: DataFrame) -> DataFrame:
    """Rows, distinct rows and removed rows of dropping duplicates, in one aggregate."""
    each = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    return each.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after")).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def range_violations(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows outside [min, max] for each column, all in one pass."""
    counts = df.agg(*(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items()))
    return counts.unpivot([], list(ranges), "column_name", "violations")


def filter_equal_ci(df: DataFrame, wanted: dict) -> DataFrame:
    """Case-insensitive equality on every key, numbers compared as text."""
    return df.where(reduce(lambda a, b: a & b, (F.lower(F.col(k).cast("string")) == F.lower(F.lit(str(v))) for k, v in wanted.items()), F.lit(True)))


def visible(scope: str, owner: str, visibility: str, user, public) -> Column:
    """What a user sees: `my` own rows, `public` ones, or both."""
    mine, open_to_all = F.col(owner) == user, F.col(visibility) == public
    return mine if scope == "my" else open_to_all if scope == "public" else mine | open_to_all


def holds(column: str, words: str) -> Column:
    """Whether a text holds the words, in any letter case; % and _ stand for themselves."""
    return F.contains(F.lower(column), F.lit(words.lower()))


def older_than(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows from more than so many days before a given time."""
    return df.where(F.col(ts) < now - F.expr(f"interval {int(days)} days"))


def union_by_name(frames: list[DataFrame], dedupe_across_files: bool = False) -> DataFrame:
    """The rows of all frames, columns told by name; with dedupe_across_files equal rows of different frames count once, too."""
    rows = reduce(lambda a, b: a.unionByName(b), frames)
    return rows.dropDuplicates() if dedupe_across_files else rows


def transformation_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows and columns that a step added or removed."""
    rows = before.agg(F.count("*").alias("rows_before")).crossJoin(after.agg(F.count("*").alias("rows_after")))  # one row by one row
    added, removed = sorted(set(after.columns) - set(before.columns)), sorted(set(before.columns) - set(after.columns))
    return rows.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"), F.lit(len(added)).alias("columns_added"), F.lit(len(removed)).alias("columns_removed"))
