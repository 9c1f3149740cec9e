"""Value cases of single operators."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import clean as K
from millrace.operators import profile as P
from millrace.operators import relate as R
from millrace.plans import intent as I
from millrace.sources import files as S


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize("name,want", [("User Data.csv", "user_data"), ("user-info.xlsx", "user_info"), ("PRODUCTS_TABLE", "products_table"), ("  spaced  name  ", "spaced_name"), ("special@chars#removed", "specialcharsremoved")])
def test_normalised_name(spark, name, want):
    assert one(spark, C.normalised_name(F.lit(name))) == want


@pytest.mark.parametrize("entity,file,want", [("users", "users", 1.0), ("user", "users", 0.9), ("users", "user", 0.8)])
def test_similarity_tiers(spark, entity, file, want):
    assert one(spark, R.similarity(F.lit(entity), F.lit(file))) == want


def test_similarity_of_others(spark):
    assert one(spark, R.similarity(F.lit("user_data"), F.lit("user_info"))) > 0.3
    assert abs(one(spark, R.similarity(F.lit("orders"), F.lit("users"))) - 0.545) < 0.001


@pytest.mark.parametrize("declared,want", [("VARCHAR(255)", "string"), ("decimal(12,3)", "decimal(12,3)"), (" BigInt ", "bigint"), ("float", "double"), ("blob", "string"), ("decimal", "decimal(10,2)")])
def test_types(spark, declared, want):
    assert C.engine_type(declared) == want
    assert one(spark, C.engine_type_column(F.lit(declared))) == want


def test_schema_enforced_with_nulls(spark):
    df = spark.createDataFrame([("1", "x"), ("two", None)], "a string, b string")
    out = K.to_schema(df, (K.ColumnSpec("a", "int"), K.ColumnSpec("c", "date"), K.ColumnSpec("b")))
    assert out.columns == ["a", "c", "b"]
    assert [tuple(r) for r in out.collect()] == [(1, None, "x"), (None, None, None)]


def test_clean_is_idempotent(spark):
    df = spark.createDataFrame([(1, " a ", float("nan")), (1, "a", None), (None, None, None), (2, "", 1.0)], "k long, s string, x double")
    spec = K.EntitySpec("e", (K.ColumnSpec("k", "bigint"), K.ColumnSpec("s"), K.ColumnSpec("x", "double")))
    once = K.clean_entity(df, spec)
    assert sorted(map(str, once.collect())) == sorted(map(str, K.clean_entity(once, spec).collect()))
    assert once.count() == 2


def test_age_rules(spark):
    df = spark.createDataFrame([(-5,), (30,), (150,), (None,)], "age int")
    out = K.transform_entity(df, K.EntitySpec("p", (K.ColumnSpec("age", "int", rules={"no_negatives": True, "min": 0, "max": 120}),)))
    assert [r.age for r in out.collect()] == [0, 30, 120, None]
    assert K.rule_filter(df, "age", "equals", 30).count() == 1
    assert K.rule_filter(df, "age", "no_such_rule", 1).count() == 4


def test_profile_is_one_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = P.quality_stats(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_infer_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2020-01-01", "yes", "a", None), ("2", "2", "2021-02-03", "no", "b", None)], "a string, b string, c string, d string, width string, f string")
    got = {r.column_name: r.inferred_type for r in P.infer_types(df).collect()}
    assert got == {"a": "integer", "b": "float", "c": "datetime", "d": "boolean", "width": "identifier", "f": "unknown"}


def test_read_only(spark):
    for sql in ("select updated_at from t", "select 'delete from t; drop' as x", "with a as (select 1) select * from a", "(select 1 as x) union all select 2 order by x limit 1", "from t select x", "values (1), (2)", "select a from t group by a having count(*) > 1", "select * from t limit 3 offset 1"):
        assert I.read_only(spark, sql), sql
    for sql in ("delete from t", "with a as (select 1) insert into t select * from a", "from t insert into a select x", "drop table t", "set x = 1", "create table a as select 1", "show tables", "explain select 1", "truncate table t", "merge into t using s on t.a = s.a when matched then delete", "update t set a = 1", "cache table t", "no sql", ""):
        assert not I.read_only(spark, sql), sql


def test_capped_is_one_plan(spark):
    df = spark.range(50).orderBy(F.desc("id"))
    assert [tuple(r) for r in R.capped(df, 2).collect()] == [(49, True), (48, True)]
    assert [r.truncated for r in R.capped(df, 50).collect()] == [False] * 50 and R.capped(spark.range(0), 3).count() == 0
    plan = R.capped(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0, 50") == 1
    assert I.run_intent(spark.range(9).withColumn("k", F.col("id")), I.Intent(("id",), ("k",), limit=3, flag=True)).select("truncated").distinct().first()[0]


@pytest.mark.parametrize("stage,message,want", [("Table_Setup_Failed", "ok", "failed"), ("load", "was unsuccessful", "failed"), ("load completed", "with ERROR", "failed"), ("load completed", "done", "completed"), ("success", None, "completed"), ("preparing", "x", "started"), ("anything", "completed", "started"), (None, None, "started")])
def test_status(spark, stage, message, want):
    from millrace.streaming.runs import status

    assert one(spark, status(F.lit(stage).cast("string"), F.lit(message).cast("string"))) == want


def test_stream_latest_writes_changes_only(spark, tmp_path):
    from millrace.streaming import runs

    schema = "k string, ts int, v int, e int"
    args = (["k"], "ts", "v", "e", str(tmp_path / "out"), str(tmp_path / "state"))
    for rows in ([("a", 1, 10, 1), ("b", 1, 20, 2)], [("a", 3, 30, 3), ("b", 0, 99, 4)]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        runs.stream_latest(spark, str(tmp_path / "in"), schema, *args)
    assert {r.k: r.v for r in runs.latest_of(spark, str(tmp_path / "out"), ["k"]).withColumnRenamed("value", "v").collect()} == {"a": 30, "b": 20}
    # b's row of the second run changed nothing that is newest, but update mode tells every key that had input
    assert spark.read.parquet(str(tmp_path / "out")).where("batch = 0").count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(i, 10 * i) for i in range(10)], "a int, b int")
    rules = [{"type": "validation", "column": "a", "min": 2}, {"type": "filter", "column": "a", "operator": "greater_than", "value": 4}, {"type": "validation", "column": "a", "min": 2, "max": 8}, {"type": "validation", "column": "b", "max": 50}]
    assert [tuple(r) for r in K.rule_violations(df, rules).orderBy("rule").collect()] == [(0, "a", 2), (2, "a", 1), (3, "b", 4)]
    assert K.apply_rules(df, rules).count() == 5 and K.rule_violations(df, rules[1:2]).count() == 0
    with pytest.raises(ValueError):
        K.apply_rules(df, [{"type": "odd"}])


def test_writes(spark, tmp_path):
    from millrace.sources import sinks as W

    df, name = spark.range(5).withColumn("x", F.lit("a")), "t_writes"
    with pytest.raises(ValueError):
        W.append(df, name)
    assert W.append_or_create(df, name, df.schema, str(tmp_path / "t")) == 5 and W.append(df.limit(0), name) == 0
    assert W.append(df.select("x", "id"), name) == 5 and spark.table(name).where("x = 'a'").count() == 10
    log = {r.table_name: (r.success, r.records) for r in W.write_batch({name: df, "no_such": df}).collect()}
    assert log == {name: (True, 5), "no_such": (False, 0)}
    spark.sql(f"drop table {name}")


def test_row_json(spark):
    df = spark.sql("select cast(1.50 as decimal(5,2)) as d, date'2024-01-02' as day, timestamp_ntz'2024-01-02 03:04:05.5' as at, cast(null as string) as n")
    assert df.select(C.row_json(df.schema).alias("j")).first()["j"] == '{"d":1.5,"day":"2024-01-02","at":"2024-01-02T03:04:05.500000","n":null}'


def test_name_variations_and_foreign_keys(spark):
    from millrace.operators import metadata as M

    rows = [("customers", "id", 0, "int", 10, 0, 10), ("customers", "name", 1, "string", 10, 0, 9), ("orders", "id", 0, "int", 50, 0, 50), ("orders", "customer_id", 1, "int", 50, 0, 8), ("orders", "note", 2, "string", 50, 3, 40), ("log", "text", 0, "string", 5, 0, 3)]
    c = spark.createDataFrame(rows, "table_name string, column_name string, ordinal int, data_type string, total long, null_count long, distinct_count long")
    keys = M.primary_keys(R.key_candidates(c), c)
    assert {r.table_name: (r.primary_key, r.generated) for r in keys.collect()} == {"customers": ("id", False), "orders": ("id", False), "log": ("id", True)}
    assert {(r.from_table, r.from_column, r.to_table, r.confidence) for r in M.foreign_keys(c, keys).collect()} == {("orders", "customer_id", "customers", 0.7)}
    found = {(r.from_table, r.from_column, r.to_table, r.relation) for r in M.discovered_relationships(c, keys).collect()}
    assert found == {("orders", "customer_id", "customers", "many_to_one")}  # `id` is the key of both
    assert tuple(M.discovery_metrics(c, M.discovered_relationships(c, keys)).first()) == (3, 1, 2)
    low = M.column_descriptions(c, keys).where("column_name = 'customer_id'").first()["description"]
    assert low == "Unique identifier (numeric) - Required field"


def test_match_entities_brute_force(spark):
    entities, files = ["Customers", "order-item", "user", "A B"], ["customer_data.csv", "client_info.xlsx", "Order Items 2024-01-01.csv", "users.csv", "a b_export.csv", "zq.csv"]

    def clean(x):
        import re

        x = re.sub(r"[\s\-.]+", "_", re.sub(r"\.(csv|xlsx)$", "", x.strip().lower()))
        return re.sub("_+", "_", re.sub("[^a-z0-9_]", "", x)).strip("_")

    want = {}
    for e in entities:
        low = e.lower()
        names = {low, low[:-1] if low.endswith("s") else low + "s"}
        names |= {n.replace(a, b) for n in names for a, b in (("_", " "), (" ", "_"), ("-", "_"), ("_", "-"))}
        for f in files:
            form = any(x.format(low) in f.lower() for x in R.EXPORT_FORMS)
            s = max([*(scored(clean(n), clean(f)) for n in names), 0.42 if form else 0])
            if s > 0.3:
                want[e, f] = s
    as_df = lambda xs, c: spark.createDataFrame([(x,) for x in [*xs, None]], f"{c} string")
    found = R.match_entities(as_df(entities, "entity"), as_df(files, "file"))
    assert {(r.entity, r.file): r.score for r in found.collect()} == pytest.approx(want)
    assert found.where("entity = 'Customers'").first()["file"] == "customer_data.csv"


def test_write_validation_and_ragged(spark, tmp_path):
    from millrace.sources import sinks as W

    n = lambda k: spark.range(k)
    assert W.within(n(100), n(102)).first()["valid"] and not W.within(n(100), n(110)).first()["valid"]
    (tmp_path / "a.csv").write_text('name,age\nJohn,25\nJane,30,1\n"a,b",3\nx\n')
    (tmp_path / "b.csv").write_text("name,age\n")
    (tmp_path / "c.csv").write_text("")
    shapes = {r.file_name: (r.rows, r.empty, r.header_only, r.ragged, r.first_ragged) for r in S.csv_shapes(spark, str(tmp_path)).collect()}
    assert shapes == {"a.csv": (4, False, False, 2, [2, 4]), "b.csv": (0, False, True, 0, []), "c.csv": (0, True, False, 0, [])}
    files = S.inventory(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(f.file_name, f.extension, f.length > 0, f.supported) for f in files] == [("a.csv", "csv", True, True), ("b.csv", "csv", True, True), ("c.csv", "csv", False, True)]


def test_csv_rows_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},{'x' * 50}{',y' if i % 1000 == 0 else ''}\n" for i in range(1, 6001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        shape = S.csv_shapes(spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (shape.rows, shape.ragged, shape.first_ragged) == (6000, 6, [1000, 2000, 3000, 4000, 5000])


def test_compatibility(spark):
    old = spark.createDataFrame([("id", "int", False), ("note", "string", True), ("n", "int", True)], "column_name string, data_type string, nullable boolean")
    new = spark.createDataFrame([("n", "bigint", True), ("more", "int", True)], "column_name string, data_type string, nullable boolean")
    assert {r.column_name: r.change for r in R.compatibility(old, new).collect()} == {"id": "missing_required", "note": "missing_optional", "n": "type_mismatch", "more": "extra"}


def test_chart_advice_rules(spark):
    from millrace.operators.charts import chart_advice

    rows = [("none", 0, 2, 1, 1, 0, None, None), ("one", 1, 1, 1, 0, 0, None, None), ("time", 9, 2, 1, 0, 1, "pie", None), ("hint", 9, 2, 1, 1, 0, "pie", None), ("bar", 9, 2, 1, 1, 0, "odd", None), ("two", 40, 2, 2, 0, 0, None, None), ("wide", 9, 6, 2, 4, 0, None, None), ("rest", 9, 2, 0, 2, 0, None, None), ("own", 0, 0, 0, 0, 0, None, "area"), ("null", None, None, None, None, None, None, None)]
    got = {r.result: (r.chart, r.confidence, r.width) for r in chart_advice(spark.createDataFrame(rows, "result string, n_rows long, n_columns long, n_numeric long, n_categorical long, n_time long, hint string, wanted string")).collect()}
    assert got == {"none": ("table", 0.5, 12), "one": ("kpi", 0.95, 6), "time": ("line", 0.9, 12), "hint": ("pie", 0.85, 8), "bar": ("bar", 0.85, 12), "two": ("scatter", 0.8, 12), "wide": ("table", 0.7, 16), "rest": ("bar", 0.6, 12), "own": ("area", 1.0, 8), "null": ("table", 0.5, 12)}


def test_audit_of_queries(spark):
    from millrace.operators.metadata import audit_queries

    texts = ["select * from a join b on true", "with x as (select 1), y as (select 2) select * from x join y on true", "DROP TABLE a", None, "select updated_at from A", "select 'delete from z' as t from default.a -- from q", "select count(*) from spark_catalog.other.a t group by t.k, v order by 1", "select k, v from a group by k, a.v"]
    log = spark.createDataFrame(list(enumerate(texts, 1)), "query_id long, sql string")
    got = {r.query_id: (r.read_only, r.unknown_tables, r.not_selected) for r in audit_queries(log, spark.createDataFrame([("a",)], "table_name string")).collect()}
    assert got == {1: (True, "b", ""), 2: (True, "", ""), 3: (False, "", ""), 4: (False, "", ""), 5: (True, "", ""), 6: (True, "", ""), 7: (True, "spark_catalog.other.a", "k,v"), 8: (True, "", "")}


def scored(entity, file):
    """The rule of name similarity, in plain Python."""
    import difflib

    if entity == file:
        return 1.0
    if entity in file:
        return 0.9
    if file in entity:
        return 0.8
    a, b = set(entity.split("_")), set(file.split("_"))
    return min(1.0, difflib.SequenceMatcher(None, entity, file).ratio() + 0.3 * len(a & b) / max(len(a), len(b)))


def test_name_similarity_brute_force(spark):
    import duckdb

    from millrace.plans.registry import QUERIES

    names = [r[0].replace(" ", "_") for r in duckdb.sql("select distinct p_name from '/root/testdata/sf0.001/part.parquet'").fetchall()]
    want = {(a, f"{b}_data"): round(s, 6) for a in names for b in names if (s := scored(a, f"{b}_data")) > 0.3}
    rows = QUERIES["name_similarity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want) and {(r.entity, r.file): r.score for r in rows} == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("block", [2_000, 2])
def test_name_matches_need_no_common_start(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(R, "BLOCK_NAMES", block)
    rng = random.Random(5)
    made = ["".join(rng.choices("abcdefgh_", k=rng.randint(1, 24))) for _ in range(60)]
    entities = ["old_plate", "plate_cold", "users", "users", None, "zzz", "", "q", "_x", "x" * 9, "é日本", *made[:30]]
    files = ["cold_plate_data", "users", "all_users_2020", "qqq", None, "", "y_", "abcdefghijklmnoq" * 3, "x", "日本é_data", *made[30:]]
    found = R.name_matches(spark.createDataFrame([(x,) for x in entities], "entity string"), spark.createDataFrame([(x,) for x in files], "file string"))
    got = {(r.entity, r.file): r.score for r in found.collect()}
    want = {(a, b): s for a in set(entities) - {None} for b in set(files) - {None} if (s := scored(a, b)) > 0.3}
    assert found.count() == len(want) and got == pytest.approx(want) and got["old_plate", "cold_plate_data"] == 0.9


def test_name_candidates_have_no_cross_join(spark):
    names = spark.createDataFrame([("".join(x),) for x in ("abc", "abd", "xyz", "uvw")], "entity string")
    pairs = R.name_candidates(names, names.select(F.col("entity").alias("file")))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert {(r.entity, r.file) for r in pairs.collect()} == {(a, b) for a in ("abc", "abd") for b in ("abc", "abd")} | {("xyz", "xyz"), ("uvw", "uvw")}
