"""Profiles that are kept and united, probes and digests of files, appends that may be run again, current tables, and state that ends."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import charts as H
from millrace.operators import clean as K
from millrace.operators import metadata as M
from millrace.operators import profile as P
from millrace.operators import relate as R
from millrace.operators import reports as O
from millrace.sources import files as S
from millrace.sources import probes as B
from millrace.sources import sinks as W
from millrace.streaming import runs as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- profiles


def test_exact_counts_of_awkward_values(spark):
    rows = [(0.0, "a", bytearray(b"\xff"), [1], datetime(2024, 1, 1)), (-0.0, "a ", bytearray(b"\xfe"), [1], None), (float("nan"), "", None, None, None), (float("nan"), None, None, [2, 3], datetime(2024, 1, 1))]
    df = spark.createDataFrame(rows, "x double, s string, b binary, l array<int>, t timestamp")
    got = {(r.ordinal): (r.total, r.null_count, r.distinct_count) for r in P.exact_counts({"t": df}).collect()}
    assert got == {0: (4, 0, 2), 1: (4, 1, 3), 2: (4, 2, 2), 3: (4, 1, 2), 4: (4, 2, 1)}
    empty = P.profile_columns(df.where("false"), exact=True).collect()
    assert [(r.column_name, r.total, r.null_count, r.distinct_count, r.null_pct) for r in empty] == [(c, 0, 0, 0, 0.0) for c in df.columns]


def test_exact_catalog_is_two_exchanges_and_no_expand(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("c"))
    catalog = P.column_catalog({"a": df, "b": df.withColumn("z", F.col("id") + 1)}, exact=True)
    assert {(r.table_name, r.column_name): r.distinct_count for r in catalog.collect()} == {("a", "id"): 1000, ("a", "k"): 7, ("a", "c"): 1, ("b", "id"): 1000, ("b", "k"): 7, ("b", "c"): 1, ("b", "z"): 1000}
    plan = plan_of(P.exact_counts({"a": df, "b": df}))
    assert "Expand" not in plan and plan.count("Exchange") == 2


def test_profiles_are_kept_for_each_file(spark, tmp_path):
    path, store = str(tmp_path / "data"), str(tmp_path / "store")
    df = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("s"))
    schema = df(0, 1).schema
    told = lambda p: {r.column_name: (r.total, r.null_count, r.distinct_count) for r in p.collect()}
    path = str(tmp_path / "data a%23+b")
    df(0, 100).coalesce(1).write.mode("append").parquet(path)
    profile, n = P.refresh_profile(spark, path, schema, store)
    assert n == 1 and told(profile) == {"id": (100, 0, 100), "s": (100, 25, 75)}
    assert P.refresh_profile(spark, path, schema, store)[1] == 0
    df(50, 150).coalesce(1).write.mode("append").parquet(path)
    profile, n = P.refresh_profile(spark, path, schema, store)
    got = told(profile)
    assert n == 1 and got["id"][:2] == (200, 0) and abs(got["id"][2] - 150) <= 3 and got["s"][:2] == (200, 50)
    next(tmp_path.glob("data*/*.parquet")).unlink()  # a file that is gone no longer counts
    profile, n = P.refresh_profile(spark, path, schema, store)
    assert n == 0 and told(profile)["id"][0] == 100


# ---- files


def test_probes_read_heads(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x,d,at,ok,none\n" + "1,é,1.5,2024-01-31,2024-01-31 10:00:00,true,\n2,\"b,c\",2,2024-02-01,2024-02-01T10:00:00Z,False,\n" * 9000)
    (tmp_path / "b.json").write_text('{"a": 1, "b": "x"}\n{"a": 1.5, "c": [1], "d": {"e": 1}, "f": true}\n')
    (tmp_path / "c.json").write_text('[{"a": 1},\n {"a": 2, "b": null}]')
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "bad.json").write_text('{"a": ')
    (tmp_path / "bad.parquet").write_text("no table")
    (tmp_path / "latin.csv").write_bytes(b"a,b\n\xff,\xe9\n")
    (tmp_path / "x.xlsx").write_text("")
    spark.range(3).select("id", F.current_timestamp().alias("t"), F.array("id").alias("l")).coalesce(1).write.parquet(str(tmp_path / "p"))
    files = S.inventory(spark, str(tmp_path)).where("extension != 'crc' and file_name != '_SUCCESS'")
    got = {r.file_name: ([tuple(c) for c in r.columns], r.readable_columns, r.error is not None) for r in B.probed(files).collect()}
    assert got["a.csv"] == ([("id", "bigint"), ("name", "string"), ("x", "double"), ("d", "date"), ("at", "timestamp"), ("ok", "boolean"), ("none", "string")], 7, False)
    assert got["b.json"][0] == [("a", "double"), ("b", "string"), ("c", "array"), ("d", "struct"), ("f", "boolean")]
    assert got["c.json"][0] == [("a", "bigint"), ("b", "string")]
    assert got["empty.csv"] == ([], 0, False)
    assert all(got[x] == ([], 0, True) for x in ("bad.json", "bad.parquet", "latin.csv", "x.xlsx"))
    parquet = next(v for k, v in got.items() if k.startswith("part-"))
    assert [c[0] for c in parquet[0]] == ["id", "t", "l"] and parquet[0][0][1] == "bigint" and parquet[0][2][1] == "array<bigint>"
    checked = {r.file_name: r.valid for r in S.file_checks(B.probed(files)).collect()}
    assert checked["a.csv"] and not checked["bad.parquet"] and not checked["empty.csv"]


def test_digests_go_through_a_buffer(spark, tmp_path):
    content = b"0123456789abcdef" * (3 * B.BUFFER // 16) + b"end"
    (tmp_path / "large name.bin").write_bytes(content)
    (tmp_path / "p=a%2311").mkdir()
    (tmp_path / "p=a%2311" / "x#y").write_bytes(b"odd")
    (tmp_path / "none").write_bytes(b"")
    files = S.inventory(spark, str(tmp_path)).select("path").union(spark.createDataFrame([(str(tmp_path / "gone"),)], "path string"))
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in B.file_digests(files).collect()}
    large = got["large name.bin"]
    assert (large.bytes, large.md5, large.sha1, large.sha256) == (len(content), *(hashlib.new(x, content).hexdigest() for x in ("md5", "sha1", "sha256")))
    assert got["x#y"].md5 == hashlib.md5(b"odd").hexdigest() and len(got) == 4
    assert got["none"].md5 == hashlib.md5(b"").hexdigest() and got["gone"].error and got["gone"].md5 is None


# ---- appends and current tables


def test_runs_count_once(spark, tmp_path):
    root, df = str(tmp_path / "t"), spark.range(10).withColumn("x", F.lit("a"))
    assert W.committed(spark, root, df.schema).count() == 0
    assert W.append_run(df, root, "r1") == W.append_run(df.limit(3), root, "r1") == 10
    broken = df.select("id", F.when(F.col("id") < 9, "a").otherwise(F.raise_error(F.lit("no"))).alias("x"))
    with pytest.raises(Exception, match="no"):
        W.append_run(broken, root, "r2")
    assert W.committed(spark, root, df.schema).groupBy("run").count().collect() == [("r1", 10)]
    assert W.append_run(df, root, "r2") == 10 and W.append_run(df.where("false"), root, "r3") == 0
    assert W.committed(spark, root, df.schema).count() == 20
    # files of an attempt without a manifest are not read
    df.write.parquet(f"{root}/data/run=r9/attempt=lost")
    assert W.committed(spark, root, df.schema).count() == 20
    assert {json.loads(p.read_text())["run"] for p in (tmp_path / "t" / "manifest").glob("*.json")} == {"r1", "r2", "r3"}


def test_current_table_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "now")
    batch = lambda rows: spark.createDataFrame(rows, "k long, t long, v string")
    W.apply_batch(batch([(k, 1, "a") for k in range(200)]), root, ["k"], ["t"], 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "now").rglob("*.parquet")}
    assert W.apply_batch(batch([(5, 3, "new"), (5, 2, "older"), (6, 0, "late"), (None, 1, "null"), (999, 1, "b")]), root, ["k"], ["t"], 16) <= 4
    rows = {r.k: (r.t, r.v) for r in W.current(spark, root, batch([]).schema).collect()}
    assert len(rows) == 202 and rows[5] == (3, "new") and rows[6] == (1, "a") and rows[None] == (1, "null") and rows[999] == (1, "b")
    kept = {p for p in before if p.exists() and p.stat().st_mtime_ns == before[p]}
    assert len(kept) >= 12
    assert W.apply_batch(batch([]), root, ["k"], ["t"], 16) == 0


# ---- streams


EVENTS = "run string, stage string, ts timestamp, status string, n long"


def test_state_of_ended_runs_is_dropped(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(f"r{d}", s, day + timedelta(days=d, hours=h), v, 10 * d + h) for d in range(12) for h, s, v in ((0, "load", "started"), (1, "load", "completed"), (2, "end", "finished"))]
    rows += [("open", "load", day, "started", 1), ("r1", "load", day + timedelta(days=9), "again", 900), ("r1", None, day + timedelta(days=9), "x", 901), (None, "load", day, "x", 5)]
    path = str(tmp_path / "in")
    for d in range(0, 12, 3):
        part = [r for r in rows if day + timedelta(days=d) <= r[2] < day + timedelta(days=d + 3)]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
    held = T.stream_run_states(spark, path, spark.createDataFrame([], EVENTS).schema, "run", "stage", "ts", "status", "n", ("end",), str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour", 3_600_000, 1)
    newest = {(r.run, r.stage): r.value for r in T.newest_of(spark, str(tmp_path / "out"), "run").collect()}
    want = {}
    for run, stage, ts, status, n in sorted((r for r in rows if r[0]), key=lambda r: (r[2], r[4])):
        want[run, stage or ""] = status
    assert newest == want
    assert held[-1] < max(held) and held[-1] < len(want)


def test_a_file_delivered_twice_adds_nothing(spark, tmp_path):
    path, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [("a", "x", datetime(2024, 1, 1, 5), "s", k) for k in range(20)] + [("a", "x", datetime(2024, 3, 1), "s", 99)]
    df = spark.createDataFrame(rows, EVENTS)
    for part in (df, df, df.withColumn("n", F.col("n") + 10)):
        part.coalesce(1).write.mode("append").parquet(path)
        T.stream_files(spark, path, df.schema, lambda d: d.select("n"), out, cp, ("n",), "ts", "365 days")
    got = sorted(r.n for r in spark.read.schema("n long").parquet(out).collect())
    assert got == [*range(30), 99, 109]
    assert K.union_by_name([df, df], dedupe_across_files=True).count() == len(rows)


# ---- reports, rules and charts


def test_previews_of_a_hot_parent(spark):
    child = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("p"), (-F.col("id")).alias("o"))
    parent = spark.createDataFrame([(0,), (1,), (3,), (-1,)], "p long")
    listed = O.nested_listing(parent, child, "p", "p", ["o"], {"o": F.col("o")}, first=2)
    assert "WindowGroupLimit" in plan_of(listed)
    assert {r.p: (r.children, [x.o for x in r.preview]) for r in listed.collect()} == {0: (10_000, [-29997, -29994]), 1: (1, [-1]), 3: (0, []), -1: (0, [])}


@pytest.mark.parametrize("n,m,a,b,want", [(9, 3, False, True, "many_to_one"), (3, 9, True, False, "one_to_many"), (5, 5, True, True, "many_to_many"), (5, 5, True, False, "one_to_many"), (5, 5, False, True, "many_to_one"), (0, 9, False, True, "many_to_one"), (9, 0, False, False, "many_to_many"), (6, 3, False, False, "many_to_many")])
def test_relation_types(spark, n, m, a, b, want):
    c = M.relation_type(F.lit(n), F.lit(m), F.lit(a), F.lit(b))
    assert spark.range(1).select(c.alias("v")).first()["v"] == want
    if n and m:
        # shared columns of two tables are told by the same rule
        row = lambda t, k, u: (t, "code", 0, "string", k if u else k + 1, 0, k)
        catalog = spark.createDataFrame([row("a", n, a), row("b", m, b)], "table_name string, column_name string, ordinal int, data_type string, total long, null_count long, distinct_count long")
        assert R.common_columns(catalog).first()["relation"] == want


def test_chart_sizes(spark):
    # result, rows, columns, numeric, categorical, time, hint, wanted, time dimension, then chart, width, height
    rows = [("wide", 9, 6, 2, 4, 0, None, None, None, "table", 16, 8), ("long", 101, 3, 0, 3, 0, None, None, None, "table", 16, 8), ("two", 3, 2, 2, 0, 0, None, None, None, "scatter", 12, 8), ("none", 0, 2, 1, 1, 0, None, None, None, "table", 12, 6), ("one", 1, 1, 1, 0, 0, None, None, None, "kpi", 6, 4),
            ("timed", 12, 2, 1, 1, 0, "pie", None, "month", "line", 12, 6), ("hint", 60, 2, 1, 1, 0, "table", None, None, "table", 24, 8), ("own", 11, 2, 1, 1, 0, None, "table", None, "table", 16, 8), ("bar", 31, 2, 1, 1, 0, None, None, None, "bar", 24, 8), ("few", 5, 2, 1, 1, 0, None, None, None, "bar", 8, 6), ("thirty", 30, 2, 1, 1, 0, None, None, None, "bar", 16, 8)]
    df = spark.createDataFrame([r[:9] for r in rows], "result string, n_rows long, n_columns long, n_numeric long, n_categorical long, n_time long, hint string, wanted string, time_dimension string")
    assert {r.result: (r.chart, r.width, r.height) for r in H.chart_advice(df).collect()} == {r[0]: r[9:] for r in rows}


def test_archive_manifest_is_undone(spark):
    files = spark.createDataFrame([("j_1", "r", "jobs/j_1/a.csv"), ("j_1", "r", "jobs/j_1/in/b.csv"), ("k", "r2", "jobs/k/a.csv")], "job string, run string, path string")
    back = O.restore_manifest(O.archive_manifest(files, "job", "run", "path").select("archive_path"), "archive_path")
    assert sorted((r.job, r.run, r.path) for r in back.collect()) == sorted(tuple(r) for r in files.collect())


def test_stored_jobs_come_newest_first(spark):
    df = spark.createDataFrame([("a", "1", 5), ("a", "2", 9), ("b", "1", 9), ("c", "1", 1), ("a", "1", 7)], "job string, run string, at long")
    assert [(r.job, r.run, r.records, r.latest) for r in O.stored_jobs(df, "job", "run", "at").collect()] == [("a", "2", 1, 9), ("b", "1", 1, 9), ("a", "1", 2, 7), ("c", "1", 1, 1)]
