"""Run events: status, rollups, and the two streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Words that tell a status, in a stage's name and in its message.
FAILED_STAGE = ("failed", "error", "exception")
FAILED_MESSAGE = ("failed", "error", "exception", "unsuccessful")
COMPLETED_STAGE = ("completed", "complete", "finished", "success")


def status(stage: Column, message: Column) -> Column:
    """failed, completed or started. A word of failure in the stage or the message means failed; else one of completion in the stage
    means completed; anything else has started. NULL texts hold no words."""
    s, m = (F.lower(F.coalesce(c, F.lit(""))) for c in (stage, message))
    failed = s.rlike("|".join(FAILED_STAGE)) | m.rlike("|".join(FAILED_MESSAGE))
    return F.when(failed, "failed").when(s.rlike("|".join(COMPLETED_STAGE)), "completed").otherwise("started")


def run_rollup(events: DataFrame, run: str, ts: str, stage: Column, message: Column) -> DataFrame:
    """One row for each run: first and last event, seconds between, counts by status, and the state: failed, success or running."""
    s = status(stage, message)
    return (
        events.groupBy(run)
        .agg(F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("events"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "completed").alias("completed"))
        .withColumn("duration_s", F.unix_timestamp("ended_at") - F.unix_timestamp("started_at"))
        .withColumn("state", F.when(F.col("failed") > 0, "failed").when(F.col("completed") > 0, "success").otherwise("running"))
    )


def latest_status(events: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """The newest value for each key; the same plan for a batch and for a stream."""
    return events.groupBy(*keys).agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.col(value).alias("value"))).alias("m")).select(*keys, F.col("m.ts").alias("ts"), F.col("m.value").alias("value"))


def stream_files(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once_by: tuple[str, ...] = (), ts: str | None = None, delay: str = "30 days") -> None:
    """Take in all Parquet files below path that were not taken in before, once, and append what transform makes of each micro-batch.
    A micro-batch that is run again overwrites its own folder, so a restart writes nothing twice.

    With once_by (columns) and ts, a row is taken once even if other files deliver it again: its keys stay in the state until the
    watermark, `delay` behind the newest ts, has passed it. Rows older than the watermark are late and dropped, so the delay must
    be longer than files may be late; rows without a ts are never late, and are taken once as long as their keys are held."""
    stream = spark.readStream.schema(schema).parquet(path)
    if once_by:
        stream = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", delay).dropDuplicatesWithinWatermark(list(once_by)).drop("__ts")

    def put(df: DataFrame, number: int) -> None:
        transform(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_latest(spark: SparkSession, path: str, schema, keys: list[str], ts: str, value: str, tie: str, out: str, checkpoint: str) -> None:
    """The newest value for each key over all files. The state holds a row for each key; a micro-batch writes only the keys that it
    changed, to a folder of its own (written over if it is run again). latest_of reads the newest of all folders."""
    stream = latest_status(spark.readStream.schema(schema).parquet(path), keys, ts, value, tie)

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_of(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """What stream_latest has written: for each key the row of the last micro-batch that changed it."""
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("m")).select(*keys, "m.*")


# ---- state that ends

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _tie(x: int | None) -> tuple:
    return x is not None, x or 0  # as Spark orders NULLs


class _Runs(StatefulProcessor):
    """Of one run: the newest value of each stage, in one row of the state, until a timer that the run's end sets. Calls of the state are what a run costs,
    so a batch reads and writes a run's row once, and a timer that rings before the run is old enough is set again only then."""

    def __init__(self, key: str, value_type: str, ended: tuple[str, ...], grace_ms: int):
        self.key, self.value_type, self.ended, self.grace_ms = key, value_type, ended, grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", f"stages array<struct<stage:string,at:bigint,tie:bigint,value:{self.value_type}>>, due bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict = {}
        for r in rows:
            held = new.get(r.stage)
            if held is None or (r.at, _tie(r.tie)) > (held[1], _tie(held[2])):
                new[r.stage] = (r.stage, r.at, r.tie, r.value)
        stages, due = self.run.get() or ((), None)
        kept = {x[0]: tuple(x) for x in stages}
        changed = [x for s, x in new.items() if s not in kept or (x[1], _tie(x[2])) > (kept[s][1], _tie(kept[s][2]))]
        if due is not None or any(s in new for s in self.ended):
            # a run that goes on after its end is held until its newest event is old enough
            late = max(x[1] for x in new.values()) // 1000 + self.grace_ms
            if due is None:
                self.handle.registerTimer(late)
            due = max(late, due or 0)
        self.run.update(([*(kept | {x[0]: x for x in changed}).values()], due))
        names = (self.key, "stage", "at", "tie", "value")
        for x in changed:
            yield Row(**dict(zip(names, (key[0], *x), strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        stages, due = self.run.get()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_run_states(spark: SparkSession, path: str, schema, key: str, stage: str, ts: str, value: str, tie: str, ended: tuple[str, ...], out: str, checkpoint: str, delay: str = "1 day", grace_ms: int = 86_400_000, files: int | None = None) -> list[int]:
    """The newest value for each run (key) and stage over all files, with a state in RocksDB that ends: a run with an event of one of the `ended` stages is
    dropped once the watermark is grace_ms past its newest event, so the state holds the runs that go on, not all there ever were. Each
    micro-batch (of at most `files` files) writes what it changed to a folder of its own; newest_of reads the newest of all. Returns the rows
    in the state after each micro-batch. Events that come later than `delay` behind the newest are dropped, as the watermark has passed them. A run's late event after its end is told apart by its time, as newest_of compares times. Null stages are
    named ''; rows without a key or a ts are left out."""
    kinds = dict(spark.createDataFrame([], schema).dtypes)
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    when = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(key).alias(key), when.alias("when"), F.coalesce(F.col(stage), F.lit("")).alias("stage"), F.unix_micros(when).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).alias("value")).withWatermark("when", delay)
    processor = _Runs(key, kinds[value], ended, grace_ms)
    states = rows.groupBy(key).transformWithState(processor, f"{key} {kinds[key]}, stage string, at long, tie long, value {kinds[value]}", "Update", "EventTime")

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    try:
        query = states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def newest_of(spark: SparkSession, out: str, key: str) -> DataFrame:
    """What stream_run_states has written: for each run and stage the newest event's row, with its time as microseconds."""
    return spark.read.parquet(out).groupBy(key, "stage").agg(F.max(F.struct("at", "tie", "value")).alias("m")).select(key, "stage", "m.at", "m.tie", "m.value")
