"""Source health and circuit breakers as a stream: batches are summed up by source before any state is touched.

A breaker counts failures in a row; at its threshold every further one keeps the source shut
for the cooldown. A success sets the count back and leaves an open breaker open. What a
batch means for a source is one short row, found by a distributed running count of
successes: the failures before its first success and after its last one, the last trip in
between, and the newest outcomes. The state takes in those rows only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from larkspur.operators.ordered import running
from larkspur.session import shared_folder

# Failures in a row that trip a source's breaker, and seconds that it then stays shut; any other source has 2 and 300.
SETTINGS = {"google_maps": (2, 600), "directory": (3, 300), "bing_maps": (3, 180), "bizdata": (3, 120)}
FAILURES, COOLDOWN = 2, 300
LAST, LEAST, BAD = 100, 5, 0.3

SUMMARY = "source string, batch long, threshold int, cooldown_s int, wins long, head long, head_us long, tail long, trip_us long, newest array<struct<ts_us:long,event_id:long,ok:boolean>>, at timestamp"
HEALTH = "source string, batch long, samples int, rate double, unhealthy boolean, failures int, open_until_s double, open boolean"


def settings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, *v) for s, v in SETTINGS.items()], "source string, threshold int, cooldown_s int")


def summed(outcomes: DataFrame, known: DataFrame, last: int = LAST) -> DataFrame:
    """One row a source of outcomes (source, ts_us, event_id, ok), in SUMMARY's columns but batch; settings as of known, else the defaults.

    Outcomes go by (ts_us, event_id); a null ok is a failure, a null source "unknown". No task holds a source's rows.
    """
    rows = outcomes.select(F.coalesce("source", F.lit("unknown")).alias("source"), "ts_us", "event_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    counted = running(rows, ["source"], ["ts_us", "event_id"], F.col("ok"), "after")
    runs = counted.groupBy("source", "after").agg(F.count_if(~F.col("ok")).alias("n"), F.max(F.when(~F.col("ok"), F.col("ts_us"))).alias("us"))
    limits = known.select("source", F.col("threshold").alias("t_"), F.col("cooldown_s").alias("c_"))
    runs = runs.join(F.broadcast(limits), "source", "left").withColumns({"threshold": F.coalesce("t_", F.lit(FAILURES)), "cooldown_s": F.coalesce("c_", F.lit(COOLDOWN))})
    wins = counted.groupBy("source").agg(F.count_if("ok").alias("wins"), F.max("ts_us").alias("last_us"))
    head = F.col("after") == 0
    whole = runs.groupBy("source").agg(
        F.max("threshold").alias("threshold"), F.max("cooldown_s").alias("cooldown_s"), F.coalesce(F.max(F.when(head, F.col("n"))), F.lit(0)).alias("head"), F.max(F.when(head, F.col("us"))).alias("head_us"),
        F.max(F.when(~head & (F.col("n") >= F.col("threshold")), F.col("us"))).alias("trip_us"), F.max_by("n", "after").alias("last_n"), F.max("after").alias("last_after"))
    place = F.row_number().over(_newest())
    newest = rows.withColumn("place", place).where(F.col("place") <= last).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("ts_us", "event_id", "ok"))).alias("newest"))
    out = whole.join(wins, "source").join(newest, "source")
    tail = F.when(F.col("last_after") == F.col("wins"), F.col("last_n")).otherwise(0)
    return out.select("source", "threshold", "cooldown_s", "wins", "head", "head_us", tail.alias("tail"), "trip_us", "newest", F.timestamp_micros("last_us").alias("at"))


def _newest():
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy(F.desc("ts_us"), F.desc("event_id"))


class Health(StatefulProcessor):
    """State of a source: failures in a row and the end of the cooldown (a value), the newest outcomes (a list).

    Gives one row a source and batch; a timer gives one more with open false when the watermark passes a cooldown's end.
    """

    def __init__(self, last: int = LAST, least: int = LEAST, bad: float = BAD):
        self.last, self.least, self.bad = last, least, bad

    def init(self, handle) -> None:
        self.handle = handle
        self.breaker = handle.getValueState("breaker", "failures long, until_us long, batch long")
        self.newest = handle.getListState("newest", "ts_us long, event_id long, ok boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        failures, until, _ = self.breaker.get() if self.breaker.exists() else (0, 0, -1)
        kept = [tuple(x) for x in self.newest.get()]
        for r in sorted(rows, key=lambda r: r.batch):
            if r.head and failures + r.head >= r.threshold:
                until = r.head_us + r.cooldown_s * 1_000_000
            if r.wins:
                until = r.trip_us + r.cooldown_s * 1_000_000 if r.trip_us is not None else until
                failures = r.tail
            else:
                failures += r.head
            kept = sorted([*kept, *((x["ts_us"], x["event_id"], x["ok"]) for x in r.newest)])[-self.last :]
            self.breaker.update((failures, until, r.batch))
            yield self._said(key[0], r.batch, kept, failures, until, kept[-1][0] < until)
        self.newest.put(kept)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if kept and kept[-1][0] < until:
            self.handle.registerTimer(-(-until // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        failures, until, batch = self.breaker.get()
        yield self._said(key[0], batch, [tuple(x) for x in self.newest.get()], failures, until, False)

    def _said(self, source: str, batch: int, kept: list[tuple], failures: int, until: int, is_open: bool) -> Row:
        good = sum(ok for *_, ok in kept) / len(kept)
        return Row(source=source, batch=batch, samples=len(kept), rate=round(good, 3), unhealthy=good < self.bad and len(kept) >= self.least, failures=int(failures), open_until_s=until / 1e6, open=is_open)

    def close(self) -> None:
        pass


PATCH = "job long, item long, ts_us long, seq long, status string, batch long"
JOB = "job long, batch long, items long, done long, status string"


class Job(StatefulProcessor):
    """State of a job: its items' statuses (a map), and how many items there are and are done. Gives a JOB row after each batch that patched one.

    An item keeps the status of its latest patch; a job is done once all its items are done or failed. Only patched items are read and written.
    """

    def init(self, handle) -> None:
        self.items = handle.getMapState("items", "item long", "ts_us long, seq long, status string")
        self.counts = handle.getValueState("counts", "items long, done long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, done = self.counts.get() if self.counts.exists() else (0, 0)
        for batch, patches in groupby(sorted(rows, key=lambda r: r.batch), lambda r: r.batch):
            for r in patches:
                old = self.items.getValue((r.item,))
                if old is None or (r.ts_us, r.seq) >= (old[0], old[1]):
                    n += old is None
                    done += (r.status in ("done", "failed")) - (old is not None and old[2] in ("done", "failed"))
                    self.items.updateValue((r.item,), (r.ts_us, r.seq, r.status))
            yield Row(job=key[0], batch=batch, items=n, done=done, status="done" if done == n else "in_progress")
        self.counts.update((n, done))

    def close(self) -> None:
        pass


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that processors need, for the streams started inside."""
    name, kind = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, kind)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def to_files(stream: DataFrame, path: str, make: Callable[[DataFrame, int], DataFrame], mode: str = "append") -> None:
    """Runs the stream over all there is; what make() makes of each batch is one folder, written anew if the batch is repeated."""

    def write(batch: DataFrame, n: int) -> None:
        make(batch, n).write.mode("overwrite").parquet(f"{path}/out/batch_={n}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()


def source_health(outcomes: DataFrame, known: DataFrame | None = None, delay: str = "1 minute", path: str | None = None) -> DataFrame:
    """HEALTH rows of a stream of outcomes (source, ts_us, event_id, ok), one a source and batch and one a closed breaker.

    Two streams: one sums batches up and writes the sums to the shared folder, the other feeds them to the state. A call with
    the same path goes on where the last one ended. Batches are taken to follow each other; rows within one have any order.
    """
    spark = outcomes.sparkSession
    known = settings(spark) if known is None else known
    top = path or f"{shared_folder(spark)}/health-{uuid.uuid4().hex}"
    to_files(outcomes, f"{top}/sums", lambda b, n: summed(b, known).withColumn("batch", F.lit(n).cast("long")).select(*T.StructType.fromDDL(SUMMARY).names))
    with rocks(spark):
        sums = spark.readStream.schema(SUMMARY).parquet(f"{top}/sums/out/batch_=*").withWatermark("at", delay)
        state = sums.groupBy("source").transformWithState(Health(), T.StructType.fromDDL(HEALTH), "update", "eventTime")
        to_files(state, f"{top}/state", lambda b, n: b, "update")
    return spark.read.schema(T.StructType.fromDDL(HEALTH).add("batch_", T.IntegerType())).parquet(f"{top}/state/out")


def job_progress(patches: DataFrame, path: str | None = None) -> DataFrame:
    """(job, items, done, status, batch_) of a stream of patches (job, item, ts_us, seq, status): one row a job and batch.

    Two streams, as for source_health: one writes the latest patch of each item of a batch, which partial sums find (of patches
    alike in ts_us and seq the one with the last status in the alphabet), the other feeds those to the state.
    """
    spark = patches.sparkSession
    top = path or f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    last = F.max(F.struct("ts_us", "seq", "status")).alias("p")
    to_files(patches, f"{top}/sums", lambda b, n: b.groupBy("job", "item").agg(last).select("job", "item", "p.*", F.lit(n).cast("long").alias("batch")))
    with rocks(spark):
        state = spark.readStream.schema(PATCH).parquet(f"{top}/sums/out/batch_=*").groupBy("job").transformWithState(Job(), T.StructType.fromDDL(JOB), "update", "none")
        to_files(state, f"{top}/state", lambda b, n: b, "update")
    return spark.read.schema(JOB).parquet(f"{top}/state/out/batch_=*").withColumn("batch", F.col("batch").cast("int")).withColumnRenamed("batch", "batch_")
