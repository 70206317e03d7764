"""Live activity beside its replay: each activity once, the newest of a workspace."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from larkspur.session import shared_folder
from larkspur.streaming.health import rocks, to_files

MOST = 40
ACTIVITY = "workspace_id long, at_us long, stage string, live boolean, detail string"
FEED = "workspace_id long, at_us long, stage string, live boolean, detail string, place int"


def newest(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The newest activities of each workspace, one for each time and stage: the live one before the replayed one."""
    one = Window.partitionBy("workspace_id", "at_us", "stage").orderBy(F.desc("live"), "detail")
    first = rows.withColumn("rn_", F.row_number().over(one)).where("rn_ = 1")
    w = Window.partitionBy("workspace_id").orderBy(F.desc("at_us"), "stage")
    return first.withColumn("rn_", F.row_number().over(w)).where(F.col("rn_") <= most).drop("rn_")


class Feed(StatefulProcessor):
    """State of a workspace: its newest activities (a list, newest first). Gives the whole list after each batch that touched it."""

    def __init__(self, most: int = MOST):
        self.most = most

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "at_us long, stage string, live boolean, detail string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {(x[0], x[1]): tuple(x) for x in self.kept.get()}
        for r in rows:
            old = known.get((r.at_us, r.stage))
            if old is None or r.live and not old[2]:
                known[r.at_us, r.stage] = (r.at_us, r.stage, r.live, r.detail)
        kept = sorted(known.values(), key=lambda x: (-x[0], x[1]))[: self.most]
        self.kept.put(kept)
        for i, (at, stage, live, detail) in enumerate(kept):
            yield Row(workspace_id=key[0], at_us=at, stage=stage, live=live, detail=detail, place=i + 1)

    def close(self) -> None:
        pass


def live_feed(activity: DataFrame, path: str | None = None) -> DataFrame:
    """FEED rows of a stream of ACTIVITY rows, with ``batch_``: a workspace's list after each batch that changed it; the latest batch counts.

    A batch is first reduced to what can be among the newest of a workspace, so that a busy workspace is no burden on its state. Replayed
    and live rows may come in any order and more than once.
    """
    spark = activity.sparkSession
    top = path or f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    names = T.StructType.fromDDL(ACTIVITY).names
    rows = activity.select(*names).where("workspace_id is not null and at_us is not null and stage is not null").withColumn("live", F.coalesce("live", F.lit(False)))
    to_files(rows, f"{top}/some", lambda b, n: newest(b))
    with rocks(spark):
        some = spark.readStream.schema(ACTIVITY).parquet(f"{top}/some/out/batch_=*")
        to_files(some.groupBy("workspace_id").transformWithState(Feed(), T.StructType.fromDDL(FEED), "update", "none"), f"{top}/state", lambda b, n: b, "update")
    return spark.read.schema(T.StructType.fromDDL(FEED).add("batch_", T.IntegerType())).parquet(f"{top}/state/out")


def current(feed: DataFrame) -> DataFrame:
    """Each workspace's list after its latest batch."""
    last = feed.groupBy("workspace_id").agg(F.max("batch_").alias("batch_"))
    return feed.join(last, ["workspace_id", "batch_"], "left_semi").drop("batch_")
