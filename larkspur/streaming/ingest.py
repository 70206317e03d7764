"""Event feeds: idempotent ingestion, webhooks with a workspace's token, delivery events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, key: str, at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once within the delay; at is cast from timestamps without zone, which take no watermark."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def authorised(sent: DataFrame, workspaces: DataFrame) -> DataFrame:
    """What was sent with the token of its workspace, from (workspace_id, token, ...) rows; the others go."""
    return sent.join(workspaces.select("workspace_id", "token"), ["workspace_id", "token"])


def latest_status(feed: DataFrame, key: str) -> DataFrame:
    """(key, status, ts_us, event_id) of the newest event of each key so far, from rows in any order."""
    newest = F.max(F.struct("ts_us", "event_id", "status")).alias("x")
    return feed.groupBy(key).agg(newest).select(key, "x.status", "x.ts_us", "x.event_id")
