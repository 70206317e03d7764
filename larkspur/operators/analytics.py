"""Counts and charts over leads: overview, weekly buckets, splits, rolling health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ["New", "Qualified", "Contacted", "Nurturing", "Won", "Lost"]


def overview(leads: DataFrame) -> DataFrame:
    """One row: total, qualified (by status or a score of 70 and more) and the mean known score to one decimal, 0.0 if none."""
    qualified = (F.col("status") == "Qualified") | (F.coalesce("score", F.lit(0)) >= 70)
    return leads.agg(F.count("*").alias("total"), F.count_if(F.coalesce(qualified, F.lit(False))).alias("qualified"), F.coalesce(F.bround(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"))


def weekly(rows: DataFrame, at: str, now: Column, weeks: int = 8) -> DataFrame:
    """(bucket, n) for the weeks that end now, W1 the oldest; both ends of a bucket count, so an inner edge counts twice.

    Each row finds its one or two buckets by arithmetic and is counted before any shuffle; empty buckets follow from a join
    with the few bucket numbers.
    """
    spark = rows.sparkSession
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / F.lit(7 * 86_400_000_000)
    back = F.floor(age).cast("int")
    hit = F.when(age == back, F.array(back, back - 1)).otherwise(F.array(back))
    counts = rows.select(F.explode(hit).alias("back")).where(F.col("back").between(0, weeks - 1)).groupBy("back").agg(F.count("*").alias("n"))
    all_ = spark.range(weeks).select(F.col("id").cast("int").alias("back"))
    return all_.join(counts, "back", "left").select(F.concat(F.lit("W"), F.lit(weeks) - F.col("back")).alias("bucket"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def source_split(leads: DataFrame, top: int = 4) -> DataFrame:
    """The most frequent sources and their share of all rows in percent; nameless ones are Unknown, ties go by first appearance."""
    named = F.when(F.coalesce("source", F.lit("")) != "", F.col("source")).otherwise("Unknown")
    counts = leads.groupBy(named.alias("source")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).orderBy(F.desc("n"), "first").limit(top).select("source", "n", F.bround(100 * F.col("n") / F.col("total")).cast("int").alias("percent"))


def status_breakdown(leads: DataFrame) -> DataFrame:
    """Every known status, absent ones as 0, then others by first appearance."""
    spark = leads.sparkSession
    known = spark.createDataFrame(list(enumerate(STATUSES)), "place int, status string")
    counts = leads.where("status is not null").groupBy("status").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    both = known.join(counts, "status", "full")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.coalesce("place", F.lit(len(STATUSES))), F.coalesce("first", F.lit(0)), "status"))
    return both.select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), rank.alias("place"))  # one row a status


def last_outcomes(outcomes: DataFrame, key: str, order: list, last: int = 100, least: int = 5, bad: float = 0.3) -> DataFrame:
    """(key, samples, rate, unhealthy) over each key's last outcomes; ok is a boolean column.

    Only as many rows of a key as are kept reach its final task: each task first keeps its own last ones.
    """
    w = Window.partitionBy(key).orderBy(*order)
    kept = outcomes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= last)
    rate = F.avg(F.col("ok").cast("double"))
    return kept.groupBy(key).agg(F.count("*").alias("samples"), F.bround(rate, 3).alias("rate"), ((rate < bad) & (F.count("*") >= least)).alias("unhealthy"))


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order (which should be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def search_page(leads: DataFrame, query: str, columns: list[str], order: list, page: int = 1, limit: int = 25, most: int = 100, literal: bool = False) -> DataFrame:
    """A page of rows any of whose columns contains the query, case aside; % and _ are wildcards unless literal."""
    page, limit = max(1, page), min(max(1, limit), most)
    q = query.lower()
    hit = F.lit(False)
    for c in columns:
        low = F.lower(F.col(c))
        hit = hit | F.coalesce(F.contains(low, F.lit(q)) if literal else low.like(f"%{q}%"), F.lit(False))
    return leads.where(hit).orderBy(*order).offset((page - 1) * limit).limit(limit)
