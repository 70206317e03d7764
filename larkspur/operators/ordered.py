"""Work along an order, without a task that holds a whole group: rows are range-partitioned and only sums of parts cross over.

Rows are sorted by group and position and dealt to tasks by ranges, so that a group of
any size lies in as many parts as it needs. What a row needs of rows in other parts of its
group is one value a part, from a table with a row for each part of each group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import durable


def in_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """df range-partitioned by order, with ``part_``; written once, so that parts stay as they are when a task is run again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.repartitionByRange(n, *order).withColumn("part_", F.spark_partition_id()))


def running(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of value over the rows before this one in its group.

    Groups of null keys count as groups; of rows equal in by and order any may come first.
    """
    rows = in_parts(df.withColumn("v_", value.cast("long")), [*by, *order])
    inside = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part_", *by).agg(F.sum("v_").alias("sum_")).withColumn("carry_", F.coalesce(F.sum("sum_").over(before), F.lit(0)))
    named = sums.select(F.col("part_").alias("p_"), *(F.col(b).alias(f"{b}_k_") for b in by), "carry_")
    same = reduce(Column.__and__, (F.col(b).eqNullSafe(F.col(f"{b}_k_")) for b in by), F.col("part_") == F.col("p_"))
    out = rows.withColumn("in_", F.coalesce(F.sum("v_").over(inside), F.lit(0))).join(named, same)
    return out.withColumn(name, F.col("in_") + F.col("carry_")).select(*df.columns, name)


def successors(moments: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """(by, at, next): the first moment of the group that lies at least gap after this one, null if there is none.

    Moments are distinct (by, at), at a long. Each asks at at + gap; questions and moments are sorted together and the
    answer is the next moment in the sort, in this part or in the first later part of the group that has one.
    """
    there = moments.select(by, F.col(at).alias("t_"), F.lit(1).alias("kind_"), F.col(at).alias("own_"))
    asked = moments.select(by, (F.col(at) + gap).alias("t_"), F.lit(0).alias("kind_"), F.col(at).alias("own_"))
    rows = in_parts(there.unionAll(asked), [by, "t_", "kind_"])
    moment = F.when(F.col("kind_") == 1, F.col("t_"))
    # Backwards, as Spark keeps a running value only of frames that begin with the first row; it works others out anew for each row.
    ahead = Window.partitionBy("part_", by).orderBy(F.desc("t_"), F.desc("kind_")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(by).orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("part_", by).agg(F.min(moment).alias("first_")).withColumn("later_", F.min("first_").over(later)).drop("first_")
    found = rows.withColumn("here_", F.min(moment).over(ahead)).where("kind_ = 0").join(firsts, ["part_", by])
    return found.select(by, F.col("own_").alias(at), F.coalesce("here_", "later_").alias("next"))


def spaced(events: DataFrame, by: str, at: str, order: str, gap_us: int) -> DataFrame:
    """The events that are accepted where one counts only gap_us microseconds or more after the last accepted one of its group.

    A rejected event delays nothing. The accepted moments are the chain of successors from a group's first moment;
    pointer doubling marks it in as many rounds as the logarithm of the longest chain. Of events at one moment the first
    by order counts. Events of null group or time are never accepted.
    """
    timed = events.withColumn("t_", F.unix_micros(F.col(at).cast("timestamp"))).where(F.col("t_").isNotNull() & F.col(by).isNotNull())
    moments = durable(timed.groupBy(by, "t_").agg(F.min(order).alias("first_")))
    jump = durable(successors(moments.select(by, "t_"), by, "t_", gap_us).where("next is not null"))
    marked = [durable(moments.groupBy(by).agg(F.min("t_").alias("t_")))]
    while True:
        # All marked so far jump as far as they reach; the next jumps reach twice as far.
        reach = reduce(DataFrame.unionAll, marked).join(jump, [by, "t_"]).select(by, F.col("next").alias("t_"))
        marked.append(durable(reach))
        if marked[-1].isEmpty():
            break
        onward = jump.select(by, F.col("t_").alias("next"), F.col("next").alias("next_"))
        jump = durable(jump.join(onward, [by, "next"]).select(by, "t_", F.col("next_").alias("next")))
    kept = moments.join(reduce(DataFrame.unionAll, marked), [by, "t_"]).select(F.col(by).alias("by_"), F.col("t_").alias("at_"), F.col("first_"))
    return timed.join(kept, (F.col(by) == F.col("by_")) & (F.col("t_") == F.col("at_")) & (F.col(order) == F.col("first_"))).select(*events.columns)
