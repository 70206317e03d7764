"""Free meeting slots of many profiles, in each one's own time zone and weekday hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR, DAY = 60 * MINUTE, 1440 * MINUTE
WEEKDAYS = ["thursday", "friday", "saturday", "sunday", "monday", "tuesday", "wednesday"]  # the first of 1970 was a Thursday
#: Days that are looked at: more steps than STEPS allows lie in no fewer.
HORIZON, STEPS = 28, 500


def hhmm(c: Column) -> Column:
    """Minutes after midnight of hours:minutes, both whole numbers; null of anything else."""
    p = F.split(c, ":")
    return F.when(F.size(p) == 2, F.get(p, F.lit(0)).try_cast("long") * 60 + F.get(p, F.lit(1)).try_cast("long"))


def next_slots(profiles: DataFrame, bookings: DataFrame, now: Column, count: int = 4, minutes: int = 30, ahead: int = 5) -> DataFrame:
    """(profile, slot, at, place): the first ``count`` free slots after now of each profile, slot in its local time, at in UTC.

    profiles: (profile, zone, hours), hours a map of lower-cased weekdays to [open, close]; no zone means Asia/Karachi. Days without two readable
    times are closed. bookings: (profile, at); one takes every slot that begins less than ``minutes`` before or after it. All clocks are local
    wall clocks. Today's slots follow the half hours of the clock, other days' their opening time. Open days beyond
    ``ahead`` after the first aren't looked at, and the search goes in steps, an hour over closed days and a day over
    open ones, of which there are 500 at most: with one open day a week it ends after three weeks.

    Bookings within reach of a profile's slots are first reduced to the first and last of each half hour, so that neither a profile with very many of them nor
    the order they come in matters; a slot asks for the half hour it begins in and the two beside it.
    """
    step = minutes * MINUTE
    zone = F.coalesce(F.nullif("zone", F.lit("")), F.lit("Asia/Karachi"))
    p = profiles.select("profile", zone.alias("zone"), "hours").withColumn("now_", F.unix_micros(F.from_utc_timestamp(now, F.col("zone"))))
    floor = F.col("now_") - F.pmod(F.col("now_"), F.lit(step))
    p = p.withColumns({"floor_": floor, "day0_": F.col("now_") - F.pmod(F.col("now_"), F.lit(DAY))})
    days = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(HORIZON - 1)))).withColumn("day_", F.col("day0_") + F.col("i") * DAY)
    name = F.get(F.array(*map(F.lit, WEEKDAYS)), F.pmod(F.floor(F.col("day_") / DAY), F.lit(7)).cast("int"))
    h = F.try_element_at("hours", name)
    days = days.withColumns({"open_": hhmm(F.get(h, F.lit(0))), "close_": hhmm(F.get(h, F.lit(1)))}).withColumn("is_open", F.col("open_").isNotNull() & F.col("close_").isNotNull())
    left = F.ceil((F.col("day_") + DAY - F.col("floor_")) / HOUR)
    cost = F.when(F.col("is_open"), 1).when(F.col("i") == 0, left).otherwise(24)
    before = Window.partitionBy("profile", "zone").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumns({"seen_": F.coalesce(F.count_if("is_open").over(before), F.lit(0)), "steps_": F.coalesce(F.sum(cost).over(before), F.lit(0))})
    days = days.where(F.col("is_open") & (F.col("seen_") <= ahead) & (F.col("steps_") < STEPS))
    # Hour by hour over closed days, a start at half past comes to the first open day at half past midnight.
    start = F.when(F.col("i") == 0, F.col("floor_")).when(F.col("seen_") == 0, F.col("day_") + F.pmod(F.col("floor_"), F.lit(HOUR))).otherwise(F.col("day_"))
    start = F.greatest(start, F.col("day_") + F.col("open_") * F.lit(MINUTE))
    end = F.col("day_") + F.col("close_") * F.lit(MINUTE)
    spans = days.withColumns({"from_": start, "to_": end}).where("from_ < to_")
    slots = spans.withColumn("slot_", F.explode(F.sequence(F.col("from_"), F.col("to_") - 1, F.lit(step)))).where("slot_ > now_").select("profile", "zone", "slot_")
    half = lambda c: F.floor(c / step)
    reach = spans.groupBy("profile", "zone").agg((F.min("from_") - step).alias("from_"), (F.max("to_") + step).alias("to_"))
    local = bookings.select("profile", "at").join(reach, "profile").withColumn("b_", F.unix_micros(F.from_utc_timestamp(F.col("at").cast("timestamp"), F.col("zone"))))
    taken = local.where("b_ > from_ and b_ < to_").groupBy("profile", "zone", half(F.col("b_")).alias("h_")).agg(F.min("b_").alias("low_"), F.max("b_").alias("high_"))
    asks = slots.withColumn("h_", F.explode(F.array(*(half(F.col("slot_")) + d for d in (-1, 0, 1)))))
    # Spark takes exploded rows for as few as they were made of and would broadcast them.
    close = (F.abs(F.col("slot_") - F.col("high_")) < step) | (F.abs(F.col("low_") - F.col("slot_")) < step)
    hit = asks.hint("merge").join(taken, ["profile", "zone", "h_"]).where(close).select("profile", "zone", "slot_").distinct().hint("merge")
    free = slots.join(hit, ["profile", "zone", "slot_"], "left_anti")
    first = free.withColumn("place", F.row_number().over(Window.partitionBy("profile", "zone").orderBy("slot_"))).where(F.col("place") <= count)
    wall = F.timestamp_micros("slot_")
    return first.select("profile", wall.cast("timestamp_ntz").alias("slot"), F.to_utc_timestamp(wall, F.col("zone")).alias("at"), "place")
