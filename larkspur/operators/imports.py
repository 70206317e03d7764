"""Imports in order: which rows repeat an earlier accepted one, and where a workspace's room runs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.ordered import running
from larkspur.session import durable


def lead_keys():
    """What a lead is recognised by, in order: its e-mail, case aside, else its phone, white space aside; empty ones don't count."""
    mail, call = F.nullif(F.lower("email"), F.lit("")), F.nullif(F.regexp_replace("phone", r"\s+", ""), F.lit(""))
    both = F.array(F.struct(F.lit("email").alias("kind"), mail.alias("value")), F.struct(F.lit("phone").alias("kind"), call.alias("value")))
    return F.filter(both, lambda k: k["value"].isNotNull())


def mark_duplicates(rows: DataFrame, held: DataFrame, within: str = "workspace_id", order: str = "ordinal") -> DataFrame:
    """rows with ``duplicate``: "email" or "phone" where a held lead or an earlier accepted row of the workspace has it, else null.

    A row is accepted if it repeats none of them; only accepted rows claim their e-mail and phone. order is distinct
    within a workspace. Decided by peeling: a row that is the first open one for each of its keys is accepted, and all
    other open rows with a key of it are refused. A very common key is decided by one round for all its rows; the number
    of rounds is that of the longest chain of rows that each wait for the one before, few unless keys are made to chain.
    """
    key, own = ["kind", "value"], [within, order]
    claims = durable(rows.select(*own, F.explode(lead_keys()).alias("k")).select(*own, "k.*"))
    known = held.select(within, F.explode(lead_keys()).alias("k")).select(within, "k.*").distinct()
    owners = [durable(known.withColumn("owner_", F.lit(None).cast(rows.schema[order].dataType)))]
    refused = claims.join(known, [within, *key]).select(*own).distinct()
    open_ = durable(claims.join(refused, own, "left_anti"))
    while not open_.isEmpty():
        firsts = open_.groupBy(within, *key).agg(F.min(order).alias("owner_"))
        judged = open_.join(firsts, [within, *key])
        taken = judged.groupBy(*own).agg(F.every(F.col("owner_") == F.col(order)).alias("ok_")).where("ok_").drop("ok_")
        owned = durable(open_.join(taken, own).withColumn("owner_", F.col(order)))
        owners.append(owned.select(within, *key, "owner_"))
        gone = open_.join(owned.select(within, *key), [within, *key], "left_semi").select(*own).distinct()
        open_ = durable(open_.join(gone, own, "left_anti"))
    owner = owners[0]
    for o in owners[1:]:
        owner = owner.unionByName(o)
    # A key has one owner: a row repeats it if it is held or belongs to an earlier row.
    repeats = claims.join(owner, [within, *key]).where(F.col("owner_").isNull() | (F.col("owner_") < F.col(order)))
    reasons = repeats.groupBy(*own).agg(F.min("kind").alias("duplicate"))  # "email" sorts before "phone"
    return rows.drop("duplicate").join(reasons, own, "left")


def import_rows(rows: DataFrame, held: DataFrame, rooms: DataFrame, within: str = "workspace_id", order: str = "ordinal") -> DataFrame:
    """rows with ``duplicate`` (see mark_duplicates()) and ``outcome``: imported, duplicate, daily_limit_reached, quota_exceeded or not_reached.

    rooms has one row (within, day_room, quota_room) a workspace; a missing or null room has no end. Before every row the
    day's room is looked at, then the quota, then its keys: once as many are imported as the day has room for, all further
    rows are beyond the day's limit; once the quota is full, the next row ends the import, whether it repeats one or not.
    """
    return outcomes(mark_duplicates(rows, held, within, order), F.col("duplicate").isNotNull(), rooms, within, order).withColumn("duplicate", F.when(F.col("outcome") == "duplicate", F.col("duplicate"))).select(*rows.columns, "duplicate", "outcome")


def outcomes(rows: DataFrame, repeats: Column, rooms: DataFrame, within: str, order: str) -> DataFrame:
    """rows with ``outcome``, where repeats tells which rows would be refused as duplicates; rooms as of import_rows()."""
    counted = running(rows.withColumn("repeats_", repeats), [within], [order], ~F.col("repeats_"), "before_").join(rooms.select(within, "day_room", "quota_room"), within, "left")
    # Whichever room is the smaller one decides about all that follows, the day's where they are alike.
    endless = F.lit(2**62)
    day, quota = (F.greatest(F.coalesce(F.col(c).cast("long"), endless), F.lit(0)) for c in ("day_room", "quota_room"))
    full_day = (day <= quota) & (F.col("before_") >= day)
    full = (quota < day) & (F.col("before_") >= quota)
    ends = counted.where(full).groupBy(within).agg(F.min(order).alias("end_"))
    said = F.when(full_day, "daily_limit_reached").when(full & (F.col(order) == F.col("end_")), "quota_exceeded").when(full, "not_reached")
    return counted.join(ends, within, "left").select(*rows.columns, said.when(F.col("repeats_"), "duplicate").otherwise("imported").alias("outcome"))


def update_conflicts(leads: DataFrame, updates: DataFrame, within: str = "workspace_id", key: str = "lead_id") -> DataFrame:
    """updates (key, within, email, phone; the values after the update) with ``duplicate``: what another lead of the workspace has.

    Leads are first grouped by each key, so that one that very many leads have is one row.
    """
    held = leads.select(within, key, F.explode(lead_keys()).alias("k")).groupBy(within, "k.kind", "k.value").agg(F.min(key).alias("low_"), F.max(key).alias("high_"))
    asked = updates.select(within, key, F.explode(lead_keys()).alias("k")).select(within, key, "k.*").join(held, [within, "kind", "value"])
    hit = asked.where((F.col("low_") != F.col(key)) | (F.col("high_") != F.col(key))).groupBy(within, key).agg(F.min("kind").alias("duplicate"))
    return updates.join(hit, [within, key], "left")
