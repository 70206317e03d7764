"""Inserts, updates and deletes as rewrites of keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.imports import outcomes

def insert_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(rows to add, one row with added and skipped): new rows without an old row of their keys, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = new.withColumn("rn_", F.row_number().over(w))
    absent = first.where("rn_ = 1").drop("rn_").join(old.select(*keys).distinct(), keys, "left_anti")
    counts = new.agg(F.count("*").alias("all_")).join(absent.agg(F.count("*").alias("added"))).select("added", (F.col("all_") - F.col("added")).alias("skipped"))
    return absent, counts


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list, patch: bool = False) -> DataFrame:
    """The latest row of each key over old and new rows; patch: nulls of a new row leave the old value."""
    if patch:
        rest = [c for c in old.columns if c not in keys]
        latest = _latest(new, keys, version).select(*keys, *(F.col(c).alias(f"new_{c}") for c in rest))
        joined = old.join(latest, keys, "full")
        return joined.select(*keys, *(F.coalesce(f"new_{c}", c).alias(c) for c in rest))
    both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    return _latest(both, keys, [F.desc("new_"), *version]).drop("new_")


def _latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def mark_known(candidates: DataFrame, leads: DataFrame, flag: str = "already_in_workspace") -> DataFrame:
    """candidates with a flag: a lead has the same e-mail, case aside, or the same phone, white space aside."""
    mail = leads.select(F.lower("email").alias("mail_")).where("mail_ <> ''").distinct().withColumn("m_", F.lit(True))
    call = leads.select(F.regexp_replace("phone", r"\s+", "").alias("call_")).where("call_ <> ''").distinct().withColumn("c_", F.lit(True))
    df = candidates.join(mail, F.lower("email") == F.col("mail_"), "left").join(call, F.regexp_replace("phone", r"\s+", "") == F.col("call_"), "left")
    return df.withColumn(flag, F.coalesce("m_", "c_", F.lit(False))).drop("mail_", "m_", "call_", "c_")


def mark_repeated(leads: DataFrame, flag: str = "already_in_workspace") -> DataFrame:
    """leads with a flag as of mark_known(), each lead against all others."""
    none = F.lit(None).cast("string")
    mail = leads.groupBy(F.lower("email").alias("email")).count().where("count > 1").select("email", none.alias("phone"))
    call = leads.groupBy(F.regexp_replace("phone", r"\s+", "").alias("phone")).count().where("count > 1").select(none.alias("email"), "phone")
    return mark_known(leads, mail.unionAll(call), flag)


def classify_import(rows: DataFrame, duplicate: Column, used_today: int, daily_limit: int, used: int, quota: int) -> DataFrame:
    """rows (ordinal) of one workspace with ``outcome``: see imports.import_rows(); duplicate tells which rows repeat a lead."""
    one = rows.sparkSession.createDataFrame([(0, daily_limit - used_today, quota - used)], "one_ int, day_room int, quota_room int")
    return outcomes(rows.withColumn("one_", F.lit(0)), duplicate, one, "one_", "ordinal").drop("one_")


def purge(tables: dict[str, DataFrame], workspace: str, key: str = "workspace_id") -> dict[str, DataFrame]:
    """Every table without one tenant's rows."""
    return {name: df.where(~F.col(key).eqNullSafe(F.lit(workspace))) for name, df in tables.items()}


# What a delivery event makes of a message's status.
DELIVERY = {"delivered": "delivered", "hard_bounce": "bounced", "soft_bounce": "bounced", "blocked": "blocked", "spam": "complained", "deferred": "delayed", "error": "failed"}


def apply_delivery(messages: DataFrame, events: DataFrame, statuses: dict[str, str] = DELIVERY) -> DataFrame:
    """messages (provider_message_id, status, sent_at) after their latest known event (provider_message_id, event, ts, event_id)."""
    named = F.create_map(*(x for k, v in statuses.items() for x in (F.lit(k), F.lit(v))))
    known = events.withColumn("to_", F.try_element_at(named, F.col("event"))).where("to_ is not null")
    last = _latest(known, ["provider_message_id"], [F.desc("ts"), F.desc("event_id")]).select("provider_message_id", "to_", F.col("ts").alias("ts_"))
    out = messages.join(last, "provider_message_id", "left")
    sent = F.when(F.col("to_") == "delivered", F.coalesce("sent_at", "ts_")).otherwise(F.col("sent_at"))
    return out.withColumns({"status": F.coalesce("to_", "status"), "sent_at": sent}).drop("to_", "ts_")
