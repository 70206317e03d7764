"""State changes around outreach and meetings, as frames derived from their events. Nothing is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import filled


def apply_sends(leads: DataFrame, sends: DataFrame) -> DataFrame:
    """leads after send results (lead_id, ok, at, error): a New lead becomes Contacted and is stamped by its first success; send_error is the latest failure's, cut at 500."""
    s = sends.groupBy("lead_id").agg(F.min(F.when(F.col("ok"), F.col("at"))).alias("at_"), F.max_by(F.left("error", F.lit(500)), F.when(~F.col("ok"), F.col("at"))).alias("send_error"))
    df = leads.join(s, "lead_id", "left")
    sent = F.col("at_").isNotNull()
    return df.withColumns({"status": F.when(sent & (F.col("status") == "New"), "Contacted").otherwise(F.col("status")), "outreach_sent_at": F.coalesce("outreach_sent_at", "at_")}).drop("at_")


def apply_bookings(leads: DataFrame, bookings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(leads to write, crm entries, system messages) of bookings (workspace_id, reference, name, email, at).

    A lead of the workspace with the e-mail, case aside, becomes Hot; bookings without one make a Hot lead with the first one's name
    (the earliest, of those at one time the first by reference; those without a time come last).
    """
    b = bookings.withColumn("mail_", F.lower("email"))
    known = leads.withColumn("mail_", F.lower("email")).where(filled(F.col("email")))
    old = known.join(b.select("workspace_id", "mail_").distinct(), ["workspace_id", "mail_"], "left_semi").select("workspace_id", "mail_", "name", "email", F.lit("Hot").alias("status"))
    new = b.join(known, ["workspace_id", "mail_"], "left_anti").groupBy("workspace_id", "mail_").agg(F.min(F.struct(F.col("at").isNull(), "at", "reference", "name", "email")).alias("b_")).select("workspace_id", "mail_", "b_.name", "b_.email").withColumn("status", F.lit("Hot"))
    hot = old.unionByName(new).select("workspace_id", "name", "email", "status")
    crm = b.groupBy("workspace_id", "mail_").agg(F.min("at").alias("added_at")).withColumnRenamed("mail_", "email")
    said = F.concat(F.lit("Meeting booked! Reference: "), F.col("reference"), F.lit(". Lead: "), F.col("name"), F.lit(". Email: "), F.col("email"), F.lit(". Date: "), F.date_format("at", "yyyy-MM-dd HH:mm"))
    return hot, crm, bookings.select("workspace_id", F.lit("system").alias("sender_type"), said.alias("content"), "at")


def replay(activity: DataFrame, workspace: str, last: int = 100) -> DataFrame:
    """A workspace's last activities, oldest first, one for each time and stage."""
    one = activity.where(F.col("workspace_id") == workspace).groupBy("created_at", "stage").agg(F.max("detail").alias("detail"))
    return one.orderBy(F.desc("created_at"), "stage").limit(last).orderBy("created_at", "stage")


def web_results(rows: DataFrame, directories: list[str], source: str = "web_search") -> DataFrame:
    """Search results (title, url) as candidates: the title up to a bar as name, directory hosts left out."""
    from larkspur.functions import email, text, url

    host = email.host(F.col("url"))
    kept = rows.where(filled(F.col("url")) & ~F.coalesce(url.blocked_host(host, directories), F.lit(False)))
    return kept.select(text.clean_business_name(F.col("title")).alias("name"), F.col("url").alias("website"), F.lit(source).alias("source")).where(filled(F.col("name")))
