"""Filling what a record lacks from what was found about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import email, url
from larkspur.functions.text import filled, map_first
from larkspur.operators.quality_gate import completeness

FILLABLE = ["email", "phone", "website", "address", "hours", "description"]


def fill_gaps(items: DataFrame, found: DataFrame, key: str, has_mx: Column | None = None) -> DataFrame:
    """items with empty fields filled from found (one row a key), e-mails checked, the first valid of email_candidates else.

    ``enrichment_source`` names what contributed; known values are never overwritten.
    """
    fields = [c for c in FILLABLE if c in items.columns and c in found.columns]
    side = found.select(key, *(F.col(c).alias(f"new_{c}") for c in fields), *(["email_candidates"] if "email_candidates" in found.columns else []), F.lit(True).alias("seen_"))
    df = items.join(side, key, "left")
    used = F.coalesce(F.col("seen_"), F.lit(False)) & F.greatest(F.lit(False), *(~filled(F.col(c)) & filled(F.col(f"new_{c}")) for c in fields))
    df = df.withColumn("site_used_", used).withColumns({c: F.when(filled(F.col(c)), F.col(c)).otherwise(F.col(f"new_{c}")) for c in fields})
    good = email.validate_email(F.col("email"), has_mx)
    spare = F.lit(None).cast("string")
    if "email_candidates" in df.columns:
        spare = F.get(F.filter(F.transform("email_candidates", lambda e: email.validate_email(e)), lambda e: e.isNotNull()), F.lit(0))
    df = df.withColumn("spare_", F.when(~filled(F.col("email")), spare)).withColumn("email", F.coalesce(good, "spare_"))
    source = F.concat_ws(", ", F.when(F.col("site_used_"), "website"), F.when(F.col("spare_").isNotNull(), "website_email"))
    out = df.withColumns({"website": F.when(filled(F.col("website")), url.normalize_website(F.col("website"))), "enrichment_source": F.nullif(source, F.lit("")), "enrichment_status": F.lit("done")})
    out = out.withColumn("completeness", completeness(F.col("social_links") if "social_links" in items.columns else None))
    return out.drop("seen_", "site_used_", "spare_", "email_candidates", *(f"new_{c}" for c in fields))


def apply_to_leads(leads: DataFrame, patch: DataFrame, key: str = "lead_id") -> DataFrame:
    """leads with empty e-mail, phone and website filled, known social links winning, and a ``changed`` flag."""
    p = patch.select(key, *(F.col(c).alias(f"new_{c}") for c in ("email", "phone", "website", "social_links")))
    df = leads.join(p, key, "left")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    new = {c: F.when(filled(F.col(c)), F.col(c)).when(filled(F.col(f"new_{c}")), F.col(f"new_{c}")).otherwise(F.col(c)) for c in ("email", "phone", "website")}
    links = map_first(F.coalesce("social_links", empty), F.coalesce("new_social_links", empty))
    changed = F.greatest(*(~F.col(c).eqNullSafe(v) for c, v in new.items()), F.size(links) > F.size(F.coalesce("social_links", empty)))
    return df.withColumn("changed", changed).withColumns({**new, "social_links": links}).drop("new_email", "new_phone", "new_website", "new_social_links")


def score_status(leads: DataFrame, scores: DataFrame, key: str = "lead_id", good: int = 70) -> DataFrame:
    """leads with score between 0 and 100 and the status that follows from it; without a score they stay as they are."""
    bounded = F.when(F.col("score").isNotNull(), F.least(F.greatest("score", F.lit(0)), F.lit(100)))
    s = scores.select(key, bounded.cast("int").alias("new_score"))
    df = leads.join(s, key, "left")
    status = F.when(F.col("new_score").isNull(), F.col("status")).when(F.col("new_score") >= good, "Qualified").otherwise("New")
    return df.withColumns({"status": status, "score": F.coalesce("new_score", "score")}).drop("new_score")


def booking(messages: DataFrame) -> DataFrame:
    """(reference, lead, email, company, date) from booking messages like "Meeting booked! Reference: R. Lead: L. Date: D."."""
    part = lambda k: F.nullif(F.trim(F.regexp_extract("content", rf"\b{k}:\s*(.*?)(?:\.\s|\.?$)", 1)), F.lit(""))
    return messages.where(F.col("content").startswith("Meeting booked!")).select("*", part("Reference").alias("reference"), part("Lead").alias("lead"), part("Email").alias("email"), part("Company").alias("company"), part("Date").alias("date"))


def canonical_niche(rows: DataFrame, column: str, niches: list[str], stop: tuple[str, ...] = ("a", "an", "the", "and", "or", "shop", "store", "service", "services")) -> DataFrame:
    """rows with ``niche_key``: the equal niche, else the first that holds or is held, else the most shared words, else the text.

    Each distinct text is matched once; the niches are a short list in order of preference, kept in the expression.
    """
    key = F.lower(F.trim(column))
    words = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z]+"), F.lit(0))), lambda w: (F.length(w) > 2) & ~w.isin(*stop))
    known = F.array(*map(F.lit, niches))
    texts = rows.select(key.alias("k_")).where("k_ <> ''").distinct()
    inside = F.get(F.filter(known, lambda n: F.contains(F.col("k_"), n) | F.contains(n, F.col("k_"))), F.lit(0))
    shared = F.transform(known, lambda n, i: F.struct(F.size(F.array_intersect(words(n), words(F.col("k_")))).alias("s"), (-i).alias("o"), n.alias("n")))
    best = F.array_max(shared)
    match = F.coalesce(F.when(F.col("k_").isin(niches), F.col("k_")), inside, F.when(best["s"] > 0, best["n"]), F.col("k_"))
    return rows.withColumn("k_", key).join(texts.select("k_", match.alias("niche_key")), "k_", "left").drop("k_")
