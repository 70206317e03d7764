"""Which candidate records are worth keeping, and how complete they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import email, phone
from larkspur.functions.text import clean_business_name, filled, present, title

WEIGHTS = {"name": 10, "address": 15, "phone": 20, "email": 25, "website": 20}
SOCIAL_WEIGHT = 10


def completeness(social: Column | None = None) -> Column:
    """0 to 100 over columns name, address, phone, email and website, and a non-empty social map."""
    score = sum((F.when(present(F.col(c)), w).otherwise(0) for c, w in WEIGHTS.items()), F.lit(0))
    has = F.lit(False) if social is None else F.coalesce(F.size(social) > 0, F.lit(False))
    return score + F.when(has, SOCIAL_WEIGHT).otherwise(0)


def reachable() -> Column:
    """A phone, an e-mail, a website, or a name with an address and coordinates on the globe."""
    place = present(F.col("name")) & present(F.col("address")) & F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    return filled(F.col("phone")) | filled(F.col("email")) | filled(F.col("website")) | place


def gate(candidates: DataFrame, country: str = "PK", mx: DataFrame | None = None) -> DataFrame:
    """Candidates with phone and e-mail in clean form or null, and only those still reachable.

    mx: (domain, has_mx) of known domains; an unknown domain is given the benefit of the doubt.
    """
    df = candidates.withColumn("phone", phone.normalize_phone(F.col("phone"), country))
    if mx is None:
        df = df.withColumn("email", email.validate_email(F.col("email")))
    else:
        known = mx.select(F.col("domain").alias("domain_"), F.col("has_mx").alias("has_mx_")).dropDuplicates(["domain_"])
        df = df.join(known, email.domain(F.lower(F.trim("email"))) == F.col("domain_"), "left")
        df = df.withColumn("email", email.validate_email(F.col("email"), F.col("has_mx_"))).drop("domain_", "has_mx_")
    return df.where(reachable())


def clean(candidates: DataFrame, industry: str, directory_domains: list[str]) -> DataFrame:
    """Names without their tail, a default industry, and no website that is a directory's."""
    from larkspur.functions.url import blocked_host

    site = F.when(~F.coalesce(blocked_host(email.host(F.col("website")), directory_domains), F.lit(False)), F.col("website"))
    return candidates.withColumns({"name": clean_business_name(F.col("name")), "industry": F.coalesce("industry", title(F.lit(industry))), "website": site})


def cut_then_rank(valid: DataFrame, limit: int) -> DataFrame:
    """The first so many by ordinal, and only those by completeness, ordinal between equals."""
    return valid.orderBy("ordinal").limit(limit).orderBy(F.desc("completeness"), "ordinal")


def tiers_until(valid: DataFrame, limit: int) -> DataFrame:
    """Whole tiers (column tier, cheapest first) until the tiers before hold enough rows; few tiers, counted first."""
    from pyspark.sql import Window

    sizes = valid.groupBy("tier").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return valid.join(sizes.select("tier", before.alias("before")).where(F.col("before") < limit).drop("before"), "tier", "left_semi")
