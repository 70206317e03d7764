"""Entity resolution: records of one business from several sources become one.

Which group a record joins depends on the order of arrival: it joins the group that
first claimed its name, else its phone, else its website, and otherwise starts one.
Both that and what a group's fields are have closed forms: pointers to first records,
followed by doubling, and one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import phone, text, url
from larkspur.functions.text import filled
from larkspur.session import durable

# Sources from the most to the least trusted; any other ranks behind all.
SOURCES = ["google_maps", "directory", "openstreetmap", "web_search", "wikidata", "wikipedia", "certtransparency", "dns"]
CONFLICT = ["phone", "website", "email", "address", "hours", "description", "category", "industry"]
FILL = ["rating", "review_count", "plus_code"]


def rank(source: Column) -> Column:
    place = F.array_position(F.array(*map(F.lit, SOURCES)), source)
    return F.when(place > 0, place.cast("int") - 1).otherwise(len(SOURCES))


def keyed(candidates: DataFrame) -> DataFrame:
    """Named candidates with their three keys; an empty key matches nothing."""
    named = candidates.where(filled(F.col("name")))
    keys = {"k_name": text.normalize_name(F.col("name")), "k_phone": phone.merge_key(F.col("phone")), "k_site": url.website_key(F.col("website"))}
    return named.withColumns({k: F.nullif(c, F.lit("")) for k, c in keys.items()})


def assign(candidates: DataFrame) -> DataFrame:
    """(ordinal, group_id): group_id is the ordinal of the record that started the group.

    A key belongs to the group of the first record that has it, so a record follows the first
    record with its name if that is an earlier one, else the one with its phone, else with its
    website. These pointers form a forest; each round doubles how far a pointer reaches, so the
    rounds are the logarithm of the longest chain. No group ever meets in one task: firsts are
    partially aggregated, and the joins have one row a key on one side, which lets Spark split
    the other where a key is very common.
    """
    records = keyed(candidates)
    keys = F.filter(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"k_{k}").alias("value")) for i, k in enumerate(("name", "phone", "site")))), lambda k: k["value"].isNotNull())
    pairs = durable(records.select("ordinal", F.explode_outer(keys).alias("key")).select("ordinal", "key.kind", "key.value"))
    firsts = pairs.where("value is not null").groupBy("kind", "value").agg(F.min("ordinal").alias("first"))
    leads = pairs.join(firsts, ["kind", "value"], "left").groupBy("ordinal").agg(F.min(F.when(F.col("first") < F.col("ordinal"), F.struct("kind", "first"))).alias("lead"))
    parent = durable(leads.select("ordinal", F.coalesce("lead.first", "ordinal").alias("group_id")))
    while True:
        up = parent.where("ordinal <> group_id").select(F.col("ordinal").alias("group_id"), F.col("group_id").alias("up"))
        parent = durable(parent.join(up, "group_id", "left").select("ordinal", F.coalesce("up", "group_id").alias("group_id"), F.col("up").isNotNull().alias("moved")))
        if parent.where("moved").isEmpty():
            return parent.select("ordinal", "group_id")
        parent = parent.drop("moved")


def resolve(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group: each conflict field's last value of a source better than the seed's, else its first value.

    Columns ordinal, name, source and whichever of the known fields are there; social_links may be a map.
    """
    rows = candidates.join(groups, "ordinal").withColumn("rank_", rank(F.col("source")))
    seed = rows.where("ordinal = group_id").select("group_id", F.col("rank_").alias("seed_rank"))
    rows = rows.join(seed, "group_id")
    have = set(candidates.columns)
    better = F.col("rank_") < F.col("seed_rank")
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("ordinal")))
    last = lambda c, ok: F.max_by(F.when(ok, F.col(c)), F.when(ok, F.col("ordinal")))
    own = F.col("ordinal") == F.col("group_id")
    out = [F.max(F.when(own, F.col(c))).alias(c) for c in ("name", "source") if c in have]
    out += [F.coalesce(last(c, filled(F.col(c)) & better), first(c, filled(F.col(c)))).alias(c) for c in CONFLICT if c in have]
    out += [first(c, F.coalesce(F.col(c).cast("string") != "", F.lit(False)) & F.coalesce(~F.col(c).cast("string").rlike(r"^0(\.0*)?$"), F.lit(False))).alias(c) for c in FILL if c in have]
    if {"lat", "lon"} <= have:
        pair = F.struct("lat", "lon")
        rows = rows.withColumn("pair_", pair)
        both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
        place = F.coalesce(first("pair_", both), last("pair_", F.col("lat").isNotNull() & ~own), F.max(F.when(own, F.col("pair_"))))
        out += [place["lat"].alias("lat"), place["lon"].alias("lon")]
    merged = rows.groupBy("group_id").agg(F.count("*").alias("members"), *out)
    if "social_links" in have:
        links = rows.select("group_id", "ordinal", F.explode("social_links").alias("k", "v")).groupBy("group_id", "k").agg(F.min_by("v", "ordinal").alias("v"))
        maps = links.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("social_links"))
        merged = merged.join(maps, "group_id", "left")
    return merged


def merge(candidates: DataFrame) -> DataFrame:
    return resolve(candidates, assign(candidates))


def first_seen(rows: DataFrame, keys: list[str], order: str = "ordinal") -> DataFrame:
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("rn_ = 1").drop("rn_")
