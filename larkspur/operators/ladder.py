"""Entity resolution that goes on: later records join the groups that earlier ones made, without a second look at those.

What a group is to later records is small: which group each key belongs to, and for each field
the first value and the last one of a better source. Both are kept as tables; a step reads
the new records, these tables, and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import filled
from larkspur.operators.resolve import CONFLICT, FILL, keyed, rank
from larkspur.session import durable


@dataclass
class Resolved:
    """keys (kind, value, group_id): whose a key is. groups: one row a group, members, seed rank and the parts of its fields."""

    keys: DataFrame
    groups: DataFrame
    links: DataFrame | None
    fields: list[str]


def _assign(records: DataFrame, keys: DataFrame | None) -> DataFrame:
    """(ordinal, group_id) of keyed records: by the first of name, phone and site that an earlier record has.

    A key of the stored table leads straight to its group; among the new records pointers to first holders are followed by doubling.
    """
    three = F.filter(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"k_{k}").alias("value")) for i, k in enumerate(("name", "phone", "site")))), lambda k: k["value"].isNotNull())
    pairs = durable(records.select("ordinal", F.explode_outer(three).alias("key")).select("ordinal", "key.kind", "key.value"))
    firsts = pairs.where("value is not null").groupBy("kind", "value").agg(F.min("ordinal").alias("first"))
    firsts = firsts.withColumn("old", F.lit(None).cast("long")) if keys is None else firsts.join(keys.withColumnRenamed("group_id", "old"), ["kind", "value"], "left")
    led = F.when(F.col("old").isNotNull() | (F.col("first") < F.col("ordinal")), F.struct("kind", "old", "first"))
    leads = pairs.join(firsts, ["kind", "value"], "left").groupBy("ordinal").agg(F.min(led).alias("lead"))
    # A pointer is final where it names an old group or the record itself; else it names an earlier new record.
    parent = durable(leads.select("ordinal", F.coalesce("lead.old", "lead.first", "ordinal").alias("group_id"), (F.col("lead.old").isNotNull() | F.col("lead").isNull()).alias("final")))
    while not parent.where("not final").isEmpty():
        up = parent.select(F.col("ordinal").alias("group_id"), F.col("group_id").alias("up"), F.col("final").alias("up_final"))
        open_ = parent.where("not final").drop("final").join(up, "group_id").select("ordinal", F.col("up").alias("group_id"), F.col("up_final").alias("final"))
        parent = durable(parent.where("final").unionByName(open_))
    return durable(pairs.join(parent.select("ordinal", "group_id"), "ordinal"))


def extend(before: Resolved | None, records: DataFrame) -> Resolved:
    """The state after more records, whose ordinals are all larger than those of the records before."""
    named = keyed(records)
    pairs = _assign(named, before.keys if before else None)
    groups = pairs.select("ordinal", "group_id").distinct()
    claimed = pairs.where("value is not null").groupBy("kind", "value").agg(F.min_by("group_id", "ordinal").alias("group_id"))
    keys = durable(before.keys.unionByName(claimed.join(before.keys, ["kind", "value"], "left_anti"))) if before else durable(claimed)
    fields = [c for c in (*CONFLICT, *FILL) if c in records.columns]
    has_place, has_links = {"lat", "lon"} <= set(records.columns), "social_links" in records.columns
    rows = named.join(groups, "ordinal").withColumn("rank_", rank(F.col("source")))
    own = F.col("ordinal") == F.col("group_id")
    seeds = rows.where(own).select("group_id", F.col("rank_").alias("seed_rank"))
    if before:
        seeds = seeds.unionByName(before.groups.select("group_id", "seed_rank"))
    rows = rows.join(seeds, "group_id")
    better = F.col("rank_") < F.col("seed_rank")
    known = lambda c: filled(F.col(c)) if c in CONFLICT else F.coalesce(F.col(c).cast("string") != "", F.lit(False)) & F.coalesce(~F.col(c).cast("string").rlike(r"^0(\.0*)?$"), F.lit(False))
    at = lambda ok, value: F.when(ok, F.struct(F.col("ordinal").alias("o"), value.alias("v")))
    parts = {"own": F.max(F.when(own, F.struct(F.col("name").alias("name"), F.col("source").alias("source"))))}
    parts |= {f"first_{c}": F.min(at(known(c), F.col(c))) for c in fields} | {f"last_{c}": F.max(at(known(c) & better, F.col(c))) for c in fields if c in CONFLICT}
    if has_place:
        pair = F.struct("lat", "lon")
        parts |= {"first_place": F.min(at(F.col("lat").isNotNull() & F.col("lon").isNotNull(), pair)), "last_place": F.max(at(F.col("lat").isNotNull() & ~own, pair)), "own_place": F.max(F.when(own, pair))}
    made = rows.groupBy("group_id").agg(F.count("*").alias("members"), F.max("seed_rank").alias("seed_rank"), *(v.alias(k) for k, v in parts.items()))
    if before:
        both = before.groups.unionByName(made)
        merged = {k: (F.min if k.startswith("first_") else F.max)(k).alias(k) for k in parts}
        made = both.groupBy("group_id").agg(F.sum("members").alias("members"), F.max("seed_rank").alias("seed_rank"), *merged.values())
    links = None
    if has_links:
        links = rows.select("group_id", "ordinal", F.explode("social_links").alias("k", "v"))
        links = links.unionByName(before.links) if before and before.links is not None else links
        links = durable(links.groupBy("group_id", "k").agg(F.min_by("v", "ordinal").alias("v"), F.min("ordinal").alias("ordinal")))
    return Resolved(keys, durable(made), links, [*fields, *(["lat", "lon"] if has_place else [])])


def finish(state: Resolved) -> DataFrame:
    """One row a group, as resolve() gives it for all records so far."""
    fields = [c for c in state.fields if c not in ("lat", "lon")]
    value = lambda c: F.coalesce(*([F.col(f"last_{c}.v")] if c in CONFLICT else []), F.col(f"first_{c}.v")).alias(c)
    place = F.coalesce("first_place.v", "last_place.v", "own_place") if "lat" in state.fields else None
    spots = [] if place is None else [place["lat"].alias("lat"), place["lon"].alias("lon")]
    out = state.groups.select("group_id", "members", "own.name", "own.source", *map(value, fields), *spots)
    if state.links is not None:
        maps = state.links.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("social_links"))
        out = out.join(maps, "group_id", "left")
    return out


def climb(tiers: Iterable[DataFrame], limit: int, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
    """(rows that keep() leaves of the groups so far, tiers read): tiers are read in order until that many are left.

    A tier is not read before it is needed, and never again; ordinals rise from tier to tier. Without tiers there is nothing to resolve (ValueError).
    """
    state, left = None, None
    for used, tier in enumerate(tiers, 1):
        state = extend(state, tier)
        left = keep(finish(state))
        if left.limit(limit).count() >= limit:
            break
    if left is None:
        raise ValueError("no tiers")
    return left, used


def in_tiers(records: DataFrame, tier: str, tiers: int) -> list[DataFrame]:
    """records as one frame a tier, 0 to tiers - 1, their ordinals made to rise from tier to tier."""
    return [records.where(F.col(tier) == i).withColumn("ordinal", F.col("ordinal") + F.lit(i) * F.lit(1 << 40)).drop(tier) for i in range(tiers)]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
