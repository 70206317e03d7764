"""Records of a workspace: guarded updates, conversations, account choice, retention, plans, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import filled, subject


def guarded_update(leads: DataFrame, updates: DataFrame, within: str = "workspace_id", key: str = "lead_id") -> DataFrame:
    """(key, email, blocked) of updates (key, within, new_email): blocked where another lead of the workspace has that address.

    The leads are first grouped by address, so that an address in very many of them is one row.
    """
    address = F.lower(F.trim("email"))
    held = leads.where(filled(F.col("email"))).groupBy(within, address.alias("a_")).agg(F.min(key).alias("low_"), F.max(key).alias("high_"))
    asked = updates.withColumn("a_", F.lower(F.trim("new_email"))).join(held, [within, "a_"], "left")
    other = F.coalesce((F.col("low_") != F.col(key)) | (F.col("high_") != F.col(key)), F.lit(False))
    own = leads.select(key, "email")
    return asked.withColumn("blocked", other).join(own, key).select(key, F.when(F.col("blocked"), F.col("email")).otherwise(F.col("new_email")).alias("email"), "blocked")


def find_or_create(conversations: DataFrame, asked: DataFrame, fill: tuple[str, ...] = ("thread_id", "customer_name")) -> DataFrame:
    """asked (account, customer_email, customer_name, subject, thread_id, ordinal) with conversation and ``created``; subject, and the fields to fill as they are in the end.

    A customer of an account has one conversation, found by address, case and white space around it aside: the oldest
    (created_at, conversation), else one that the first ask creates, all later asks being of that one; conversation is then null. Of the fields
    to fill, one that the conversation lacks is taken from the first ask that has it. Only a new conversation gets a subject: the first ask's, "Re: "
    before it, or one made of the name. Asks without an address are of no conversation and come out with created null. Each customer is one row of
    partial sums before any ask is looked at, so that one with very many asks is joined, not gathered.
    """
    key = F.lower(F.trim("customer_email"))
    keyed = asked.withColumn("key_", F.nullif(key, F.lit("")))
    old = conversations.where(F.col("customer_email").isNotNull()).withColumn("key_", F.lower("customer_email"))
    old = old.groupBy("account", "key_").agg(F.min_by(F.struct("conversation", *fill), F.struct("created_at", "conversation")).alias("old_"))
    who = F.coalesce(F.nullif("customer_name", F.lit("")), F.trim("customer_email"))
    first = F.struct("ordinal", subject(F.trim("subject"), who).alias("subject"))
    asks = keyed.where("key_ is not null").groupBy("account", "key_").agg(F.min(first).alias("first_"), *(F.min(F.when(filled(F.col(c)), F.struct("ordinal", c))).alias(f"new_{c}_") for c in fill))
    known = asks.join(old, ["account", "key_"], "left").withColumnRenamed("account", "a_").withColumnRenamed("key_", "k_")
    rows = keyed.drop("subject", *fill).join(known, (F.col("account") == F.col("a_")) & (F.col("key_") == F.col("k_")), "left")
    none = F.col("old_").isNull()
    values = [F.coalesce(F.when(filled(F.col(f"old_.{c}")), F.col(f"old_.{c}")), F.col(f"new_{c}_.{c}")).alias(c) for c in fill]
    created = F.when(F.col("k_").isNotNull(), none & (F.col("ordinal") == F.col("first_.ordinal")))
    return rows.select(*(c for c in asked.columns if c not in ("subject", *fill)), F.col("old_.conversation").alias("conversation"), created.alias("created"), F.when(none, F.col("first_.subject")).alias("subject"), *values)


def account_choice(accounts: DataFrame, within: str, active: Column, order: list[str | Column]) -> DataFrame:
    """One account of each workspace: the first active one, else the first."""
    w = Window.partitionBy(within).orderBy(F.coalesce(active, F.lit(False)).desc(), *order)
    return accounts.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


def inbox_page(conversations: DataFrame, messages: DataFrame, key: str, updated: str, last: list[str | Column], page: int, size: int) -> DataFrame:
    """A page of conversations, latest change first, each with its last message: the page is cut before messages are joined."""
    cut = conversations.orderBy(F.desc(updated), F.desc(key)).offset((page - 1) * size).limit(size)
    some = messages.join(cut.select(key), key, "left_semi")
    newest = some.withColumn("rn_", F.row_number().over(Window.partitionBy(key).orderBy(*last))).where("rn_ = 1").drop("rn_")
    return cut.join(newest, key, "left")


def revocable(admins: DataFrame, within: str, active: Column) -> DataFrame:
    """admins with ``blocked``: whether taking this one's rights away would leave no active one."""
    n = admins.where(active).groupBy(within).agg(F.count("*").alias("n_"))
    return admins.join(n, within, "left").withColumn("blocked", active & (F.coalesce("n_", F.lit(0)) <= 1)).drop("n_")


def with_plan(workspaces: DataFrame, plans: DataFrame, plan: str, quotas: list[str]) -> DataFrame:
    """workspaces with the quotas of their plan, an administrator's own figures (own_*) before it."""
    both = workspaces.join(plans.select(plan, *(F.col(q).alias(f"plan_{q}") for q in quotas)), plan, "left")
    return both.withColumns({q: F.coalesce(f"own_{q}", f"plan_{q}") for q in quotas}).drop(*(f"{x}_{q}" for x in ("own", "plan") for q in quotas))


def in_order(sources: list[DataFrame]) -> DataFrame:
    """All rows of the sources with their source_rank, missing columns null: what the first source has comes first."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def tier_tags(rows: DataFrame, tier: str, city: str, niche: str, asked_city: str, asked_niche: str) -> DataFrame:
    """rows with result_city, is_fallback_city (any tier but the first) and original_niche (where another one was searched)."""
    other = F.lower(niche) != asked_niche.lower()
    return rows.withColumns({"result_city": F.coalesce(F.nullif(city, F.lit("")), F.lit(asked_city)), "is_fallback_city": F.col(tier) > 0, "original_niche": F.when(other, asked_niche)})


FIELDS = ["email", "phone", "website", "address"]


def enrichment_batch(leads: DataFrame, plain: DataFrame, browser: DataFrame, lookup: DataFrame, key: str = "lead_id", order: str = "ordinal", most: int = 10) -> DataFrame:
    """leads with their empty fields filled, ``via`` (website or google_maps), ``enrichment_status`` and ``enrichment_error``.

    plain has a row (key, blocked, FIELDS) a site that was read: nothing found is a row of nulls, and a site that could not be
    read at all is blocked. Only a blocked site's lead gets the browser's row (key, FIELDS). Sites count for leads with a name. A lead with a name, no
    phone and no website gets the lookup's row, but only the first ``most`` such leads are looked up, found or not. Leads without a name fail.
    """
    fields = [c for c in FIELDS if c in leads.columns]
    named, sited = filled(F.col("name")), filled(F.col("name")) & filled(F.col("website"))
    side = lambda df, name, *more: df.select(key, F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields)).alias(name), *more)
    any_ = lambda s: F.greatest(F.lit(False), *(filled(F.col(f"{s}.{c}")) for c in fields))
    df = leads.join(side(plain, "plain_", F.coalesce("blocked", F.lit(False)).alias("blocked_")), key, "left").join(side(browser, "browser_"), key, "left")
    asked = leads.where(named & ~filled(F.col("phone")) & ~filled(F.col("website"))).orderBy(order).limit(most).select(key)
    df = df.join(side(lookup, "lookup_").join(F.broadcast(asked), key), key, "left")
    site = F.when(sited & ~F.col("blocked_") & any_("plain_"), F.col("plain_")).when(sited & F.col("blocked_") & any_("browser_"), F.col("browser_"))
    df = df.withColumn("site_", site).withColumn("found_", F.coalesce("lookup_", "site_"))
    via = F.when(F.col("lookup_").isNotNull(), "google_maps").when(F.col("site_").isNotNull(), "website")
    new = {c: F.when(filled(F.col(c)) | ~filled(F.col(f"found_.{c}")), F.col(c)).otherwise(F.col(f"found_.{c}")) for c in fields}
    out = df.withColumns({**new, "via": via, "enrichment_status": F.when(named, "done").otherwise("failed"), "enrichment_error": F.when(~named, "missing name")})
    return out.select(*leads.columns, "via", "enrichment_status", "enrichment_error")


def offered(asked: Column, slots: Column, seconds: int = 1800) -> Column:
    """Whether a time lies less than so many seconds from one of the slots that were offered."""
    return F.coalesce(F.exists(slots, lambda s: F.abs(F.unix_micros(s) - F.unix_micros(asked)) < seconds * 1_000_000), F.lit(False))


def since(rows: DataFrame, day: str, today: Column) -> DataFrame:
    """What a daily clean-up leaves: rows of today and later; rows without a day stay."""
    return rows.where(F.coalesce(F.col(day) >= today, F.lit(True)))


def presence(*columns: str) -> Column:
    """How many of the columns are filled."""
    return sum((F.when(filled(F.col(c)), 1).otherwise(0) for c in columns), F.lit(0))


def member_of(permission: str, grants: Column) -> Column:
    return F.coalesce(F.array_contains(grants, permission), F.lit(False))


# How many rows a source is asked for.
OVERSAMPLE, FETCH_MOST = 3, 150


def fetch_limit(wanted: Column) -> Column:
    return F.least(F.greatest(wanted, F.lit(1)) * OVERSAMPLE, F.lit(FETCH_MOST))


# Words of names that tell nothing about whose site a host is.
GENERIC = [
    "dental", "dentist", "dentistry", "clinic", "clinics", "care", "center", "centre", "hospital", "medical", "med", "dr", "doctor", "doctors", "lab", "labs", "laboratory", "opd", "group", "associates", "associate",
    "services", "service", "and", "the", "of", "co", "ltd", "limited", "pvt", "private", "smile", "smiles", "best", "top", "near", "me", "in", "karachi", "lahore", "islamabad", "pakistan",
]


def own_site(name: Column, href: Column, generic: list[str] = GENERIC) -> Column:
    """Whether the host of href holds a distinctive word of the name, three letters a-z or more; a name of generic words only accepts any."""
    host = F.lower(F.regexp_extract(href, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    words = F.array_except(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z]{3,}"), F.lit(0)), F.array(*map(F.lit, generic)))
    return (F.size(words) == 0) | F.exists(words, lambda w: F.contains(host, w))


def append_log(events: DataFrame, path: str) -> None:
    """Events added to a log of Parquet files; earlier ones stay."""
    events.write.mode("append").parquet(path)


def lead_read(leads: DataFrame, metadata: str = "lead_metadata") -> DataFrame:
    """leads as clients read them: what the metadata (a JSON text, or null) says beside the columns, and empty where it says nothing of links."""
    m = F.col(metadata)
    said = lambda k: F.get_json_object(m, f"$.{k}")
    empty = F.create_map().cast("map<string,string>")
    links = F.coalesce(F.from_json(said("social_links"), "map<string,string>"), empty)
    return leads.withColumns({
        "scoring_failed": F.coalesce(said("scoring_failed").isin("true", "1"), F.lit(False)), "social_links": links, "completeness": said("completeness").try_cast("int"),
        **{k: said(k) for k in ("enrichment_status", "enrichment_source", "last_enriched_at", "description", "hours")},
    }).drop(metadata)


def workspaces_of(members: DataFrame, workspaces: DataFrame, user: Column, key: str = "workspace_id") -> DataFrame:
    """The workspaces that a user is an active member of."""
    return workspaces.join(members.where(user & F.col("is_active")).select(key), key, "left_semi")
