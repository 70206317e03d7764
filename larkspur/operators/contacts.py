"""One contact record of each site out of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import email, phone, url
from larkspur.functions.html import structured_record
from larkspur.functions.text import filled
from larkspur.operators.ordered import running

FIELDS = ["email", "phone", "website", "address", "hours"]
#: Characters of a site's pages that are kept as its text.
TEXT = 24_000


def _candidates(rows: DataFrame, values: str, same: Column, most: int) -> DataFrame:
    """(site, v, nth) of a site's distinct values in order of appearance, at most ``most``; same tells which are one value."""
    each = rows.select("site", "place", F.posexplode(values).alias("pos", "v"))
    first = each.groupBy("site", same.alias("same_")).agg(F.min(F.struct("place", "pos", "v")).alias("f"))
    nth = F.row_number().over(Window.partitionBy("site").orderBy("f.place", "f.pos"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("site", "same_", F.col("f.v").alias("v"), "nth")


def page_texts(pages: DataFrame, site: Column, place: str, html: str, most: int = TEXT) -> DataFrame:
    """(site, page_text): the first ``most`` characters of a site's non-empty pages put one below the other in order of place, which is distinct within a site.

    Where each page begins is a running sum of lengths; only pages that begin early enough are put together.
    """
    rows = pages.select(site.alias("site"), F.col(place).alias("place"), F.col(html).alias("h")).where("site is not null and site <> ''").where(filled(F.col("h")))
    begins = running(rows.select("site", "place", F.length("h").alias("n_")), ["site"], ["place"], F.col("n_") + 1, "begin_").where(F.col("begin_") < most).select("site", "place")
    some = rows.join(begins, ["site", "place"], "left_semi").select("site", "place", F.left("h", F.lit(most)).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "\n")
    return some.groupBy("site").agg(F.left(joined, F.lit(most)).alias("page_text"))


def site_contacts(pages: DataFrame, site: Column, place: str, html: str, country: str | None = None) -> DataFrame:
    """(site, email, phone, website, address, hours, description, social_links, email_candidates, phone_candidates, page_text).

    Pages of a site are looked at in order of ``place``; site is the host that addresses are compared with.
    A mailto link, else a protected address, is preferred among the found addresses, a tel link among the found
    numbers, else the best-ranked; structured data fill in what the text lacks, and the links it names win over
    those in the text. Null pages count as empty. Nothing is put together per site but candidates (at most 40
    and 30, the first ones) and the first values, so that a site with very many pages is no burden.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        site.alias("site"), F.col(place).alias("place"), email.collect_emails(h).alias("emails"), phone.collect_phones(h).alias("phones"),
        email.mailto(h).alias("mailto"), email.protected_address(h).alias("hidden"), phone.tel_link(h).alias("tel"),
        url.social_links(h).alias("links"), url.meta_description(h).alias("description"), structured_record(h).alias("s"),
    ).where("site is not null and site <> ''")
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("place", c.alias("v"))))["v"]
    heads = rows.groupBy("site").agg(
        first(F.col("mailto")).alias("mailto"), first(F.col("hidden")).alias("hidden"), first(F.col("tel")).alias("tel"), first(F.col("description")).alias("description"),
        *(first(F.nullif(f"s.{c}", F.lit(""))).alias(f"s_{c}") for c in FIELDS),
    )
    mails = _candidates(rows, "emails", F.col("v"), 40).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("e"))
    calls = _candidates(rows, "phones", phone.digits(F.col("v")), 30).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("p"))

    def links(column: str, name: str) -> DataFrame:
        each = rows.select("site", "place", F.explode(column).alias("k", "v"))
        one = each.groupBy("site", "k").agg(F.min(F.struct("place", "v"))["v"].alias("v"))
        return one.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))

    df = heads.join(page_texts(pages, site, place, html), "site", "left").join(mails, "site", "left").join(calls, "site", "left").join(links("links", "l"), "site", "left").join(links("s.social_links", "sl"), "site", "left")
    none = F.array().cast("array<string>")
    found = {k: F.coalesce(F.transform(k, lambda x: x["v"]), none) for k in ("e", "p")}
    df = df.withColumns(found)
    wanted = F.lower(F.trim(F.coalesce("mailto", "hidden")))
    top = email.first_best(F.col("e"), lambda v: email.score_email(v, F.col("site")))
    junk = email.domain(top).isin(email.DISPOSABLE) & email.local_part(top).rlike(f"(?i){email.PLACEHOLDER}")
    mail = F.coalesce(F.when(F.array_contains("e", wanted), wanted), F.when(~junk, top), "s_email")
    same = F.try_element_at(F.filter("p", lambda v: (phone.digits(v) == phone.digits(F.col("tel"))) & (phone.digits(F.col("tel")) != "")), F.lit(1))
    call = F.coalesce(same, phone.first_best(F.col("p"), lambda v: phone.score_phone(v, country)), "s_phone")
    empty = F.create_map().cast("map<string,string>")
    both = F.map_zip_with(F.coalesce("sl", empty), F.coalesce("l", empty), lambda k, a, b: F.coalesce(a, b))
    return df.select("site", mail.alias("email"), call.alias("phone"), F.coalesce("s_website", "site").alias("website"), F.col("s_address").alias("address"), F.col("s_hours").alias("hours"), "description", both.alias("social_links"), F.col("e").alias("email_candidates"), F.col("p").alias("phone_candidates"), F.coalesce("page_text", F.lit("")).alias("page_text"))
