"""Place directories, map cards, search results and mailboxes as rows; payloads are columns, nothing is fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import filled


def _first(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def card_text(c: Column) -> Column:
    """(name, rating, review_count, category) of a result card's lines.

    The first line is the name. Then, line by line, the first like 4.5 is the rating, the first like
    (1,234) the review count, and the first other line of 2 to 40 characters the category, which ends the card.
    """
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("review_count"), F.lit(None).cast("string").alias("category"))

    def step(a: Column, x: Column) -> Column:
        open_ = a["category"].isNull()
        rated = open_ & a["rating"].isNull() & x.rlike(r"^\d(?:\.\d)?$")
        counted = open_ & ~rated & a["review_count"].isNull() & x.rlike(r"^\([\d,]+\)$")
        named = open_ & ~rated & ~counted & F.length(x).between(2, 40)
        return F.struct(
            F.when(rated, x.try_cast("double")).otherwise(a["rating"]).alias("rating"),
            F.when(counted, F.regexp_replace(x, "[^0-9]", "").try_cast("int")).otherwise(a["review_count"]).alias("review_count"),
            F.when(named, x).otherwise(a["category"]).alias("category"),
        )

    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda a: F.struct(F.get(lines, F.lit(0)).alias("name"), a["rating"].alias("rating"), a["review_count"].alias("review_count"), a["category"].alias("category")))


def poi_records(df: DataFrame, name: str, lat: str, lon: str, address: str) -> DataFrame:
    """Points of interest with a name and numeric coordinates, the rest left out."""
    out = df.withColumns({"name": F.trim(name), "lat": F.col(lat).try_cast("double"), "lon": F.col(lon).try_cast("double"), "address": F.col(address)})
    return out.where(filled(F.col("name")) & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def with_fallback(first: DataFrame, spare: DataFrame, limit: int) -> DataFrame:
    """first, and where it holds fewer than half the limit (one at least) also spare rows of names (lower-cased) it lacks."""
    key = F.lower(F.trim("name"))
    few = first.limit(max(limit // 2, 1)).agg((F.count("*") < max(limit // 2, 1)).alias("few_"))
    more = spare.withColumn("key_", key).dropDuplicates(["key_"]).join(first.select(key.alias("key_")).distinct(), "key_", "left_anti")
    wanted = few.where("few_").select(F.lit(1).alias("one_"))
    return first.unionByName(more.drop("key_").withColumn("one_", F.lit(1)).join(wanted, "one_", "left_semi").drop("one_"))


def geojson_places(df: DataFrame, payload: str, city: str, source: str = "geoapify") -> DataFrame:
    """Named features with every phone key tried in turn, address lines or street tags, and opening hours as one text."""
    props = "name:string,lat:double,lon:double,address_line1:string,address_line2:string,phone:string,mobile:string,website:string,datasource:struct<raw:map<string,string>>,opening_hours:struct<weekday_text:array<string>>"
    schema = f"struct<features:array<struct<properties:struct<{props}>,geometry:struct<coordinates:array<double>>>>>"
    f = df.select(F.posexplode(F.from_json(payload, schema)["features"]).alias("ordinal", "f"))
    p, raw, at = F.col("f.properties"), F.col("f.properties.datasource.raw"), F.col("f.geometry.coordinates")
    tag = lambda k: F.try_element_at(raw, F.lit(k))
    lines = F.array_distinct(F.filter(F.array(p["address_line1"], p["address_line2"]), filled))
    street = F.concat_ws(", ", _first(tag("housenumber")), _first(tag("street")))
    fallback = F.concat_ws(", ", F.nullif(street, F.lit("")), F.coalesce(_first(tag("city"), tag("addr:city")), F.lit(city)))
    out = f.select(
        F.col("ordinal").cast("long").alias("ordinal"), F.trim(_first(p["name"], tag("name"))).alias("name"),
        _first(tag("contact:phone"), tag("phone"), tag("mobile"), tag("contact:mobile"), tag("fax"), p["phone"], p["mobile"]).alias("phone"),
        _first(tag("contact:website"), tag("website"), p["website"]).alias("website"), _first(tag("contact:email"), tag("email")).alias("email"),
        F.when(F.size(lines) > 0, F.array_join(lines, ", ")).otherwise(fallback).alias("address"),
        F.coalesce(p["lat"], F.get(at, F.lit(1))).alias("lat"), F.coalesce(p["lon"], F.get(at, F.lit(0))).alias("lon"),
        F.nullif(F.array_join(F.filter(F.transform(p["opening_hours"]["weekday_text"], lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit("")).alias("hours"), F.lit(source).alias("source"),
    )
    return out.where(filled(F.col("name")))


def businesses(df: DataFrame, payload: str, source: str = "bizdata") -> DataFrame:
    """Named records of an aggregator's answers, once per lower-cased name and phone digits, first answer first (column ordinal of df)."""
    schema = "struct<businesses:array<struct<name:string,phone:string,email:string,website:string,address:string,lat:double,latitude:double,lon:double,longitude:double,category:string>>>"
    b = df.select("ordinal", F.posexplode(F.from_json(payload, schema)["businesses"]).alias("place", "b")).where(filled(F.col("b.name")))
    key = F.concat_ws("|", F.lower(F.trim("b.name")), F.regexp_replace(F.coalesce("b.phone", F.lit("")), "[^0-9]", ""))
    w = Window.partitionBy("key_").orderBy("ordinal", "place")
    b = b.withColumn("key_", key).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1")
    return b.select("ordinal", "place", "b.name", "b.phone", "b.email", "b.website", "b.address", F.coalesce("b.lat", "b.latitude").alias("lat"), F.coalesce("b.lon", "b.longitude").alias("lon"), "b.category", F.lit(source).alias("source"))


def fill_by_phone(records: DataFrame, limit: int) -> DataFrame:
    """Directory records of equal phone digits as one, e-mail, website and address from the first that has them; the first so many."""
    key = F.regexp_replace(F.coalesce("phone", F.lit("")), "[^0-9]", "")
    key = F.when(key != "", key).otherwise(F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    fills = [F.min_by(F.when(filled(F.col(c)), F.col(c)), F.when(filled(F.col(c)), F.col("ordinal"))).alias(c) for c in ("email", "website", "address")]
    return records.groupBy(key.alias("k_")).agg(F.min("ordinal").alias("ordinal"), F.min_by("name", "ordinal").alias("name"), F.min_by("phone", "ordinal").alias("phone"), *fills).drop("k_").orderBy("ordinal").limit(limit)


def geocoded(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """records with lat and lon from a lookup (key, lat, lon) by address and city, else by city; known places stay.

    Each distinct text is looked up once, under its lower-cased form with single spaces.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    known = lookup.select(norm(F.col("key")).alias("k"), F.struct("lat", "lon").alias("p")).groupBy("k").agg(F.first("p", ignorenulls=True).alias("p"))
    df = records.withColumns({"a_": norm(F.concat_ws(", ", "address", "city")), "c_": norm(F.col("city"))})
    df = df.join(known.toDF("a_", "pa_"), "a_", "left").join(known.toDF("c_", "pc_"), "c_", "left")
    missing = F.col("lat").isNull() | F.col("lon").isNull()
    got = F.coalesce("pa_", "pc_")
    return df.withColumns({"lat": F.when(missing, got["lat"]).otherwise(F.col("lat")), "lon": F.when(missing, got["lon"]).otherwise(F.col("lon"))}).drop("a_", "c_", "pa_", "pc_")


def query_phrases(niche: Column, city: Column, country: Column) -> Column:
    """Ways to ask for a niche in a city, singular and plural, without repeats."""
    n = F.trim(niche)
    plural = F.when((F.length(n) <= 2) | n.endswith("s"), n).when(n.endswith("y") & (F.length(n) > 3), F.concat(F.left(n, F.length(n) - 1), F.lit("ies"))).otherwise(F.concat(n, F.lit("s")))
    forms = lambda x: [F.concat_ws(" ", x, city, country), F.concat_ws(" ", x, city), F.concat(x, F.lit(" in "), city, F.lit(", "), country), F.concat(x, F.lit(" in "), city)]
    return F.array_distinct(F.transform(F.array(*forms(n), *forms(plural)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))))


def unwrapped_link(href: Column) -> Column:
    """The target of a search result's redirect, or the link itself; null if that is no web address."""
    h = F.replace(href, F.lit("&amp;"), F.lit("&"))
    param = lambda k: F.nullif(F.regexp_extract(h, rf"[?&]{k}=([^&]+)", 1), F.lit(""))
    packed = F.translate(param("u"), "-_", "+/")
    padded = F.rpad(packed, (F.ceil(F.length(packed) / 4) * 4).cast("int"), "=")
    plain = F.decode(F.unbase64(F.when(packed.rlike("^[A-Za-z0-9+/]+$") & (F.length(packed) % 4 != 1), padded)), "UTF-8")
    target = F.when(F.contains(h, F.lit("uddg=")), F.coalesce(param("uddg"), h)).when(F.contains(h, F.lit("ck/a")), F.when(plain.rlike("^https?://"), plain).otherwise(h)).when(F.contains(h, F.lit("/url?q=")), F.coalesce(param("q"), h)).otherwise(h)
    target = F.trim(F.coalesce(F.try_url_decode(target), target))
    target = F.when(target.startswith("//"), F.concat(F.lit("https:"), target)).otherwise(target)
    return F.when(target.rlike("^https?://"), target)


def headers(c: Column) -> Column:
    """Mail headers (array of name, value) by lower-cased name; of repeated ones the last."""
    names = F.transform(c, lambda h: F.lower(h["name"]))
    last = F.filter(c, lambda h, i: F.size(F.array_remove(F.transform(F.slice(names, i + 2, F.size(names)), lambda n: F.when(n == F.lower(h["name"]), 1).otherwise(0)), 0)) == 0)
    return F.map_from_entries(F.transform(last, lambda h: F.struct(F.lower(h["name"]), h["value"])))


def mail_body(c: Column) -> Column:
    return F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8")


def mailbox_page(messages: DataFrame, order: list, page: int, size: int) -> tuple[DataFrame, bool]:
    """A page of messages, and whether there are more."""
    start = (max(1, page) - 1) * size
    return messages.orderBy(*order).offset(start).limit(size), messages.limit(start + size + 1).count() > start + size
