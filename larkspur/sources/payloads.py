"""Raw JSON and HTML payloads as candidate records. Nothing here touches a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import filled

POI = "struct<elements:array<struct<lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>>"
LATIN = r"^[\x00-\x7FÀ-ɏ\s,.\-/#&'()]+$"
BUSINESS = ["LocalBusiness", "Organization", "Store", "Restaurant", "Dentist", "MedicalBusiness", "ProfessionalService", "LegalService", "HealthAndBeautyBusiness"]


def _tag(tags: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(tags, F.lit(n)), F.lit("")) for n in names))


def poi(df: DataFrame, payload: str, city: str, source: str = "openstreetmap") -> DataFrame:
    """Map elements with a Latin name and some way to reach them, once per name and phone, in their order."""
    e = df.select(F.posexplode(F.from_json(payload, POI)["elements"]).alias("ordinal", "e"))
    t = F.col("e.tags")
    street = F.concat_ws(", ", _tag(t, "addr:housenumber"), _tag(t, "addr:street"))
    out = e.select(
        F.col("ordinal").cast("long").alias("ordinal"), _tag(t, "name:en", "name").alias("name"), _tag(t, "phone", "contact:phone", "contact:mobile").alias("phone"), _tag(t, "email", "contact:email").alias("email"),
        _tag(t, "website", "contact:website", "url").alias("website"), F.nullif(street, F.lit("")).alias("street"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"),
    )
    some = filled(F.col("phone")) | filled(F.col("email")) | filled(F.col("website")) | filled(F.col("street"))
    out = out.where(F.col("name").rlike(LATIN) & some)
    out = out.withColumn("key_", F.concat_ws("|", F.lower("name"), F.coalesce("phone", F.lit("")))).groupBy("key_").agg(F.min_by(F.struct(*out.columns), "ordinal").alias("r")).select("r.*")
    return out.withColumn("address", F.when(filled(F.col("street")), F.concat_ws(", ", "street", F.lit(city)))).drop("street").withColumn("source", F.lit(source))


def listing_cards(df: DataFrame, html: str, source: str = "directory") -> DataFrame:
    """Cards of a directory page that have a name and a phone of seven digits or more, once per name and phone."""
    cards = df.select(F.posexplode(F.split(html, r"(?i)(?=<div class=\"card listing-card)")).alias("ordinal", "card"))
    tags = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    out = cards.select(
        F.col("ordinal").cast("long").alias("ordinal"), tags(F.regexp_extract("card", r"(?is)<h2[^>]*>(.*?)</h2>", 1)).alias("name"), F.regexp_extract("card", "(?i)tel:([^\"'\\s]+)", 1).alias("phone"),
        F.nullif(tags(F.regexp_extract("card", r"(?is)map-marker.*?<span[^>]*>(.*?)</span>", 1)), F.lit("")).alias("address"),
    )
    out = out.where((F.col("name") != "") & (F.length(F.regexp_replace("phone", "[^0-9]", "")) >= 7))
    return out.groupBy(F.lower("name").alias("n_"), F.col("phone").alias("p_")).agg(F.min_by(F.struct(*out.columns), "ordinal").alias("r")).select("r.*").withColumn("source", F.lit(source))


def bubbles(df: DataFrame, html: str) -> DataFrame:
    """(lat, lon, name) of the map bubbles that a page embeds as JSON."""
    code = F.regexp_extract(html, r"(?s)window\.mapBubbles\s*=\s*(\[.*?\]);", 1)
    b = df.select(F.posexplode(F.from_json(code, "array<struct<lat:double,lng:double,html:string>>")).alias("ordinal", "b"))
    return b.select(F.col("ordinal").cast("long"), F.col("b.lat").alias("lat"), F.col("b.lng").alias("lon"), F.trim(F.regexp_replace("b.html", "<[^>]+>", " ")).alias("name"))


def json_ld(df: DataFrame, html: str) -> DataFrame:
    """Business blocks of a page's JSON-LD, lists and @graph unwrapped."""
    block = "struct<`@type`:string,name:string,telephone:string,phone:string,email:string,url:string,address:struct<streetAddress:string,addressLocality:string,addressRegion:string,postalCode:string,addressCountry:string>,geo:struct<latitude:double,longitude:double>,aggregateRating:struct<ratingValue:double,reviewCount:int>>"
    raw = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    each = df.select(F.posexplode(raw).alias("ordinal", "j"))
    whole = F.when(F.trim("j").startswith("["), F.from_json("j", f"array<{block}>")).when(F.get_json_object("j", "$.@graph").isNotNull(), F.from_json(F.get_json_object("j", "$.@graph"), f"array<{block}>")).otherwise(F.array(F.from_json("j", block)))
    b = each.select("ordinal", F.explode(whole).alias("b")).where(F.col("b.`@type`").isin(BUSINESS) & filled(F.col("b.name")))
    a = F.col("b.address")
    return b.select(
        F.col("ordinal").cast("long"), F.col("b.name").alias("name"), F.coalesce(F.nullif("b.telephone", F.lit("")), "b.phone").alias("phone"), F.lower("b.email").alias("email"), F.when(F.col("b.url").rlike("^https?://"), F.col("b.url")).alias("website"),
        F.nullif(F.concat_ws(", ", *(a[k] for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry"))), F.lit("")).alias("address"),
        F.col("b.geo.latitude").alias("lat"), F.col("b.geo.longitude").alias("lon"), F.col("b.aggregateRating.ratingValue").alias("rating"), F.col("b.aggregateRating.reviewCount").alias("review_count"),
    )


def place_url(c: Column) -> Column:
    """(lat, lon) from a map address that holds !3d and !4d."""
    got = lambda g: F.nullif(F.regexp_extract(c, r"!3d(-?\d+\.\d+)!4d(-?\d+\.\d+)", g), F.lit("")).try_cast("double")
    return F.struct(got(1).alias("lat"), got(2).alias("lon"))


def flatten_webhook(df: DataFrame, payload: str) -> DataFrame:
    """(account, kind, provider_id, body) of the statuses and messages of a nested webhook."""
    item = "struct<id:string,status:string,`from`:string,text:struct<body:string>>"
    schema = f"struct<entry:array<struct<changes:array<struct<value:struct<metadata:struct<phone_number_id:string>,statuses:array<{item}>,messages:array<{item}>>>>>>>"
    v = df.select(F.explode(F.from_json(payload, schema)["entry"]).alias("e")).select(F.explode("e.changes").alias("c")).select("c.value.*")
    some = lambda kind: F.transform(F.coalesce(kind, F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), x["id"].alias("provider_id"), F.coalesce(x["status"], x["text"]["body"]).alias("body")))
    return v.select(F.col("metadata.phone_number_id").alias("account"), F.explode(F.concat(some("statuses"), some("messages"))).alias("x")).select("account", "x.*")


def csv_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as texts: nulls empty, maps as "key: value; key: value"."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ") if kinds[c].startswith("map") else F.col(c).cast("string")
    return df.select(*(F.coalesce(cell(c), F.lit("")).alias(c) for c in columns))


def lead_csv(leads: DataFrame, path: str, columns: list[str]) -> None:
    """Leads as CSV with a header, cells as of csv_cells()."""
    csv_cells(leads, columns).write.mode("overwrite").csv(path, header=True, emptyValue="")
