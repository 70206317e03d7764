"""Payloads made of the tables, read by the sources: what comes out must be what went in, which the SQL takes straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import email, geo, phone, text, url
from larkspur.functions import time as clock
from larkspur.functions.people import people
from larkspur.operators import enrich, nearby, outreach, quality_gate, records, upsert
from larkspur.plans.base import query, t
from larkspur.plans.views import LEADS_SQL, leads
from larkspur.sources import payloads, places


def _expr(df, *columns: str):
    """Columns as expressions that SQL has alike, but for its name of texts."""
    return df.selectExpr(*(c.replace("varchar", "string") for c in columns))


# ---- Answers of map services ----------------------------------------------------------------------------------------

_SHOP = {"name": "case when s_suppkey % 14 = 0 then concat('EN ', s_name) when s_suppkey % 7 = 0 then concat('店', s_name) else s_name end", "phone": "case when s_suppkey % 2 = 0 then concat('+1 555 ', cast(1000000 + s_suppkey as varchar)) when s_suppkey % 3 = 0 then concat('03', cast(10000000 + s_suppkey as varchar)) end",
         "email": "case when s_suppkey % 4 = 3 then concat('Shop', cast(s_suppkey as varchar), '@x.org') end", "website": "case when s_suppkey % 5 = 0 then concat('https://s', cast(s_suppkey as varchar), '.org') end", "street": "case when s_suppkey % 4 = 1 then concat(cast(s_suppkey as varchar), ', High Street') end", "lat": "cast(s_suppkey % 90 as double)", "lon": "cast(s_suppkey % 180 as double) / 4"}
_SHOPS = "s as (select s_suppkey, s_nationkey, " + ", ".join(f"{v} as {k}" for k, v in _SHOP.items()) + " from supplier)"


def _shops(spark, d):
    return _expr(t(spark, d, "supplier"), "s_suppkey", "s_nationkey", *(f"{v} as {k}" for k, v in _SHOP.items()))


def _joined(rows, each, key: str):
    """One text a key of each row's piece, in order of the suppliers."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", each.alias("e"))), lambda a, b: (a["s_suppkey"] - b["s_suppkey"]).cast("int")), lambda x: x["e"]).alias("e"))


@query(f"with {_SHOPS} select name, phone, email, website, lat, lon, case when street is not null then street || ', Town' end as address, 'openstreetmap' as source from s where not starts_with(name, '店') and (phone is not null or email is not null or website is not null or street is not null)")
def map_elements(spark, d):
    s = _shops(spark, d)
    k = F.col("s_suppkey")
    tags = F.map_filter(F.create_map(
        F.lit("name"), F.when(k % 14 == 0, "店").otherwise(F.col("name")), F.lit("name:en"), F.when(k % 14 == 0, F.col("name")), F.lit("phone"), F.when(k % 2 == 0, F.col("phone")), F.lit("contact:mobile"), F.when(k % 2 == 1, F.col("phone")),
        F.lit("contact:email"), F.col("email"), F.lit("website"), F.col("website"), F.lit("addr:housenumber"), F.when(k % 4 == 1, k.cast("string")), F.lit("addr:street"), F.when(k % 4 == 1, "High Street")), lambda n, v: v.isNotNull())
    spot = F.struct("lat", "lon")
    element = F.struct(F.when(k % 2 == 0, F.col("lat")).alias("lat"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.when(k % 2 == 1, spot).alias("center"), tags.alias("tags"))
    answers = _joined(s, element, "s_nationkey").select(F.to_json(F.struct(F.concat("e", F.slice("e", 1, 3)).alias("elements"))).alias("p"))
    return payloads.poi(answers, "p", "Town").select("name", "phone", "email", "website", "lat", "lon", "address", "source")


@query(f"with {_SHOPS} select trim(name) as name, phone, website, email, case when s_suppkey % 3 = 0 then coalesce(street || ', ', '') || 'Town' when s_suppkey % 3 = 1 then 'Line ' || s_suppkey else 'Line ' || s_suppkey || ', Other' end as address, lat, lon, case when s_suppkey % 2 = 0 then 'Mon 9; Tue 10' end as hours from s where s_suppkey % 9 <> 0")
def feature_places(spark, d):
    s, k = _shops(spark, d), F.col("s_suppkey")
    raw = F.map_filter(F.create_map(F.lit("name"), F.when(k % 2 == 1, F.col("name")), F.lit("contact:phone"), F.when(k % 4 == 0, F.col("phone")), F.lit("mobile"), F.when(k % 4 == 3, F.col("phone")), F.lit("contact:email"), F.col("email"), F.lit("website"), F.when(k % 2 == 0, F.col("website")), F.lit("housenumber"), F.when(k % 4 == 1, k.cast("string")), F.lit("street"), F.when(k % 4 == 1, "High Street")), lambda n, v: v.isNotNull())
    line = F.concat(F.lit("Line "), k)
    props = F.struct(
        F.when(k % 9 == 0, F.lit("")).when(k % 2 == 0, F.concat(F.lit(" "), "name")).alias("name"), F.when(k % 2 == 0, F.col("lat")).alias("lat"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.when(k % 3 != 0, line).alias("address_line1"), F.when(k % 3 == 1, line).when(k % 3 == 2, "Other").alias("address_line2"),
        F.when(k % 4 == 2, F.col("phone")).alias("phone"), F.when(k % 4 == 1, F.col("phone")).alias("mobile"), F.when(k % 2 == 1, F.col("website")).alias("website"), F.struct(F.when(k % 9 != 0, raw).alias("raw")).alias("datasource"), F.struct(F.when(k % 2 == 0, F.array(F.lit(" Mon 9"), F.lit(" "), F.lit("Tue 10"))).alias("weekday_text")).alias("opening_hours"))
    feature = F.struct(props.alias("properties"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    answers = _joined(s, feature, "s_nationkey").select(F.to_json(F.struct(F.col("e").alias("features"))).alias("p"))
    return places.geojson_places(answers, "p", "Town").select("name", "phone", "website", "email", "address", "lat", "lon", "hours")


@query(f"with {_SHOPS} select name, phone, website, lat, lon, s_suppkey % 90 as rank from s where name is not null")
def aggregator_answers(spark, d):
    s, k = _shops(spark, d), F.col("s_suppkey")
    record = F.struct("name", "phone", "website", F.when(k % 2 == 0, F.col("lat")).alias("lat"), F.when(k % 2 == 1, F.col("lat")).alias("latitude"), F.when(k % 2 == 0, F.col("lon")).alias("lon"), F.when(k % 2 == 1, F.col("lon")).alias("longitude"))
    again = F.struct(F.upper("name").alias("name"), F.regexp_replace("phone", " ", "-").alias("phone"), F.lit("later").alias("website"), F.lit(0.0).alias("lat"), F.lit(None).cast("double").alias("latitude"), F.lit(0.0).alias("lon"), F.lit(None).cast("double").alias("longitude"))
    first = _joined(s, record, "s_nationkey").select(F.col("s_nationkey").alias("ordinal"), F.to_json(F.struct(F.col("e").alias("businesses"))).alias("p"))
    later = _joined(s, again, "s_nationkey").select((F.col("s_nationkey") + 100).alias("ordinal"), F.to_json(F.struct(F.col("e").alias("businesses"))).alias("p"))
    return places.businesses(first.unionAll(later), "p").select("name", "phone", "website", "lat", "lon", F.col("lat").cast("long").alias("rank"))


# ---- Pages of directories -------------------------------------------------------------------------------------------


@query(f"with {_SHOPS} select name, phone, street as address, 'directory' as source from s where phone is not null")
def listing_pages(spark, d):
    marker = F.coalesce(F.concat(F.lit("<i class='map-marker'></i> <span class=a>"), "street", F.lit("</span>")), F.lit(""))
    card = F.concat(F.lit('<div class="card listing-card x"><h2 class=t><b>'), "name", F.lit("</b></h2><a href='tel:"), F.coalesce("phone", F.lit("12")), F.lit("'>call</a>"), marker, F.lit("</div>"))
    pages = _joined(_shops(spark, d).withColumn("phone", F.replace("phone", F.lit(" "), F.lit("-"))), card, "s_nationkey").select(F.concat(F.lit("<html>"), F.array_join("e", "\n"), F.lit("</html>")).alias("h"))
    return payloads.listing_cards(pages, "h").select("name", F.when(F.col("phone").startswith("+"), F.replace("phone", F.lit("-"), F.lit(" "))).otherwise(F.col("phone")).alias("phone"), "address", "source")


@query(f"with {_SHOPS} select lat, lon, name from s")
def map_bubbles(spark, d):
    bubble = F.struct("lat", F.col("lon").alias("lng"), F.concat(F.lit("<b>"), "name", F.lit("</b>")).alias("html"))
    pages = _joined(_shops(spark, d), bubble, "s_nationkey").select(F.concat(F.lit("<script>window.mapBubbles = "), F.to_json("e"), F.lit(";</script>")).alias("h"))
    return payloads.bubbles(pages, "h").select("lat", "lon", "name")


@query(f"with {_SHOPS} select name, phone, lower(email) as email, website, case when street is not null then street || ', Town' end as address, lat, lon from s where s_suppkey % 6 <> 5")
def structured_businesses(spark, d):
    s, k = _shops(spark, d), F.col("s_suppkey")
    block = F.struct(
        F.when(k % 6 == 5, "Person").otherwise("Restaurant").alias("@type"), "name", F.when(k % 2 == 0, F.col("phone")).otherwise("").alias("telephone"), F.when(k % 2 == 1, F.col("phone")).alias("phone"), "email", F.coalesce("website", F.lit("ftp://x")).alias("url"),
        F.when(F.col("street").isNotNull(), F.struct(F.col("street").alias("streetAddress"), F.lit("Town").alias("addressLocality"))).alias("address"), F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("geo"))
    code = F.when(k % 3 == 0, F.to_json(block)).when(k % 3 == 1, F.to_json(F.array(block))).otherwise(F.to_json(F.struct(F.array(block).alias("@graph"))))
    pages = s.select(F.concat(F.lit("<p><script type='application/ld+json'>"), code, F.lit("</script>")).alias("h"))
    return payloads.json_ld(pages, "h").select("name", "phone", "email", "website", "address", "lat", "lon")


@query("""select p_partkey, p_name as name, case when p_partkey % 3 > 0 then cast(p_size % 10 as double) / 2 end as rating, case when p_partkey % 2 = 0 then p_partkey + 1000 end as review_count, case when p_partkey % 5 > 0 then p_brand end as category from part""")
def result_cards(spark, d):
    p, k = t(spark, d, "part"), F.col("p_partkey")
    half = F.format_string("%.1f", (F.col("p_size") % 10).cast("double") / 2)
    card = F.concat_ws("\n", F.concat(F.lit(" "), "p_name"), F.when(k % 3 > 0, half), F.when(k % 2 == 0, F.concat(F.lit("("), F.format_number(k + 1000, 0), F.lit(")"))), F.lit(" "), F.when(k % 5 > 0, F.col("p_brand")), F.when(k % 5 > 0, "4.9"))
    got = p.select("p_partkey", places.card_text(card).alias("c"))
    return got.select("p_partkey", "c.name", "c.rating", "c.review_count", "c.category")


@query(f"with {_SHOPS}, p as (select s_suppkey, 'https://maps.x/place/@1,2/data=!3d' || lat || '!4d-' || lon as u, lat, lon from s) select s_suppkey, lat, -lon as lon from p where s_suppkey % 3 > 0 union all select s_suppkey, null, null from s where s_suppkey % 3 = 0")
def place_addresses(spark, d):
    s = _shops(spark, d)
    u = F.concat(F.lit("https://maps.x/place/@1,2/data=!3d"), F.when(F.col("s_suppkey") % 3 > 0, F.col("lat").cast("string")).otherwise("x"), F.lit("!4d-"), F.col("lon").cast("string"))
    return s.select("s_suppkey", payloads.place_url(u).alias("p")).select("s_suppkey", "p.lat", "p.lon")


@query(f"with {_SHOPS}, k as (select *, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') as d from (select s_suppkey, name, '+1 ' || (s_suppkey % 40) as phone, email, website, street from s)) select min(s_suppkey) as ordinal, arg_min(name, s_suppkey) as name, arg_min(email, s_suppkey) filter (where email <> '') as email, arg_min(website, s_suppkey) filter (where website <> '') as website, arg_min(street, s_suppkey) filter (where street <> '') as address from k group by d order by 1 limit 30")
def directory_by_phone(spark, d):
    s = _shops(spark, d)
    rows = s.select(F.col("s_suppkey").alias("ordinal"), "name", F.concat(F.when(F.col("s_suppkey") % 2 == 0, "+1 ").otherwise("1-"), F.col("s_suppkey") % 40).alias("phone"), "email", "website", F.col("street").alias("address"))
    return places.fill_by_phone(rows, 30).select("ordinal", "name", "email", "website", "address")


@query(f"""with {_SHOPS}, l as (select lower(n_name) as city, min(cast(n_nationkey as double)) as lat, min(cast(n_nationkey as double) + 50) as lon from nation group by 1), r as (select s_suppkey, case when s_suppkey % 3 = 0 then lat end as la, case when s_suppkey % 3 = 0 then lon end as lo, n_nationkey, n_name, s_suppkey % 2 as odd from s join nation on n_nationkey = s_nationkey)
select s_suppkey, coalesce(la, case when odd = 1 then 1000.0 + n_nationkey else cast(n_nationkey as double) end) as lat, coalesce(lo, case when odd = 1 then 2000.0 + n_nationkey else cast(n_nationkey as double) + 50 end) as lon from r""")
def geocoded_records(spark, d):
    n = t(spark, d, "nation")
    c = n.select(F.lower("n_name").alias("key"), F.col("n_nationkey").cast("double").alias("lat"), (F.col("n_nationkey") + 50).cast("double").alias("lon"))
    a = n.select(F.concat(F.lit("1  High street, "), "n_name").alias("key"), (F.col("n_nationkey") + 1000).cast("double").alias("lat"), (F.col("n_nationkey") + 2000).cast("double").alias("lon"))
    s = _shops(spark, d).join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    known = F.col("s_suppkey") % 3 == 0
    rows = s.select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 1, "1 HIGH Street").otherwise("nowhere").alias("address"), F.concat("n_name", F.lit(" ")).alias("city"), F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"))
    return places.geocoded(rows.withColumn("city", F.trim("city")), c.unionAll(a)).select("s_suppkey", "lat", "lon")


@query(f"with {_SHOPS} select s_suppkey, trim(name) as name, lat, lon from s where s_suppkey % 5 > 0 and s_suppkey % 6 > 0")
def poi_rows(spark, d):
    s, k = _shops(spark, d), F.col("s_suppkey")
    rows = s.select("s_suppkey", F.when(k % 5 == 0, " ").otherwise(F.concat("name", F.lit(" "))).alias("n"), F.when(k % 6 == 0, "x").otherwise(F.col("lat").cast("string")).alias("la"), F.col("lon").cast("string").alias("lo"), F.lit("a").alias("adr"))
    return places.poi_records(rows, "n", "la", "lo", "adr").select("s_suppkey", "name", "lat", "lon")


# ---- Search and mail ------------------------------------------------------------------------------------------------


@query("""with p as (select p_partkey, lower(split_part(p_type, ' ', 1)) as n from part), q as (select *, case when length(n) <= 2 or n like '%s' then n when n like '%y' and length(n) > 3 then left(n, length(n) - 1) || 'ies' else n || 's' end as m from p),
a as (select p_partkey, list_distinct([n || ' Lahore PK', n || ' Lahore', n || ' in Lahore, PK', n || ' in Lahore', m || ' Lahore PK', m || ' Lahore', m || ' in Lahore, PK', m || ' in Lahore']) as l from q) select p_partkey, array_to_string(list_sort(l), '|') as phrases, len(l) as n from a""")
def search_phrases(spark, d):
    n = F.lower(F.element_at(F.split("p_type", " "), 1))
    got = t(spark, d, "part").select("p_partkey", places.query_phrases(F.concat(n, F.lit(" ")), F.lit("Lahore"), F.lit("PK")).alias("l"))
    return got.select("p_partkey", F.array_join(F.array_sort("l"), "|").alias("phrases"), F.size("l").cast("long").alias("n"))


@query("select page_id, case when page_id % 5 = 4 then null else url end as target from pages")
def search_links(spark, d):
    u, k = F.col("url"), F.col("page_id")
    packed = F.translate(F.base64(u.cast("binary")), "+/=\r\n", "-_")
    link = F.when(k % 5 == 0, F.concat(F.lit("//d.com/l/?uddg="), F.url_encode(u), F.lit("&amp;rut=1"))).when(k % 5 == 1, F.concat(F.lit("https://b.com/ck/a?p=1&amp;u="), packed)).when(k % 5 == 2, F.concat(F.lit("/url?q="), F.url_encode(u), F.lit("&sa=U"))).when(k % 5 == 3, u).otherwise(F.concat(F.lit("mailto:"), k))
    return t(spark, d, "pages").select("page_id", places.unwrapped_link(link).alias("target"))


@query("select o_orderkey, 'S ' || o_orderpriority as subject, 'c' || o_custkey || '@x.org' as sender, 'C ' || o_custkey as name, 'Text é ' || o_orderstatus as body from orders")
def mail_parts(spark, d):
    o = t(spark, d, "orders")
    head = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    h = F.array(head("Subject", F.lit("old")), head("FROM", F.concat(F.lit('"C '), "o_custkey", F.lit('" <C'), "o_custkey", F.lit("@x.org>"))), head("subject", F.concat(F.lit("S "), "o_orderpriority")))
    code = F.translate(F.base64(F.encode(F.concat(F.lit("Text é "), "o_orderstatus"), "UTF-8")), "+/", "-_")
    got = o.select("o_orderkey", places.headers(h).alias("h"), places.mail_body(code).alias("body")).withColumn("s", text.sender(F.col("h")["from"]))
    return got.select("o_orderkey", F.col("h")["subject"].alias("subject"), F.col("s.email").alias("sender"), F.col("s.name").alias("name"), "body")


@query("select o_orderkey, o_orderdate, (select count(*) from orders) > 60 as more from orders order by o_orderdate desc, o_orderkey limit 20 offset 40")
def mailbox_third_page(spark, d):
    page, more = places.mailbox_page(t(spark, d, "orders"), [F.desc("o_orderdate"), "o_orderkey"], 3, 20)
    return page.select("o_orderkey", "o_orderdate", F.lit(more).alias("more"))


@query("""select cast(o_custkey as varchar) as account, 'statuses' as kind, 'm' || o_orderkey as provider_id, case o_orderstatus when 'F' then 'read' when 'O' then 'sent' else 'failed' end as body from orders where o_orderkey % 2 = 0
union all select cast(o_custkey as varchar), 'messages', 'm' || o_orderkey, 'hi ' || o_orderpriority from orders where o_orderkey % 3 = 0""")
def webhook_items(spark, d):
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    said = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "sent").otherwise("failed")
    name = F.concat(F.lit("m"), k)
    value = F.struct(F.struct(F.col("o_custkey").cast("string").alias("phone_number_id")).alias("metadata"), F.when(k % 2 == 0, F.array(F.struct(name.alias("id"), said.alias("status")))).alias("statuses"), F.when(k % 3 == 0, F.array(F.struct(name.alias("id"), F.struct(F.concat(F.lit("hi "), "o_orderpriority").alias("body")).alias("text")))).alias("messages"))
    hooks = o.select(F.to_json(F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes"))).alias("entry"))).alias("p"))
    return payloads.flatten_webhook(hooks, "p").select("account", "kind", "provider_id", "body")


# ---- Contacts -------------------------------------------------------------------------------------------------------


@query("""select s_suppkey, 'me' || s_suppkey || '@shop.org' as mailto, case when s_suppkey % 2 = 0 then 'hi' || s_suppkey || '@shop.org' end as hidden, case when s_suppkey % 3 > 0 then '+1-555-' || (1000000 + s_suppkey) end as tel, case when s_suppkey % 4 = 0 then 'About ' || s_name when s_suppkey % 4 = 1 then 'Og ' || s_name end as description, 'https://www.facebook.com/s' || s_suppkey as facebook, case when s_suppkey % 2 = 1 then 'https://x.com/y' || s_suppkey end as twitter from supplier""")
def page_contacts(spark, d):
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")
    plain = F.concat(F.lit("hi"), k, F.lit("@shop.org"))
    at = F.transform(F.sequence(F.lit(1), F.length(plain)), lambda i: F.lower(F.lpad(F.hex(F.ascii(F.substr(plain, i, F.lit(1))).bitwiseXOR(F.lit(0x5A))), 2, "0")))
    meta = F.when(k % 4 == 0, F.concat(F.lit("<meta name='description' content='About "), "s_name", F.lit("'>"))).when(k % 4 == 1, F.concat(F.lit("<META property=\"og:description\" content=\" Og "), "s_name", F.lit("\">"))).otherwise("")
    h = F.concat(meta, F.lit('<a href="mailto:Me'), k, F.lit('%40shop.org?subject=x">m</a> <a href="https://www.facebook.com/s'), k, F.lit('">f</a> '), F.when(k % 2 == 1, F.concat(F.lit("see https://x.com/y"), k, F.lit("), https://x.com/z "))).otherwise(""),
                 F.when(k % 2 == 0, F.concat(F.lit('<a data-cfemail="5a'), F.array_join(at, ""), F.lit('">'))).otherwise(""), F.when(k % 3 > 0, F.concat(F.lit("<a href='tel:+1-555-"), k + 1000000, F.lit("'>"))).otherwise("<a href='tel:12'>"))
    links = url.social_links(h)
    return s.select("s_suppkey", email.mailto(h).alias("mailto"), email.protected_address(h).alias("hidden"), phone.tel_link(h).alias("tel"), url.meta_description(h).alias("description"), links["facebook"].alias("facebook"), links["twitter"].alias("twitter"))


_FORMS = "case c_custkey % 9 when 0 then '0300 ' || n when 1 then '+92 300 ' || n when 2 then '0092-300-' || n when 3 then '042-3' || n when 4 then '1111111111' when 5 then '123' when 6 then '(212) 555-' || right(n, 4) when 7 then '+44 20 7' || n else 'not a phone' end"


@query(f"""with n as (select c_custkey, cast(1000000 + c_custkey as varchar) as n from customer), f as (select *, {_FORMS} as raw from n)
select c_custkey, case c_custkey % 9 when 0 then '+92300' || n when 1 then '+92300' || n when 2 then '+92300' || n when 3 then '+92423' || n when 7 then '+44207' || n end as pk, case c_custkey % 9 when 6 then '+1212555' || right(n, 4) end as us, right(regexp_replace(raw, '[^0-9]', '', 'g'), 10) as merge_key, regexp_replace(raw, '\\s+', '', 'g') as stored, 'https://wa.me/' || regexp_replace(raw, '[^0-9]', '', 'g') as whatsapp from f""")
def phone_forms(spark, d):
    raw = F.expr(_FORMS)
    df = t(spark, d, "customer").select("c_custkey", F.format_string("%d", 1000000 + F.col("c_custkey")).alias("n")).withColumn("raw", raw)
    us = F.when(F.col("c_custkey") % 9 == 6, phone.normalize_phone(F.col("raw"), "US"))
    return df.select("c_custkey", phone.normalize_phone(F.col("raw"), "PK").alias("pk"), us.alias("us"), phone.merge_key(F.col("raw")).alias("merge_key"), phone.stored(F.col("raw")).alias("stored"), phone.chat_links(F.col("raw"))["whatsapp"].alias("whatsapp"))


@query("""with n as (select c_custkey, cast(1000000 + c_custkey as varchar) as n from customer) select c_custkey, '0300' || n || case when c_custkey % 2 = 0 then '|+92 21 ' || n else '' end as phones, case when c_custkey % 2 = 0 then '+92 21 ' || n else '0300' || n end as best from n""")
def phones_in_texts(spark, d):
    n = F.format_string("%d", 1000000 + F.col("c_custkey"))
    said = F.concat(F.lit("cache-bust=1786024520697 Call:0300"), n, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" or +92 21 "), n, F.lit(" or +92-21-"), n)).otherwise(" or 1234567"), F.lit(" 1111111111"))
    return t(spark, d, "customer").select("c_custkey", F.array_join(phone.collect_phones(said), "|").alias("phones"), phone.best_phone(said, "PK").alias("best"))


_MAILS = "case c_custkey % 8 when 0 then 'noreply@' when 1 then ' Info@' when 2 then 'yourname@' when 3 then 'j.doe' || c_custkey || '@' when 4 then 'mailer-x@' when 5 then 'x' || repeat('l', 64) || '@' when 6 then 'sales@' else 'admin@' end || case c_custkey % 5 when 0 then 'shop' || c_custkey || '.org' when 1 then 'mailinator.com' when 2 then 'state.gov' when 3 then 'shop.Org ' else 'nodot' end"


@query(f"""with m as (select c_custkey, {_MAILS} as raw, lower(trim({_MAILS})) as e from customer) select c_custkey, case when c_custkey % 8 in (1, 3, 6) and c_custkey % 5 in (0, 2, 3) then e end as valid,
case when e = 'me@shop' then 0 else case when c_custkey % 5 in (0, 3) then case when c_custkey % 5 = 3 then 40 else 0 end else 0 end + case when c_custkey % 5 = 1 then -40 else 0 end + case when c_custkey % 8 = 2 then -25 else 0 end + case when c_custkey % 8 in (0, 7) then -30 when c_custkey % 8 in (1, 6) then 10 else 0 end + case when c_custkey % 5 = 2 then -5 else 0 end end as score from m""")
def email_worth(spark, d):
    raw = F.expr(_MAILS)
    return t(spark, d, "customer").select("c_custkey", email.validate_email(raw).alias("valid"), email.score_email(F.trim(raw), F.lit("https://www.shop.org/x")).alias("score"))


@query("""with n as (select s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z]', '', 'g')) as f, lower(n_name) as raw, regexp_replace(lower(n_name), '[^a-z]', '', 'g') as l from supplier join nation on n_nationkey = s_nationkey)
select s_suppkey, f || '.' || l || '@x.org,' || f || l || '@x.org,' || left(f, 1) || l || '@x.org,' || left(f, 1) || '.' || l || '@x.org' as first_four from n""")
def predicted_addresses(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    return s.select("s_suppkey", F.array_join(F.slice(email.predicted(F.col("s_name"), F.col("n_name"), F.lit("X.org")), 1, 4), ",").alias("first_four"))


@query("select s_suppkey, 'Ann Lee=ann' || s_suppkey || '@x.org;Bob Ray=' as people from supplier")
def people_in_texts(spark, d):
    said = F.concat(F.lit("Ann Lee, head of unit "), "s_suppkey", F.lit(", Ann"), "s_suppkey", F.lit("@x.org. Bob Ray works here."))
    got = people(F.concat(said, F.lit("")))
    return t(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(got, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(p["email"], F.lit("")))), ";").alias("people"))


@query(f"""with {LEADS_SQL} select lead_id, case when lead_id % 3 = 0 then '12 ' || company || ' Road' when lead_id % 3 = 1 then 'great ' || company else 'call 12 now' end as address, lead_id % 3 = 0 as plausible, lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as somewhere from leads""")
def plausible_places(spark, d):
    k = F.col("lead_id") % 3
    a = F.when(k == 0, F.concat(F.lit("12 "), "company", F.lit(" Road"))).when(k == 1, F.concat(F.lit("great "), "company")).otherwise("call 12 now")
    return leads(spark, d).select("lead_id", a.alias("address"), geo.plausible_address(a).alias("plausible"), geo.somewhere(F.col("lat"), F.col("lon")).alias("somewhere"))


@query("select event_id, date_trunc('day', ts + interval 5 hours) - interval 5 hours as midnight, hour(ts) * 60 + minute(ts) as minutes from events")
def local_days(spark, d):
    utc = F.col("ts").cast("timestamp")
    return t(spark, d, "events").select("event_id", clock.local_midnight(utc).cast("timestamp_ntz").alias("midnight"), clock.minutes(F.date_format(utc, "HH:mm")).cast("long").alias("minutes"))


# ---- Outreach -------------------------------------------------------------------------------------------------------

_SENDS = "select o_custkey as lead_id, o_orderstatus <> 'F' as ok, o_orderdate as made, case when o_orderstatus = 'F' then repeat(o_orderpriority, 60) end as error, o_orderkey from orders"


@query(f"""with {LEADS_SQL}, s as ({_SENDS}), g as (select lead_id, min(made) filter (where ok) as sent, max(made) filter (where not ok) as failed from s group by 1)
select l.lead_id, case when sent is not null and status = 'New' then 'Contacted' else status end as status, sent as outreach_sent_at, failed is not null as failed from leads l left join g on g.lead_id = l.lead_id""")
def leads_after_sends(spark, d):
    sends = t(spark, d, "orders").select(F.col("o_custkey").alias("lead_id"), (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderstatus") == "F", F.repeat("o_orderpriority", 60)).alias("error"))
    got = outreach.apply_sends(leads(spark, d).withColumn("outreach_sent_at", F.lit(None).cast("timestamp_ntz")), sends)
    return got.select("lead_id", "status", "outreach_sent_at", F.coalesce(F.length("send_error") <= 500, F.lit(False)).alias("failed"))


@query(f"""with {LEADS_SQL}, b as (select c_nationkey as workspace_id, 'user' || c_custkey % 997 || '@mail' || c_custkey % 50 || '.example.org' as mail, c_name as name, o_orderdate as at, o_orderkey from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P'),
old as (select l.workspace_id, l.name, lower(l.email) as email from leads l where l.email is not null and exists (select 1 from b where b.workspace_id = l.workspace_id and b.mail = lower(l.email))),
new as (select workspace_id, arg_min(name, (b.at, cast(o_orderkey as varchar))) as name, mail as email from b where not exists (select 1 from leads l where l.workspace_id = b.workspace_id and lower(l.email) = b.mail) group by 1, 3) select workspace_id, name, email, 'Hot' as status from old union all select workspace_id, name, email, 'Hot' from new""")
def hot_after_bookings(spark, d):
    b = t(spark, d, "orders").where("o_orderstatus = 'P'").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mail = F.concat(F.lit("user"), F.col("c_custkey") % 997, F.lit("@mail"), F.col("c_custkey") % 50, F.lit(".example.org"))
    made = b.select(F.col("c_nationkey").alias("workspace_id"), F.col("o_orderkey").cast("string").alias("reference"), F.col("c_name").alias("name"), mail.alias("email"), F.col("o_orderdate").alias("at"))
    hot, _, _ = outreach.apply_bookings(leads(spark, d), made)
    return hot.select("workspace_id", "name", F.lower("email").alias("email"), "status")


@query("with a as (select distinct ts, event_type from events where user_id % 20 = 3 order by ts desc, event_type limit 100) select ts as created_at, event_type as stage from a")
def activity_replay(spark, d):
    a = t(spark, d, "events").select((F.col("user_id") % 20).cast("string").alias("workspace_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("stage"), F.col("event_id").cast("string").alias("detail"))
    return outreach.replay(a, "3").select("created_at", "stage")


@query("select 'Page ' || page_id as name, url as website, 'web_search' as source from pages where page_id % 3 > 0")
def web_candidates(spark, d):
    k = F.col("page_id")
    rows = t(spark, d, "pages").select(F.concat(F.lit("Page "), k, F.lit(" | Home")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("https://www.yelp.com/x"), k)).otherwise(F.col("url")).alias("url"))
    return outreach.web_results(rows, ["yelp.com"]).select("name", "website", "source")


@query(f"""with {LEADS_SQL}, p as (select o_custkey as lead_id, max(case when o_orderstatus = 'O' then 'n' || o_orderpriority end) as email, max(case when o_orderstatus = 'P' then '9' end) as phone from orders group by 1)
select l.lead_id, coalesce(nullif(l.email, ''), p.email) as email, coalesce(nullif(l.phone, ''), p.phone) as phone, (coalesce(l.email, '') = '' and p.email is not null) or (coalesce(l.phone, '') = '' and p.phone is not null) as changed from leads l left join p on p.lead_id = l.lead_id""")
def leads_after_enrichment(spark, d):
    none = F.lit(None).cast("map<string,string>")
    patch = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("lead_id")).agg(F.max(F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("n"), "o_orderpriority"))).alias("email"), F.max(F.when(F.col("o_orderstatus") == "P", "9")).alias("phone"))
    patch = patch.withColumns({"website": F.lit(None).cast("string"), "social_links": none})
    got = enrich.apply_to_leads(leads(spark, d).withColumn("social_links", none), patch)
    return got.select("lead_id", "email", "phone", "changed")


# ---- Texts and records ----------------------------------------------------------------------------------------------

_SENT = "case c_custkey % 6 when 0 then '\"' || c_name || '\" <C' || c_custkey || '@x.org>' when 1 then ' c' || c_custkey || '@x.org ' when 2 then c_name || ', c' || c_custkey || '@x.org' when 3 then '{\"displayName\": \"' || c_name || '\", \"mail\": \"m@x.org\"}' when 4 then c_name else '  ' end"


@query("""select c_custkey, case when c_custkey % 6 in (0, 2, 3, 4) then c_name when c_custkey % 6 = 1 then '' end as name, case c_custkey % 6 when 0 then 'C' || c_custkey || '@x.org' when 1 then 'c' || c_custkey || '@x.org' when 2 then 'c' || c_custkey || '@x.org' when 3 then 'm@x.org' when 4 then '' end as email from customer""")
def sender_forms(spark, d):
    got = t(spark, d, "customer").select("c_custkey", text.any_sender(F.expr(_SENT)).alias("s"))
    return got.select("c_custkey", "s.name", "s.email")


@query(
    """with p as (select p_partkey, lower(p_type) || ' o''neil''s ' || p_brand as raw from part) select p_partkey, array_to_string(list_transform(regexp_extract_all(raw, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '') as title, 'agent_' || left(sha1(raw), 8) as template, case when p_partkey % 2 = 0 then 'Name ' || p_partkey else '| x' end as business from p"""
)
def titles(spark, d):
    raw = F.concat(F.lower("p_type"), F.lit(" o'neil's "), "p_brand")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" Name "), "p_partkey", F.lit(" | Home"))).otherwise("| x")
    return t(spark, d, "part").select("p_partkey", text.title(raw).alias("title"), text.template_name(raw).alias("template"), text.clean_business_name(name).alias("business"))


@query("select n_nationkey, case upper(n_name) when 'CANADA' then 'ca' when 'FRANCE' then 'fr' when 'GERMANY' then 'de' when 'INDIA' then 'in' when 'SAUDI ARABIA' then 'sa' when 'UNITED KINGDOM' then 'uk' when 'UNITED STATES' then 'us' else '' end as code from nation")
def directory_country_codes(spark, d):
    return t(spark, d, "nation").select("n_nationkey", geo.country_code(F.col("n_name")).alias("code"))


@query("""with c as (select n_regionkey as country, n_nationkey as ordinal, n_name as name, cast(n_nationkey + 1 as double) as lat, cast(n_nationkey + 2 as double) as lon from nation), q as (select s_suppkey as id, s_suppkey % 5 as country, case s_suppkey % 4 when 0 then 'N' when 1 then ' ia ' when 2 then lower(left(n_name, 3)) else 'zz top' end as query from supplier join nation on n_nationkey = s_nationkey),
h as (select id, name, lat, lon, ordinal, case when starts_with(lower(name), lower(trim(query))) then 0 else 1 end as tier from q join c using (country) where length(trim(query)) >= 2 and contains(lower(name), lower(trim(query)))), b as (select *, min(tier) over (partition by id) as best from h),
r as (select *, row_number() over (partition by id order by ordinal) as place from b where tier = best) select id, name, lat, lon, cast(place as int) as place from r where place <= 2 union all select id, trim(query), 0.0, 0.0, 1 from q where length(trim(query)) >= 2 and id not in (select id from h)""")
def city_typeahead(spark, d):
    n = t(spark, d, "nation")
    c = n.select(F.col("n_regionkey").cast("string").alias("country"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).alias("lat"), (F.col("n_nationkey") + 2).alias("lon"))
    k = F.col("s_suppkey") % 4
    asked = t(spark, d, "supplier").join(n.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    asked = asked.select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).cast("string").alias("country"), F.when(k == 0, "N").when(k == 1, " ia ").when(k == 2, F.lower(F.left("n_name", F.lit(3)))).otherwise("zz top").alias("query"))
    return nearby.typeahead(c, asked, 2)


@query(f"""with {LEADS_SQL} select lead_id, lead_id % 4 = 0 as scoring_failed, case when lead_id % 2 = 0 then 1 else 0 end as links, case when lead_id % 4 <> 3 then lead_id % 101 end as completeness, case when lead_id % 4 <> 3 then 'done' end as enrichment_status, case when lead_id % 4 <> 3 then 'About ' || company end as description from leads""")
def leads_as_read(spark, d):
    k = F.col("lead_id")
    meta = F.to_json(F.struct((k % 4 == 0).alias("scoring_failed"), F.when(k % 2 == 0, F.create_map(F.lit("facebook"), F.lit("u"))).alias("social_links"), (k % 101).alias("completeness"), F.lit("done").alias("enrichment_status"), F.concat(F.lit("About "), "company").alias("description")))
    got = records.lead_read(leads(spark, d).withColumn("lead_metadata", F.when(k % 4 != 3, meta)))
    return got.select("lead_id", "scoring_failed", F.size("social_links").alias("links"), "completeness", "enrichment_status", "description")


@query("select n_nationkey as workspace_id, n_name from nation where n_nationkey in (select s_nationkey from supplier where s_suppkey % 10 = 3 and s_acctbal > 0)")
def workspaces_of_member(spark, d):
    members = t(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace_id"), (F.col("s_suppkey") % 10).alias("user_id"), (F.col("s_acctbal") > 0).alias("is_active"))
    w = t(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), "n_name")
    return records.workspaces_of(members, w, F.col("user_id") == 3)


@query("""with o as (select c_custkey as k, c_name as name, c_acctbal as v from customer), n as (select o_custkey as k, max(case when o_orderstatus = 'P' then 'patched' end) as name, max(o_totalprice) as v from orders group by 1) select coalesce(o.k, n.k) as k, coalesce(n.name, o.name) as name, coalesce(n.v, o.v) as v from o full join n on n.k = o.k""")
def patched_settings(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("v"))
    new = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.when(F.col("o_orderstatus") == "P", "patched")).alias("name"), F.max("o_totalprice").alias("v"))
    return upsert.upsert(old, new, ["k"], ["v"], patch=True)


@query("""with f as (select s_name as name from supplier where s_suppkey <= 3), s as (select s_name as name from supplier) select name from f union all select name from s where name not in (select name from f)""")
def listings_with_fallback(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    spare = s.select("name").unionAll(s.select(F.upper("name")))
    got = places.with_fallback(s.where("s_suppkey <= 3").select("name"), spare, 20)
    return got.select(F.concat(F.upper(F.left("name", F.lit(1))), F.lower(F.substring("name", F.lit(2), F.length("name")))).alias("name"))


@query("select event_id, event_type, user_id from events")
def stream_event_log(spark, d):
    """Events appended to a log of Parquet files by a stream, and the log read back."""
    import uuid

    from larkspur.session import shared_folder

    top = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    q = e.select("event_id", "event_type", "user_id").writeStream.format("parquet").option("path", f"{top}/log").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, event_type string, user_id long").parquet(f"{top}/log")


@query(f"""with {LEADS_SQL} select lead_id, name, case when lead_id % 3 = 0 then 'Dental Clinic' else company end as industry, case when lead_id % 4 > 0 then website end as website from leads""")
def cleaned_candidates(spark, d):
    k = F.col("lead_id")
    rows = leads(spark, d).select("lead_id", F.concat(F.lit(" "), "name", F.lit(" | Home")).alias("name"), F.when(k % 3 > 0, F.col("company")).alias("industry"), F.when(k % 4 == 0, F.concat(F.lit("https://biz.yelp.com/"), k)).otherwise(F.col("website")).alias("website"))
    return quality_gate.clean(rows, "dental clinic", ["yelp.com"])


@query("""with c as (select c_custkey, cast(1000000 + c_custkey as varchar) as n from customer) select c_custkey, case c_custkey % 4 when 0 then '+92300' || n when 1 then '+92300' || n when 2 then '+92' || n else null end as e164, case c_custkey % 4 when 0 then '+92300' || n when 1 then '+0300' || n when 2 then '+' || n else '+12' end as messages from c""")
def phones_for_messages(spark, d):
    n = F.format_string("%d", 1000000 + F.col("c_custkey"))
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("0092 (300) "), n)).when(k == 1, F.concat(F.lit("0300-"), n)).when(k == 2, n).otherwise("1 2")
    return t(spark, d, "customer").select("c_custkey", phone.normalize_e164(raw, F.lit("92")).alias("e164"), phone.for_messages(raw).alias("messages"))
