import base64
import json

from pyspark.sql import functions as F

from larkspur.functions import geo, html
from larkspur.functions import time as clock
from larkspur.operators import enrich
from larkspur.sources import places


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("v")).first().v


def test_cards_links_and_phrases(spark):
    r = one(spark, "Sakura Dental\n4.5\n(1,120)\nDentist\nOpen", places.card_text)
    assert tuple(r) == ("Sakura Dental", 4.5, 1120, "Dentist")
    assert tuple(one(spark, "A\n4,5\n4.5", places.card_text)) == ("A", None, None, "4,5")  # the category ends a card
    assert tuple(one(spark, "A\n4\n120\n(7)", places.card_text)) == ("A", 4.0, None, "120")
    packed = base64.urlsafe_b64encode(b"https://a.co/x").decode().rstrip("=")
    assert one(spark, f"https://b.com/ck/a?x=1&amp;u={packed}", places.unwrapped_link) == "https://a.co/x"
    assert one(spark, "//d.com/l/?uddg=https%3A%2F%2Fa.co%2F", places.unwrapped_link) == "https://a.co/"
    assert one(spark, "mailto:x", places.unwrapped_link) is None
    got = one(spark, "bakery", lambda c: places.query_phrases(c, F.lit("Lahore"), F.lit("PK")))
    assert got[0] == "bakery Lahore PK" and "bakeries in Lahore" in got and len(got) == 8


def test_places(spark):
    f = {"features": [{"properties": {"name": "A", "address_line1": "x", "address_line2": "x", "datasource": {"raw": {"mobile": "1"}}, "opening_hours": {"weekday_text": ["Mon 9", " "]}}, "geometry": {"coordinates": [2.0, 1.0]}}, {"properties": {"name": ""}}]}
    df = spark.createDataFrame([(json.dumps(f),)], "p string")
    r = places.geojson_places(df, "p", "City").collect()
    assert [(x.name, x.phone, x.address, x.lat, x.lon, x.hours) for x in r] == [("A", "1", "x", 1.0, 2.0, "Mon 9")]
    b = {"businesses": [{"name": "A", "phone": "1-2", "latitude": 5.0}, {"name": "a", "phone": "12"}, {"phone": "3"}]}
    r = places.businesses(spark.createDataFrame([(0, json.dumps(b))], "ordinal int, p string"), "p").collect()
    assert [(x.name, x.lat) for x in r] == [("A", 5.0)]
    rows = [(0, "A", "1-2", None, None, "s"), (1, "B", "12", "e@x.co", "w", "t"), (2, "C", None, None, None, None)]
    r = places.fill_by_phone(spark.createDataFrame(rows, "ordinal long, name string, phone string, email string, website string, address string"), 5).collect()
    assert [(x.name, x.email, x.address) for x in r] == [("A", "e@x.co", "s"), ("C", None, None)]
    look = spark.createDataFrame([("Street 1,  Lahore", 1.0, 2.0), ("lahore", 3.0, 4.0)], "key string, lat double, lon double")
    recs = spark.createDataFrame([("street 1", "Lahore", None, None), ("q", "Lahore", None, None), (None, "Rome", None, None), ("s", "Lahore", 9.0, 9.0)], "address string, city string, lat double, lon double")
    assert sorted((r.lat or 0) for r in places.geocoded(recs, look).collect()) == [0, 1.0, 3.0, 9.0]


def test_mail(spark):
    df = spark.createDataFrame([([("Subject", "a"), ("From", "f"), ("subject", "b")],)], "h array<struct<name:string,value:string>>")
    assert df.select(places.headers(F.col("h")).alias("m")).first().m == {"from": "f", "subject": "b"}
    assert one(spark, base64.urlsafe_b64encode("é?>".encode()).decode(), places.mail_body) == "é?>"
    page, more = places.mailbox_page(spark.range(5), [F.desc("id")], 2, 2)
    assert [r.id for r in page.collect()] == [2, 1] and more


def test_enrichment(spark):
    items = spark.createDataFrame([(1, "", None, "s.co", None), (2, "a@b.co", "1", None, "addr")], "k int, email string, phone string, website string, address string").withColumn("name", F.lit("n"))
    found = spark.createDataFrame([(1, None, "5", "x.co", "Road 1", ["noreply@s.co", "hi@s.co"])], "k int, email string, phone string, website string, address string, email_candidates array<string>")
    r = {x.k: x for x in enrich.fill_gaps(items, found, "k").collect()}
    assert (r[1].email, r[1].phone, r[1].website, r[1].address, r[1].enrichment_source) == ("hi@s.co", "5", "https://s.co", "Road 1", "website, website_email")
    assert (r[2].email, r[2].enrichment_source, r[2].completeness) == ("a@b.co", None, 70)
    lead = spark.createDataFrame([(1, "", "1", None, {"x": "1"}), (2, "a", "1", "w", None)], "lead_id int, email string, phone string, website string, social_links map<string,string>")
    patch = spark.createDataFrame([(1, "n@x.co", "2", None, {"x": "9", "y": "2"})], "lead_id int, email string, phone string, website string, social_links map<string,string>")
    r = {x.lead_id: x for x in enrich.apply_to_leads(lead, patch).collect()}
    assert (r[1].email, r[1].phone, r[1].social_links, r[1].changed, r[2].changed) == ("n@x.co", "1", {"x": "1", "y": "2"}, True, False)
    b = enrich.booking(spark.createDataFrame([("Meeting booked! Reference: AB1. Lead: Ann Lee. Email: a@b.co. Date: 2024-01-02 10:00",), ("hi",)], "content string")).collect()
    assert [(x.reference, x.lead, x.email, x.company, x.date) for x in b] == [("AB1", "Ann Lee", "a@b.co", None, "2024-01-02 10:00")]
    n = enrich.canonical_niche(spark.createDataFrame([("Dentist",), ("plastic surgeon",), ("Underwater Basket",)], "n string"), "n", ["dental", "dentist", "plastic surgery"])
    assert {x.n: x.niche_key for x in n.collect()} == {"Dentist": "dentist", "plastic surgeon": "plastic surgery", "Underwater Basket": "underwater basket"}


def test_html_address_and_slots(spark):
    assert one(spark, "a&#64;b &eacute;", html.unescape) == "a@b é"
    assert one(spark, "no entity", html.unescape) == "no entity"
    assert [one(spark, a, geo.plausible_address) for a in ("12 Main Road", "great clinic", "call 12 now", None)] == [True, False, False, False]
    hours = F.create_map(F.lit("monday"), F.array(F.lit("09:00"), F.lit("10:00")), F.lit("tuesday"), F.array(F.lit("09:00"), F.lit("10:00")))
    got = spark.range(1).select(F.transform(clock.open_slots(F.lit("2024-01-15 08:30:00").cast("timestamp"), hours, "UTC"), lambda s: s.cast("string")).alias("s")).first().s
    assert got[:4] == ["2024-01-15 09:00:00", "2024-01-15 09:30:00", "2024-01-16 09:00:00", "2024-01-16 09:30:00"]


def test_site_contacts(spark):
    from larkspur.operators.contacts import site_contacts

    ld = {"@graph": [{"contactPoint": {"telephone": "+1 202 555 0111"}}], "url": "https://shop.co/", "address": {"streetAddress": "1 Road", "postalCode": "7"}, "openingHours": "Mo 9", "sameAs": ["https://www.facebook.com/old", "https://www.facebook.com/ld", 3]}
    pages = [
        ("shop.co", 2, '<a href="mailto:Sales@shop.co">m</a> noreply@shop.co x@gmail.com https://facebook.com/text https://x.com/me'),
        ("shop.co", 1, "info@shop.co call 202-555-0199 <script type='application/ld+json'>" + json.dumps(ld) + "</script><script type='application/ld+json'>{bad</script>"),
        ("b.co", 1, None), ("c.co", 1, "owner@c.co me@gmail.com"), (None, 1, "a@b.co"),
    ]
    got = {r.site: r for r in site_contacts(spark.createDataFrame(pages, "site string, n int, html string"), F.col("site"), "n", "html", "US").collect()}
    r = got["shop.co"]
    assert r.email == "sales@shop.co" and r.email_candidates == ["info@shop.co", "sales@shop.co", "noreply@shop.co", "x@gmail.com"]
    assert (r.website, r.address, r.hours) == ("https://shop.co/", "1 Road, 7", "Mo 9")
    assert r.social_links == {"facebook": "https://www.facebook.com/ld", "twitter": "https://x.com/me"}
    assert r.phone == "+1 202 555 0111" and set(r.phone_candidates) == {"202-555-0199", r.phone} and set(got) == {"shop.co", "b.co", "c.co"}
    assert r.page_text == pages[1][2] + "\n" + pages[0][2] and got["b.co"].page_text == "" and got["c.co"].page_text == pages[3][2]
    assert got["b.co"].email is None and got["b.co"].phone is None and got["c.co"].email == "owner@c.co"


def test_page_texts_are_cut(spark):
    from larkspur.operators.contacts import page_texts

    rows = [("s", i, c * n) for i, (c, n) in enumerate([("a", 9), ("b", 0), ("c", 3), ("d", 50), ("e", 4)])] + [("t", 1, None)]
    df = spark.createDataFrame(rows, "site string, n int, html string")
    assert {r.site: r.page_text for r in page_texts(df, F.col("site"), "n", "html", 20).collect()} == {"s": "aaaaaaaaa\nccc\ndddddd"}


def test_fallback_listings_and_points(spark):
    a, b = (spark.createDataFrame([(n,) for n in names], "name string") for names in (["Ay"], ["ay ", "Be", "be"]))
    assert sorted(r.name.lower() for r in places.with_fallback(a, b, 10).collect()) == ["ay", "be"]
    assert places.with_fallback(a, b, 2).count() == 1
    poi = spark.createDataFrame([("A", "1.5", "2"), ("B", "x", "2"), (" ", "1", "2")], "n string, la string, lo string")
    assert [(r.name, r.lat, r.lon) for r in places.poi_records(poi, "n", "la", "lo", "n").collect()] == [("A", 1.5, 2.0)]
