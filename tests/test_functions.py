import pytest
from pyspark.sql import functions as F

from larkspur.functions import email, geo, phone, text, url
from larkspur.functions import time as clock


def values(spark, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]))))
    return [r[1] for r in sorted(df.select("i", column.alias("v")).collect())]


def one(spark, rows, f):
    return values(spark, [r if isinstance(r, tuple) else (r,) for r in rows], f(*(F.col(f"c{k}") for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1))))


def test_names(spark):
    got = one(spark, ["Sakura Dental Studio (Pvt) Ltd", "Sakura Dental Studio", None, "Homely Ltd."], text.normalize_name)
    assert got == ["sakuradentalstudio", "sakuradentalstudio", "", "homely"]
    assert one(spark, ["Bright Smile | Home", "| x", None], text.clean_business_name) == ["Bright Smile", "| x", None]
    assert one(spark, [("Sakura Dental", "sakura dental clinic"), ("", "a"), ("x", "y")], text.name_similarity) == [pytest.approx(2 / 3), 0.0, 0.0]
    assert one(spark, ["Re: hi", "hi", ""], lambda c: text.subject(c, F.lit("Ann"))) == ["Re: hi", "Re: hi", "Re: Conversation with Ann"]
    assert one(spark, ['"Ann B" <Ann@B.co>', "bob@c.co"], lambda c: text.sender(c)["email"]) == ["ann@b.co", "bob@c.co"]


def test_messages(spark):
    got = one(spark, ["<p>Hi&nbsp;<b>you</b></p>**bold** `x`<br>- one<blockquote>old", "Yes\nOn Mon, A wrote:\n> no"], text.clean_message)
    assert got == ["Hi you\nbold x\none", "Yes"]
    quoted = ["new\nFrom: a\nold", "ok<br>On Tue, Ai <a@b.c> wrote: <p>x", "hi <b>there</b> &amp; you<blockquote>old", "a\n-----Original Message-----\nb", "a\n_____\nb", "a\n > b", "\n> all"]
    assert one(spark, quoted, text.strip_quotes) == ["new", "ok", "hi there & you", "a", "a", "a", "\n> all"]


def test_messages_take_each_step_once(spark):
    df = spark.createDataFrame([("x",)], "c string").select(text.clean_message(F.col("c")).alias("a"), text.strip_quotes(F.col("c")).alias("b"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("</p"), plan.count("wrote"), plan.count("split(")) == (2, 2, 0)
    odd = ["On a <blockquote> wrote: b", "<a <blockquote> x", "a</p<br>>b", "a \xa0\r\n\t\r\n\x0b \nb\xa0c\r\rd", "<b></b>", "", None]
    assert one(spark, odd, text.clean_message) == ["On a", "<a", "a\nb", "a\n\nb c\n\nd", "", "", ""]
    assert one(spark, odd, text.strip_quotes) == ["On a", "<a", "a\nb", "a\n\nb c\n\nd", "<b></b>", "", None]


def test_entities_templates_and_maps(spark):
    assert one(spark, ["a &eacute; &#8217;&#x20ac; &notit; &amp;amp; &", "plain"], text.unescape) == ["a é ’€ ¬it; &amp; &", "plain"]
    assert one(spark, ["x\r\n \xa0\n\n\n y\t\n"], text.collapse_blank_lines) == ["x\n\ny"]
    assert one(spark, [("Hi Ann, dear Ann", " Ann Lee"), ("Hi", "Ann"), ("Hi", None)], text.with_parameter) == ["Hi {{1}}, dear {{1}}", "Hi {{1}}", "Hi {{1}}"]
    assert one(spark, ["one\n \ntwo"], text.paragraphs) == ['<div style="font-family:sans-serif"><p>one</p><p>two</p></div>']
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    row = spark.range(1).select(text.map_set(m, "a", F.lit("9")).alias("s"), text.map_set(m, "c", F.lit("3")).alias("n"), text.map_drop(m, "a").alias("d")).first()
    assert (row.s, row.n, row.d) == ({"a": "9", "b": "2"}, {"a": "1", "b": "2", "c": "3"}, {"b": "2"})


def test_senders_and_titles(spark):
    given = ['"Ann B" <Ann@B.co>', "Ann<a@b.co>", "a@b.co", "Ann, a@b.co", '{"sender_name": "Ann", "mail": "a@b.co"}', "{not json", "Ann", " ", None]
    got = [tuple(s) if s else None for s in one(spark, given, text.any_sender)]
    assert got == [("Ann B", "Ann@B.co"), ("Ann", "a@b.co"), ("", "a@b.co"), ("Ann", "a@b.co"), ("Ann", "a@b.co"), ("{not json", ""), ("Ann", ""), None, None]
    assert one(spark, ["o'neil's éCOLE 2nd", None], text.title) == ["O'Neil'S École 2Nd", None]
    assert one(spark, ["UAE", "Atlantis", None], geo.country_code) == ["ae", "", ""]


def test_whose_site(spark):
    from larkspur.operators import records

    cases = [("Inspire Dental Network", "https://inspiredental.net/x"), ("M. Sarwar Dental Clinic", "https://profdrnavidrashidqureshi.com"), ("Dental Clinic Karachi", "https://any.org"), (None, "https://any.org"), ("Studio Nine", "https://STUDIO.pk:80/a")]
    assert one(spark, cases, records.own_site) == [True, False, True, True, True]


def test_email_collect_and_rank(spark):
    page = "icons/name@2x-hash.png error@sentry.io a@wixpress.com Info@Brightsmile.pk hello&#64;brightsmile.pk"
    assert one(spark, [page, None], email.collect_emails)[0] == ["info@brightsmile.pk", "hello@brightsmile.pk"]
    got = one(spark, [("noreply@brightsmile.pk x@gmail.com bookings@brightsmile.pk", "https://www.brightsmile.pk/x"), ("a@b.co c@d.co", None), ("", "")], email.best_email)
    assert got == ["bookings@brightsmile.pk", "a@b.co", None]
    assert one(spark, [("a@b.co c@d.co", "C@d.co")], lambda t, p: email.best_email(t, None, p)) == ["c@d.co"]


def test_email_decoding(spark):
    plain, key = "hello@brightsmile.pk", 0x5A
    code = f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in plain)
    assert one(spark, [f'<a data-cfemail="{code}">', "<a>"], email.protected_address) == [plain, None]
    assert one(spark, ['<a href="mailto:Ann%40b.co?x">', "none"], email.mailto) == ["ann@b.co", None]


def test_email_validation(spark):
    bad = ["noreply@x.com", "yourname@yourdomain.com", "demo@test.com", "joe@mailinator.com", "a@b", "", None, "l" * 65 + "@x.com"]
    assert one(spark, bad, email.validate_email) == [None] * len(bad)
    assert one(spark, [" Joe@Shop.PK "], email.validate_email) == ["joe@shop.pk"]
    assert one(spark, [("Ann", "Lee", "x.co")], email.predicted)[0][:3] == ["ann.lee@x.co", "annlee@x.co", "alee@x.co"]


@pytest.mark.parametrize("country,raw,want", [("PK", "0300 1234567", "+923001234567"), ("PK", "+92 300 1234567", "+923001234567"), ("PK", "042-35741234", "+924235741234"), ("US", "212-555-0134", "+12125550134"), ("PK", "1111111111", None), ("PK", "1234567890", None), ("PK", "123", None), ("PK", "not a phone", None), ("PK", None, None)])
def test_normalize_phone(spark, country, raw, want):
    assert one(spark, [raw], lambda c: phone.normalize_phone(c, country)) == [want]


def test_phones_in_text(spark):
    assert one(spark, ["Call:03001234567", "cache-bust=1786024520697", None], phone.collect_phones)[:2] == [["03001234567"], []]
    assert one(spark, ["+1 202 555 0111 and +92 21 111 111 001"], lambda c: phone.best_phone(c, "PK")) == ["+92 21 111 111 001"]
    assert one(spark, [("+1 202 555 0111 or +1 202 555 0122", "tel 1-202-555-0122")], lambda t, p: phone.best_phone(t, "US", p)) == ["+1 202 555 0122"]
    assert one(spark, ["+923001234567", "03001234567", "12"], phone.merge_key) == ["3001234567", "3001234567", "12"]
    assert one(spark, ["0092 300 1", "300-1"], phone.for_messages) == ["+923001", "+3001"]


def test_urls(spark):
    assert one(spark, ["WWW.Shop.com/a/?q=1#x", "http://b.co", "http://Site.PK/", "https://a.co/x//", "", None], url.normalize_website) == ["https://shop.com/a", "https://b.co", "https://site.pk/", "https://a.co/x", None, None]
    assert one(spark, ["https://www.Shop.com/a", None], url.website_key) == ["shop.com", ""]
    html = '<a href="/contact-us">x</a><a href="#t">y</a><a href="../b/./reach.html?x=1">Say  hello</a><a href="http://other.co/contact">o</a><a href="//www.s.co/getintouch/">z</a><a href="mailto:contact@s.co">m</a>'
    got = one(spark, [("https://s.co/p/q", html)], url.contact_pages)[0]
    assert got == ["https://s.co" + p for p in url.CONTACT_PATHS] + ["https://s.co/b/reach.html", "https://www.s.co/getintouch"]
    assert one(spark, [(200, "please VERIFY you are human"), (429, "x"), (200, "attention required")], url.challenge_page) == [True, True, False]
    assert one(spark, ["see https://facebook.com/me), https://x.com/you"], url.social_links) == [{"facebook": "https://facebook.com/me", "twitter": "https://x.com/you"}]
    assert one(spark, ['<meta content="d" name="description">', '<meta property="og:description" content="o">', "<p>"], url.meta_description) == ["d", "o", None]


def test_geo_and_time(spark):
    row = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("km"), geo.somewhere(F.lit(0.0), F.lit(0.0)).alias("null_island"), clock.minutes(F.lit("09:30")).alias("m"), clock.minutes(F.lit("x")).alias("n"), clock.local_midnight(F.lit("2024-01-15 06:00:00").cast("timestamp")).cast("string").alias("t")).first()
    assert row.km == pytest.approx(111.195, abs=1e-3)
    assert (row.null_island, row.m, row.n, row.t) == (False, 570, None, "2024-01-14 19:00:00")
