import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import phone, text, url  # noqa: F401
from larkspur.operators import analytics, quality_gate, resolve, upsert
from larkspur.sources import payloads

LEAD = "ordinal long, name string, phone string, email string, website string, address string, source string, lat double, lon double"


def test_overview_golden(spark):
    df = spark.createDataFrame([(0, 90, "Qualified", "Webinar"), (1, 40, "New", "Webinar"), (2, None, "New", "Referral")], "ordinal long, score int, status string, source string")
    assert tuple(analytics.overview(df).first()) == (3, 1, 65.0)
    assert {r.source: r.percent for r in analytics.source_split(df).collect()} == {"Webinar": 67, "Referral": 33}
    assert tuple(analytics.overview(df.limit(0)).first()) == (0, 0, 0.0)
    assert [(r.status, r.n) for r in analytics.status_breakdown(df).orderBy("place").collect()][:2] == [("New", 2), ("Qualified", 1)]


def test_weekly_edges(spark):
    now = F.lit("2024-03-01 12:00:00").cast("timestamp")
    df = spark.createDataFrame([("2024-03-01 12:00:00",), ("2024-02-23 12:00:00",), ("2024-03-02 00:00:00",), ("2024-01-05 12:00:00",), (None,)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.bucket: r.n for r in analytics.weekly(df, "ts", now).collect()}
    assert len(got) == 8 and got["W8"] == 2 and got["W7"] == 1 and got["W1"] == 1 and sum(got.values()) == 4


def replayed(rows):
    """The order-dependent grouping, record by record."""
    owner, out = {}, {}
    for r in rows:
        if not r["name"]:
            continue
        keys = [k for k in (("n", r["k"][0]), ("p", r["k"][1]), ("w", r["k"][2])) if k[1]]
        g = next((owner[k] for k in keys if k in owner), r["ordinal"])
        for k in keys:
            owner.setdefault(k, g)
        out[r["ordinal"]] = g
    return out


def test_assignment_is_the_ordered_replay(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", f"Shop {rng.randrange(40)}"]) if i % 9 == 0 else f"Shop {rng.randrange(60)}", rng.choice([None, f"0300123{rng.randrange(50):04d}"]), None, rng.choice([None, f"https://s{rng.randrange(50)}.co/x"]), None, rng.choice(["dns", "directory", "bing_maps"]), None, None) for i in range(160)]
    df = spark.createDataFrame(rows, LEAD)
    keyed = [r.asDict() | {"k": (r.k_name, r.k_phone, r.k_site)} for r in resolve.keyed(df).orderBy("ordinal").collect()]
    assert {r.ordinal: r.group_id for r in resolve.assign(df).collect()} == replayed(keyed)


def test_merge_golden(spark):
    rows = [(0, "Sakura Dental Studio (Pvt) Ltd", "+923001234567", None, None, None, "directory", 1.0, None), (1, "Sakura Dental Studio", None, "a@s.pk", None, None, "bing_maps", 2.0, 3.0), (2, "Other", "03001234567", "b@s.pk", None, None, "google_maps", None, None)]
    r = resolve.merge(spark.createDataFrame(rows, LEAD)).collect()
    assert len(r) == 1
    assert (r[0].name, r[0].phone, r[0].email, r[0].lat, r[0].lon, r[0].members) == ("Sakura Dental Studio (Pvt) Ltd", "03001234567", "b@s.pk", 2.0, 3.0, 3)
    assert resolve.merge(spark.createDataFrame([], LEAD)).count() == 0


def test_gate_and_cut(spark):
    rows = [(0, "A", None, None, None, "Street 1", "dns", 1.0, 2.0), (1, "B", None, None, None, "Street 1", "dns", None, None), (2, "C", None, None, None, None, "dns", 1.0, 2.0), (3, "D", "0300 1234567", "x@mailinator.com", None, None, "dns", None, None)]
    kept = quality_gate.gate(spark.createDataFrame(rows, LEAD))
    assert [(r.ordinal, r.phone, r.email) for r in kept.orderBy("ordinal").collect()] == [(0, None, None), (3, "+923001234567", None)]
    df = spark.createDataFrame([(0, 10), (1, 90), (2, 50), (3, 100)], "ordinal long, completeness int")
    assert [r.ordinal for r in quality_gate.cut_then_rank(df, 3).collect()] == [1, 2, 0]


def test_import_in_order(spark):
    rows = [(i, i in (1, 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "ordinal long, dup boolean")

    def plain(day, quota):
        out, n = [], 0
        stop = False
        for _, dup in rows:
            if stop:
                out.append("not_reached")
            elif n >= day:
                out.append("daily_limit_reached")
            elif n >= quota:  # looked at before the row's keys
                out.append("quota_exceeded")
                stop = True
            elif dup:
                out.append("duplicate")
            else:
                n += 1
                out.append("imported")
        return out

    for day, quota in ((3, 100), (100, 3), (100, 100), (0, 5), (3, 3), (5, 0)):
        got = upsert.classify_import(df, F.col("dup"), 0, day, 0, quota).orderBy("ordinal").collect()
        assert [r.outcome for r in got] == plain(day, quota), (day, quota)


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("b", 2, None), ("c", 3, "z"), ("c", 4, "q")], "k string, v int, w string")
    got = {r.k: (r.v, r.w) for r in upsert.upsert(old, new, ["k"], [F.desc("v")]).collect()}
    assert got == {"a": (1, "x"), "b": (2, None), "c": (4, "q")}
    got = {r.k: (r.v, r.w) for r in upsert.upsert(old, new, ["k"], [F.desc("v")], patch=True).collect()}
    assert got == {"a": (1, "x"), "b": (2, "y"), "c": (4, "q")}
    rows, counts = upsert.insert_absent(new, old, ["k"], [F.desc("v")])
    assert [(r.k, r.v) for r in rows.collect()] == [("c", 4)] and tuple(counts.first()) == (1, 2)
    flags = upsert.mark_known(spark.createDataFrame([(1, "A@b.co", None), (2, None, "+1 55"), (3, "q", "9")], "i int, email string, phone string"), spark.createDataFrame([("a@B.co", "+155")], "email string, phone string"))
    assert {r.i: r.already_in_workspace for r in flags.collect()} == {1: True, 2: True, 3: False}


def test_payloads(spark):
    body = {"elements": [{"center": {"lat": 1.5, "lon": 2.5}, "tags": {"name": "شفا", "name:en": "Shifa", "addr:housenumber": "12", "addr:street": "Khayaban-e-Shahbaz"}}, {"tags": {"name": "Alone"}}, {"tags": {"name": "دکان", "phone": "1"}}]}
    df = spark.createDataFrame([(json.dumps(body),)], "p string")
    assert [(r.name, r.address, r.lat) for r in payloads.poi(df, "p", "Karachi").collect()] == [("Shifa", "12, Khayaban-e-Shahbaz, Karachi", 1.5)]
    card = '<div class="card listing-card"><h2><a>Bright <b>Smile</b></a></h2><i class="map-marker"></i><span>Main Road</span><a href="tel:03001234567"></div>'
    got = payloads.listing_cards(spark.createDataFrame([("<html>" + card + card,)], "h string"), "h").collect()
    assert [(r.name, r.phone, r.address) for r in got] == [("Bright Smile", "03001234567", "Main Road")]
    ld = '<script type="application/ld+json">{"@graph":[{"@type":"Dentist","name":"D","telephone":"1","address":{"streetAddress":"S","addressLocality":"L"}}]}</script>'
    got = payloads.json_ld(spark.createDataFrame([(ld,)], "h string"), "h").first()
    assert (got.name, got.phone, got.address) == ("D", "1", "S, L")
    got = spark.range(1).select(payloads.place_url(F.lit("x!3d24.5!4d-67.25y")).alias("p"), payloads.place_url(F.lit("x")).alias("q")).first()
    assert (got.p.lat, got.p.lon, got.q.lat) == (24.5, -67.25, None)
    hook = {"entry": [{"changes": [{"value": {"metadata": {"phone_number_id": "7"}, "statuses": [{"id": "a", "status": "read"}], "messages": [{"id": "b", "from": "9", "text": {"body": "hi"}}]}}]}]}
    got = payloads.flatten_webhook(spark.createDataFrame([(json.dumps(hook),)], "p string"), F.col("p")).collect()
    assert [tuple(r) for r in got] == [("7", "statuses", "a", "read"), ("7", "messages", "b", "hi")]
    page = '<script>window.mapBubbles=[{"lat":1.0,"lng":2.0,"html":"<b>N</b>"}];</script>'
    assert tuple(payloads.bubbles(spark.createDataFrame([(page,)], "h string"), "h").first()) == (0, 1.0, 2.0, "N")


def test_catalogue_runs_and_names_agree(spark):
    from larkspur.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    for name in ("leads_overview", "merge_businesses", "stream_source_health"):
        assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry_imports_without_corpus(monkeypatch):
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith("larkspur.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "larkspur.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "leads_overview" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")


@pytest.mark.parametrize("last", [3])
def test_last_outcomes(spark, last):
    df = spark.createDataFrame([("s", i, i < 2) for i in range(10)], "source string, ts int, ok boolean")
    assert tuple(analytics.last_outcomes(df, "source", [F.desc("ts")], last=last, least=2).first()) == ("s", 3, 0.0, True)


def test_streamed_health_is_the_tables(spark):
    from larkspur.plans import catalogue

    got, want = (catalogue.queries()[n](spark, "/root/testdata/sf0.1") for n in ("stream_source_health_last100", "source_health_last100"))
    assert sorted((r.source, r.samples, r.rate) for r in got.collect()) == sorted((r.source, r.samples, r.rate) for r in want.collect())


def test_queries_over_the_whole_input(spark, tmp_path):
    import re

    from larkspur.plans import catalogue

    run = lambda name: catalogue.queries()[name](spark, str(tmp_path)).collect()
    texts = [(1, "noreply@shop.pk then info@shop.pk"), (2, "x@y.co"), (3, "none"), (4, None), (5, "a@b.co A@b.co c@d.co")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.emails, r.n) for r in run("doc_emails")}
    assert got == {1: ("noreply@shop.pk,info@shop.pk", 2), 2: ("x@y.co", 1), 3: ("", 0), 4: ("", 0), 5: ("a@b.co,c@d.co", 2)}
    assert {r.doc_id: r.best for r in run("doc_best_email")} == {1: "info@shop.pk", 2: "x@y.co", 5: "a@b.co"}
    page = "<p>" + "word <b>x</b> " * 200 + "end</p>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert run("strip_page_tags")[0].plain == " ".join(re.sub("<[^>]+>", " ", page).split())
    spark.read.parquet("/root/testdata/sf0.001/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    rows = catalogue.leads(spark, str(tmp_path)).selectExpr("lead_id", "lower(email) m", "replace(phone, ' ', '') p").collect()
    same = lambda a, b: bool(a.m and a.m == b.m or a.p and a.p == b.p)
    want = {a.lead_id: any(same(a, b) for b in rows if b.lead_id != a.lead_id) for a in rows}
    assert {r.lead_id: r.already_in_workspace for r in run("already_among_leads")} == want


def test_mark_repeated(spark):
    df = spark.createDataFrame([(1, "A@b.co", None), (2, "a@B.co", "+1 5"), (3, None, "+15"), (4, "", ""), (5, "", ""), (6, "z", "9")], "i int, email string, phone string")
    assert {r.i: r.already_in_workspace for r in upsert.mark_repeated(df).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
