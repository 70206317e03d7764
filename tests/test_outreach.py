import datetime as dt

from pyspark.sql import functions as F

from larkspur.functions.people import people
from larkspur.operators import enrich, outreach

T1, T2 = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 2, 10)


def test_sends(spark):
    leads = spark.createDataFrame([(1, "New", None), (2, "Won", None), (3, "New", None)], "lead_id int, status string, outreach_sent_at timestamp")
    sends = spark.createDataFrame([(1, True, T1, None), (2, True, T2, None), (3, False, T1, "x" * 600)], "lead_id int, ok boolean, at timestamp, error string")
    r = {x.lead_id: x for x in outreach.apply_sends(leads, sends).collect()}
    assert [r[k].status for k in (1, 2, 3)] == ["Contacted", "Won", "New"]
    assert r[1].outreach_sent_at == T1 and r[3].outreach_sent_at is None and len(r[3].send_error) == 500


def test_bookings_round_trip(spark):
    leads = spark.createDataFrame([("w", "Ann", "Ann@x.co", "New")], "workspace_id string, name string, email string, status string")
    b = spark.createDataFrame([("w", "R1", "Ann L", "ann@X.co", T1), ("w", "R2", "Bob", "bob@x.co", T2)], "workspace_id string, reference string, name string, email string, at timestamp")
    hot, crm, said = outreach.apply_bookings(leads, b)
    assert {(r.name, r.status) for r in hot.collect()} == {("Ann", "Hot"), ("Bob", "Hot")}
    assert crm.count() == 2
    back = {r.reference: (r.lead, r.email, r.date) for r in enrich.booking(said).collect()}
    assert back["R2"] == ("Bob", "bob@x.co", "2024-01-02 10:00")


def test_bookings_of_one_address(spark):
    """The earliest booking names the lead, of those at one time the first by reference, in whatever order they come."""
    leads = spark.createDataFrame([], "workspace_id string, name string, email string, status string")
    rows = [("w", "R3", "Adam", "a@x.co", T2), ("w", "R2", "Zed", "A@x.co", T1), ("w", "R4", "Bob", "a@X.co", T1), ("w", "R1", "Al", "a@x.co", None), ("v", "R5", "Nil", "a@x.co", None)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        b = spark.createDataFrame(order, "workspace_id string, reference string, name string, email string, at timestamp").coalesce(1)
        hot, _, _ = outreach.apply_bookings(leads, b)
        assert sorted((r.workspace_id, r.name, r.email) for r in hot.collect()) == [("v", "Nil", "a@x.co"), ("w", "Zed", "A@x.co")]


def test_small_ones(spark):
    a = spark.createDataFrame([("w", T1, "s", "a"), ("w", T1, "s", "a"), ("w", T2, "t", "b"), ("v", T2, "t", "c")], "workspace_id string, created_at timestamp, stage string, detail string")
    assert [r.stage for r in outreach.replay(a, "w", 1).collect()] == ["t"] and outreach.replay(a, "w").count() == 2
    w = spark.createDataFrame([("A | B", "https://a.co"), ("C", "https://www.yelp.com/c"), ("", "https://d.co")], "title string, url string")
    assert [tuple(r) for r in outreach.web_results(w, ["yelp.com"]).collect()] == [("A", "https://a.co", "web_search")]
    got = spark.range(1).select(people(F.lit("Ann Lee, head, ann@x.co. Bob Ray works here")).alias("p")).first().p
    assert [tuple(x) for x in got] == [("Ann Lee", "ann@x.co"), ("Bob Ray", None)]
