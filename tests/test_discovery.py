"""The ladder, nearest places, niches and slots against plain versions over the same rows."""

import math
import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from larkspur.operators import ladder, nearby, niches, resolve, slots

CANDIDATE = "ordinal long, name string, phone string, email string, website string, address string, source string, lat double, lon double, rating double, social_links map<string,string>"


def some_records(n, seed):
    rng = random.Random(seed)
    pick = lambda k, f: f(rng.randint(0, k)) if rng.random() < 0.6 else None
    return [
        (i, f"Shop {rng.randint(0, 60)}" + rng.choice(["", " Ltd"]), pick(40, lambda k: f"0300 00000{k:02}"), pick(30, lambda k: f"m{k}@x.pk"), pick(40, lambda k: f"https://www.s{k}.pk/a"), pick(50, lambda k: f"{k} Street"),
         rng.choice(["google_maps", "directory", "dns", "other"]), pick(60, float), pick(60, float), pick(5, float), pick(3, lambda k: {"fb": f"u{k}", f"p{k}": "x"}))
        for i in range(n)
    ]


def test_ladder_is_one_merge_in_order(spark):
    records = spark.createDataFrame(some_records(240, 1), CANDIDATE).withColumn("tier", F.floor(F.col("ordinal") / 60))
    whole = records.drop("tier")
    seen = []

    def watched(frames):
        for i, f in enumerate(frames):
            seen.append(i)
            yield f

    flat = lambda df: sorted([str(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in r.asDict().items())) for r in df.collect()])
    tiers = [records.where(F.col("tier") == i).drop("tier") for i in range(4)]
    got, used = ladder.climb(watched(tiers), 10**9, lambda g: g)
    assert used == 4 and flat(got) == flat(resolve.merge(whole))
    seen.clear()
    some, used = ladder.climb(watched(tiers), resolve.merge(tiers[0]).count() + 1, lambda g: g)
    assert used == len(seen) == 2
    assert flat(some) == flat(resolve.merge(whole.where(F.col("ordinal") < 60 * used)))


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_nearest_of_clusters_poles_and_date_line(spark, monkeypatch):
    monkeypatch.setattr(nearby, "CROWD", 2)
    rng = random.Random(2)
    spots = [(rng.gauss(24.9, 0.01), rng.gauss(67.0, 0.01)) for _ in range(80)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)]
    spots += [(89.9, -170.0), (89.8, 10.0), (-90.0, 0.0), (0.5, 179.99), (0.5, -179.99), (10.0, 180.0), (24.9, 67.0), (24.9, 67.0), (24.9, 67.0)]
    rows = [(i, "ab"[i % 7 == 0], float(la), float(lo)) for i, (la, lo) in enumerate(spots)]
    df = spark.createDataFrame([*rows, (900, "a", None, 1.0), (901, "a", 0.0, 0.0), (902, "c", 1.0, 1.0), (903, "d", 1.0, 1.0), (904, "d", 2.0, 2.0)], "city int, country string, lat double, lon double")
    got = {}
    for r in nearby.nearest(df, 3).collect():
        got.setdefault(r.city, []).append((r.place, r.near))
    for i, c, la, lo in rows:
        want = sorted((round(km((la, lo), (x, y)), 6), j) for j, d, x, y in rows if d == c and j != i)[:3]
        assert sorted(got[i]) == [(n + 1, j) for n, (_, j) in enumerate(want)], i
    assert 902 not in got and 900 not in got and got[903] == [(1, 904)]


def test_nearest_by_name_centres_and_radius(spark):
    cities = spark.createDataFrame([("PK", 0, "Karachi", 24.86, 67.0), ("PK", 1, "Lahore", 31.55, 74.34), ("PK", 2, "Islamabad", 33.68, 73.05), ("PK", 3, "Rawalpindi", 33.57, 73.02), ("PK", 4, "Nowhere", 0.0, 0.0)], "country string, ordinal int, name string, lat double, lon double")
    asked = spark.createDataFrame([("pk", " islamabad"), ("PK", "Atlantis"), ("PK", "nowhere")], "country string, city string")
    got = sorted((r.place, r.near) for r in nearby.nearest_by_name(cities, asked, 2).collect())
    assert got == [(1, "Rawalpindi"), (2, "Lahore")]
    assert {r.city: r.lat for r in nearby.centre(cities, asked).collect()} == {" islamabad": 33.68, "Atlantis": None, "nowhere": None}
    assert [r.name for r in nearby.top_cities(cities, 2).orderBy("ordinal").collect()] == ["Karachi", "Lahore"]
    p = spark.createDataFrame([(5.0,), (30.0,), (90.0,)], "distance_km double")
    assert [nearby.within_radius(p, n).count() for n in (1, 2, 9)] == [1, 2, 2]


def test_niches(spark):
    asked = ["Dental Clinic", "Dentist", "Lawyer", "Attorney", "Law Firm", "Underwater Basket Weaving", "den", "plastic surgeons", "best hair and nails", "the shop", "", None, "GYM "]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, asked string")
    got = {r.asked: (r.niche, r.niche_key) for r in niches.canonical(df, "asked", niches.known_niches(spark)).collect()}

    def plain(text):
        key, names = text.strip().lower(), list(niches.NICHES)
        w = lambda s: {x for x in "".join(c if c.isascii() and c.isalpha() else " " for c in s).split() if len(x) > 2 and x not in niches.STOP}
        name = key if key in names else next((n for n in names if key and (n in key or key in n)), None)
        if name is None and key:
            best = max(names, key=lambda n: (len(w(key) & w(n)), -names.index(n)))
            name = best if w(key) & w(best) else None
        return name, next(n for n in names if niches.NICHES[n] == niches.NICHES[name]) if name else key

    assert got == {a: plain(a) if a is not None else (None, None) for a in asked}
    assert got["Dental Clinic"][1] == got["Dentist"][1] and got["Lawyer"][1] == got["Attorney"][1] == got["Law Firm"][1]
    syn = spark.createDataFrame([("gym", 0, "gym"), ("gym", 1, "fitness center"), ("gym", 2, "health club")], "niche string, place int, term string")
    terms = [r.term for r in niches.expand(df.where("i = 12"), "asked", syn).orderBy("term_place").collect()]
    assert terms == ["gym", "fitness center", "health club"]
    cat = {r.asked: r.c for r in df.select("asked", niches.category(F.col("asked")).alias("c")).collect()}
    assert cat["Dental Clinic"] == "healthcare.dentist" and cat["GYM "] == "sport.fitness" and cat["Lawyer"] is None


def step_by_step(zone, hours, now, booked, count=4):
    """The search as it goes: an hour at a time over closed days, a day at a time over open ones."""
    tz = ZoneInfo(zone or "Asia/Karachi")
    now, out, seen, steps = now.astimezone(tz), [], 0, 0
    cursor = now.replace(minute=now.minute // 30 * 30, second=0, microsecond=0)
    booked = [b.astimezone(tz) for b in booked]
    while len(out) < count and seen <= 5 and steps < 500:
        steps += 1
        h = (hours or {}).get(cursor.strftime("%A").lower()) or []
        try:
            a, b = [int(x.split(":")[0]) * 60 + int(x.split(":")[1]) for x in h]
        except (ValueError, IndexError):
            cursor += timedelta(hours=1)
            continue
        day = cursor.replace(hour=0, minute=0)
        cursor = max(cursor, day + timedelta(minutes=a))
        while cursor < day + timedelta(minutes=b) and len(out) < count:
            if cursor > now and not any(cursor < x + timedelta(minutes=30) and x < cursor + timedelta(minutes=30) for x in booked):
                out.append(cursor.replace(tzinfo=None))
            cursor += timedelta(minutes=30)
        seen += 1
        cursor = day + timedelta(days=1)
    return out


def test_slots_of_many_profiles(spark):
    rng = random.Random(5)
    names = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    some = lambda: rng.choice([["09:00", "10:00"], ["8:15", "12:05"], ["00:00", "01:00"], ["9am", "10:00"], ["10:00", "09:00"], ["07:10"]])
    for now in (datetime(2024, 1, 15, 8, 30, tzinfo=timezone.utc), datetime(2024, 3, 8, 23, 50, 10, tzinfo=timezone.utc), datetime(2024, 10, 25, 3, 31, tzinfo=timezone.utc)):
        profiles = [(i, rng.choice([None, "", "UTC", "America/New_York", "Europe/Berlin", "Asia/Kathmandu"]), {d: some() for d in rng.sample(names, rng.randint(0, 6))}) for i in range(40)]
        profiles += [(90, "UTC", None), (91, "UTC", {"sunday": ["10:00", "10:30"]}), (92, "UTC", {"monday": ["09:00", "10:00"], "tuesday": ["09:00", "10:00"]})]
        booked = [(rng.randint(0, 39), now + timedelta(minutes=rng.randint(0, 9 * 1440))) for _ in range(1500)] + [(7, now + timedelta(minutes=m)) for m in range(0, 40000, 20)]
        p = spark.createDataFrame(profiles, "profile int, zone string, hours map<string,array<string>>")
        b = spark.createDataFrame([(i, x.replace(tzinfo=None)) for i, x in booked], "profile int, at timestamp_ntz").withColumn("at", F.col("at").cast("timestamp"))
        stamp = F.lit(now.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
        got = {}
        for r in slots.next_slots(p, b, stamp).orderBy("profile", "place").collect():
            got.setdefault(r.profile, []).append(r.slot)
        for i, zone, hours in profiles:
            assert got.get(i, []) == step_by_step(zone, hours, now, [x for j, x in booked if j == i]), (i, zone, hours)


def exploded_into_broadcast(df):
    """Whether the plan broadcasts exploded rows that no aggregate has made fewer: they are estimated as if they weren't exploded."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-*()0123456789")) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            below = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            kinds = [k for y in lines[i + 1 : below] for k in ("Generate", "Aggregate") if y.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0].endswith(k)]
            if kinds[:1] == ["Generate"]:
                return True
    return False


def test_slots_are_not_broadcast(spark):
    """A driver that holds all slots of all profiles is full at 60,000 profiles."""
    p = spark.range(100).selectExpr("id as profile", "'UTC' as zone", "map('monday', array('09:00', '17:00')) as hours")
    b = spark.range(10_000).selectExpr("id % 100 as profile", "timestampadd(MINUTE, id * 17 % 40000, timestamp '2024-03-07 00:00:00') as at")
    assert not exploded_into_broadcast(slots.next_slots(p, b, F.expr("timestamp '2024-03-07 23:40:00'")))


def test_nearest_looks_are_not_broadcast(spark, monkeypatch):
    broadcast, durable = [], nearby.durable
    monkeypatch.setattr(nearby, "durable", lambda df: (broadcast.append(exploded_into_broadcast(df)), durable(df))[1])
    df = spark.range(2000).selectExpr("id as city", "id % 2 as country", "double(id * 37 % 160) - 80 as lat", "double(id * 101 % 360) - 180 as lon")
    assert nearby.nearest(df, 2).count() == 4000
    assert broadcast and not any(broadcast)


def test_nearest_of_many_at_one_spot(spark):
    df = spark.range(900).selectExpr("id as city", "1 as country", "if(id < 600, 24.9, id / 20) as lat", "if(id < 600, 67.0, 70 + id / 20) as lon")
    got = {}
    for r in nearby.nearest(df, 3).collect():
        got.setdefault(r.city, []).append((r.place, r.near))
    assert sorted(got) == list(range(900))
    assert all(sorted(got[i]) == list(enumerate([j for j in range(4) if j != i][:3], 1)) for i in range(600))
    spots = {i: (24.9, 67.0) if i < 600 else (i / 20, 70 + i / 20) for i in range(900)}
    for i in (600, 601, 750, 899):
        assert sorted(got[i]) == [(n, j) for n, (_, j) in enumerate(sorted((round(km(spots[i], spots[j]), 6), j) for j in spots if j != i)[:3], 1)]
