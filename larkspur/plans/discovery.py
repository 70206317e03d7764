"""Queries of discovery: the ladder of tiers, nearest places, niches, meeting slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import ladder, nearby, niches, slots
from larkspur.plans.base import query, t
from larkspur.plans.catalogue import _ASSIGN, candidates
from larkspur.plans.views import leads

# ---- The ladder -----------------------------------------------------------------------------------------------------

_LADDER = _ASSIGN.replace("c as (select ordinal,", "c as (select ordinal % 4 * 1099511627776 + ordinal as ordinal,", 1)
_RANKED = "['google_maps', 'directory', 'openstreetmap', 'web_search', 'wikidata', 'wikipedia', 'certtransparency', 'dns']"
_LADDER_ROWS = f"""x as (select o.ordinal, o.root as g, l.ordinal % 4 as tier, nullif(l.phone, '') as phone, nullif(l.email, '') as email, nullif(l.address, '') as address, nullif(l.website, '') as website,
coalesce(nullif(list_position({_RANKED}, list_append({_RANKED}, 'bing_maps')[l.ordinal % 9 + 1]), 0), 9) as rk from r o join leads l on l.ordinal % 4 * 1099511627776 + l.ordinal = o.ordinal),
w as (select g, min(tier) filter (where phone is not null or website is not null) as valid from x group by 1), n as (select tier, (select count(*) from w where valid <= tier) as n from (select distinct tier from x)),
used as (select coalesce(min(tier) filter (where n >= (select count(*) // 6 from leads)), 3) as last from n),
y as (select x.*, max(case when ordinal = g then rk end) over (partition by g) as r0 from x, used where tier <= last)
select g as group_id, count(*) as members, coalesce(arg_max(phone, ordinal) filter (where phone is not null and rk < r0), arg_min(phone, ordinal) filter (where phone is not null)) as phone,
coalesce(arg_max(email, ordinal) filter (where email is not null and rk < r0), arg_min(email, ordinal) filter (where email is not null)) as email,
coalesce(arg_max(address, ordinal) filter (where address is not null and rk < r0), arg_min(address, ordinal) filter (where address is not null)) as address
from y group by 1 having count(phone) > 0 or count(website) > 0"""


@query(_LADDER.replace("select ordinal, root as group_id from r", f", {_LADDER_ROWS}"))
def fill_ladder_merged(spark, d):
    """Records in four tiers, merged tier by tier until as many groups with a phone or website are there as a sixth of the leads."""
    c = candidates(spark, d).withColumn("tier", F.col("ordinal") % 4)
    limit = leads(spark, d).count() // 6
    left, _ = ladder.climb(ladder.in_tiers(c, "tier", 4), limit, lambda g: g.where("coalesce(phone, '') <> '' or coalesce(website, '') <> ''"))
    return left.select("group_id", "members", "phone", "email", "address")


# ---- Places ---------------------------------------------------------------------------------------------------------

_SPOTS = "cast(c_custkey * 37 % 1600 as double) / 10 - 80 as lat, cast(c_custkey * 101 % 3600 as double) / 10 - 180 as lon"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""with c as (select c_custkey as city, c_nationkey as country, {_SPOTS} from customer), p as (select a.city, b.city as near, {_KM} as km from c a join c b on a.country = b.country and a.city <> b.city)
select city, near, round(km, 3) as km, cast(rn as int) as place from (select *, row_number() over (partition by city order by round(km, 6), near) as rn from p) where rn <= 4""")
def nearest_places(spark, d):
    c = t(spark, d, "customer").selectExpr("c_custkey as city", "c_nationkey as country", *_SPOTS.split(", "))
    return nearby.nearest(c, 4).withColumn("km", F.round("km", 3))


_TOWNS = "select n_regionkey as country, n_nationkey as ordinal, n_name as name, cast(n_nationkey * 7 % 120 as double) - 60 as lat, cast(n_nationkey * 13 % 300 as double) - 150 as lon from nation"


@query(f"""with c as ({_TOWNS}), k as (select s_suppkey, '0' || (s_suppkey % 5) as code, case when s_suppkey % 4 = 0 then 'nowhere' else ' ' || lower(n_name) end as city from supplier join nation on n_nationkey = s_nationkey)
select s_suppkey, c.lat, c.lon from k left join c on country = s_suppkey % 5 and lower(name) = trim(city)""")
def city_centres(spark, d):
    towns = t(spark, d, "nation").selectExpr("cast(n_regionkey as string) as country", "n_nationkey as ordinal", "n_name as name", "cast(n_nationkey * 7 % 120 as double) - 60 as lat", "cast(n_nationkey * 13 % 300 as double) - 150 as lon")
    s = t(spark, d, "supplier").join(t(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    asked = s.select("s_suppkey", (F.col("s_suppkey") % 5).cast("string").alias("country"), F.when(F.col("s_suppkey") % 4 == 0, "nowhere").otherwise(F.concat(F.lit(" "), F.lower("n_name"))).alias("city"))
    return nearby.centre(towns, asked).select("s_suppkey", "lat", "lon")


@query(f"with c as ({_TOWNS}), r as (select *, row_number() over (partition by country order by ordinal) as rn from c) select country, name as city, lat, lon from r where rn <= 2")
def top_cities(spark, d):
    towns = t(spark, d, "nation").selectExpr("n_regionkey as country", "n_nationkey as ordinal", "n_name as name", "cast(n_nationkey * 7 % 120 as double) - 60 as lat", "cast(n_nationkey * 13 % 300 as double) - 150 as lon")
    return nearby.top_cities(towns, 2).select("country", F.col("name").alias("city"), "lat", "lon")


@query("""with p as (select l_orderkey, l_linenumber, l_quantity * 1.2 as distance_km from lineitem), n as (select count(*) filter (where distance_km <= 15) as near from p)
select l_orderkey, l_linenumber from p, n where distance_km <= case when near >= 10000000 then 15 else 50 end""")
def points_within_radius(spark, d):
    pois = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 1.2).alias("distance_km"))
    return nearby.within_radius(pois, 10_000_000).select("l_orderkey", "l_linenumber")


# ---- Niches ---------------------------------------------------------------------------------------------------------

_ASKED = """case p_partkey % 12 when 0 then 'Dental Clinic' when 1 then ' DENTIST' when 2 then 'Plastic surgeons ' || lower(p_brand) when 3 then 'den' when 4 then 'coffee ' || p_size when 5 then 'Car and auto repairs' when 6 then 'best hair and nails'
when 7 then 'Law office' when 8 then 'Underwater Basket Weaving' when 9 then p_name when 10 then 'store ' || p_type when 11 then '' end"""
_NICHE_ROWS = "(values " + ", ".join(f"({i}, '{n}', '{'|'.join(tags)}')" for i, (n, tags) in enumerate(niches.NICHES.items())) + ") as niche(place, name, signature)"
_WORDS = "list_distinct(list_filter(regexp_extract_all({}, '[a-z]+'), lambda w: length(w) > 2 and not list_contains(" + str(niches.STOP) + ", w)))"


@query(f"""with niche as (select * from {_NICHE_ROWS}), x as (select distinct trim(lower({_ASKED})) as q from part), o as (select q, name, place, signature, len(list_intersect({_WORDS.format("q")}, {_WORDS.format("name")})) as n from x, niche where q <> ''),
m as (select q, coalesce(min(case when q = name then place end), min(case when contains(q, name) or contains(name, q) then place end), min_by(place, (-n, place)) filter (where n > 0)) as place from o group by 1),
f as (select signature, min_by(name, place) as first from niche group by 1)
select p_partkey, niche.name as niche, coalesce(f.first, trim(lower({_ASKED}))) as niche_key from part left join m on m.q = trim(lower({_ASKED})) left join niche on niche.place = m.place left join f on f.signature = niche.signature""")
def canonical_niches(spark, d):
    asked = t(spark, d, "part").select("p_partkey", F.expr(_ASKED).alias("asked"))
    return niches.canonical(asked, "asked", niches.known_niches(spark)).select("p_partkey", "niche", "niche_key")


@query(f"select p_partkey, case {' '.join(f'''when contains(trim(lower({_ASKED})), '{w}') then '{v}' ''' for w, v in niches.CATEGORIES.items())} end as category from part")
def category_of_niche(spark, d):
    return t(spark, d, "part").select("p_partkey", niches.category(F.expr(_ASKED)).alias("category"))


@query("""with s as (select lower(r_name) as niche, n_nationkey as place, lower(n_name) as term from nation join region on r_regionkey = n_regionkey), a as (select p_partkey, trim(lower(case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then ' ' || r_name else '' end)) as q from part join region on r_regionkey = p_partkey % 5),
e as (select p_partkey, q as term, -1 as place from a where q <> '' union all select p_partkey, term, place from a join s on s.niche = q), f as (select p_partkey, term, min(place) as place from e group by 1, 2)
select p_partkey, term, cast(row_number() over (partition by p_partkey order by place) - 1 as int) as term_place from f""")
def niche_search_terms(spark, d):
    region = t(spark, d, "region")
    s = t(spark, d, "nation").join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lower("r_name").alias("niche"), F.col("n_nationkey").alias("place"), F.lower("n_name").alias("term"))
    a = t(spark, d, "part").join(region, F.col("r_regionkey") == F.col("p_partkey") % 5).selectExpr("p_partkey", "case when p_partkey % 3 = 0 then p_type when p_partkey % 3 = 1 then concat(' ', r_name) else '' end as asked")
    return niches.expand(a, "asked", s).select("p_partkey", "term", "term_place")


# ---- Slots ----------------------------------------------------------------------------------------------------------

_ZONE = "case s_suppkey % 3 when 0 then null when 1 then 'America/New_York' else 'Europe/Berlin' end"
_HOURS = {"monday": ("'09:00'", "'17:00'", "s_suppkey % 5 <> 3"), "tuesday": ("'8:15'", "'12:00'", "s_suppkey % 5 in (0, 1)"), "wednesday": ("'00:00'", "'02:00'", "s_suppkey % 5 = 1"), "friday": ("'10:00'", "'18:30'", "s_suppkey % 5 in (0, 4)"), "sunday": ("'9am'", "'17:00'", "s_suppkey % 5 <> 2")}
# What New York (from the 10th of March 2024) and Berlin (from the 31st) are ahead of or behind UTC in this query's weeks.
_OFFSET = "case s_suppkey % 3 when 0 then 300 when 1 then case when {0} < timestamp '2024-03-10 07:00:00' then -300 else -240 end else case when {0} < timestamp '2024-03-31 01:00:00' then 60 else 120 end end"
_BACK = "case s_suppkey % 3 when 0 then 300 when 1 then case when {0} < timestamp '2024-03-10 03:00:00' then -300 else -240 end else case when {0} < timestamp '2024-03-31 03:00:00' then 60 else 120 end end"
_NOW = "timestamp '2024-03-07 23:40:00'"


@query(f"""with recursive p as (select s_suppkey, {_NOW} + to_minutes({_OFFSET.format(_NOW)}) as now, [{", ".join(f"case when {on} then {a} end" for a, _, on in _HOURS.values())}] as opens, [{", ".join(f"'{b[1:-1]}'" for _, b, _ in _HOURS.values())}] as closes from supplier),
h as (select *, ['monday', 'tuesday', 'wednesday', 'friday', 'sunday'] as names from p),
s as (select s_suppkey, now, opens, closes, names, time_bucket(interval 30 minutes, now) as c, 0 as seen, 0 as guard, cast(null as timestamp) as a, cast(null as timestamp) as b from h
 union all
 select s_suppkey, now, opens, closes, names, case when o is null then c + interval 1 hour else date_trunc('day', c) + interval 1 day end, seen + cast(o is not null as int), guard + 1,
 case when o is not null then greatest(c, date_trunc('day', c) + to_minutes(o)) end, case when o is not null then date_trunc('day', c) + to_minutes(e) end
 from (select s.*, list_position(names, lower(dayname(c))) as ix, try_cast(split_part(opens[ix], ':', 1) as bigint) * 60 + try_cast(split_part(opens[ix], ':', 2) as bigint) as o, try_cast(split_part(closes[ix], ':', 1) as bigint) * 60 + try_cast(split_part(closes[ix], ':', 2) as bigint) as e from s where seen <= 5 and guard < 500) z),
x as (select s_suppkey, now, unnest(generate_series(a, b - interval 1 second, interval 30 minutes)) as slot from s where a is not null and a < b),
k as (select l_suppkey as s_suppkey, timestamp '2024-03-07 00:00:00' + to_minutes(cast(l_orderkey * 17 % 288000 as bigint)) as u from lineitem), l as (select s_suppkey, u + to_minutes({_OFFSET.format("u")}) as w from k),
f as (select s_suppkey, slot, row_number() over (partition by s_suppkey order by slot) as place from x where slot > now and not exists (select 1 from l where l.s_suppkey = x.s_suppkey and slot < w + interval 30 minutes and w < slot + interval 30 minutes))
select s_suppkey as profile, strftime(slot, '%Y-%m-%d %H:%M') as slot, strftime(slot - to_minutes({_BACK.format("slot")}), '%Y-%m-%d %H:%M') as at_utc, cast(place as int) as place from f where place <= 6""")
def profile_slots(spark, d):
    """The next six free slots of every supplier in three time zones, over a change to summer time and other kinds of weeks."""
    hours = F.create_map(*(x for day, (a, b, on) in _HOURS.items() for x in (F.lit(day), F.when(F.expr(on), F.array(F.expr(a), F.expr(b))))))
    profiles = t(spark, d, "supplier").select(F.col("s_suppkey").alias("profile"), F.expr(_ZONE).alias("zone"), hours.alias("hours"))
    at = F.expr("timestampadd(MINUTE, l_orderkey * 17 % 288000, timestamp '2024-03-07 00:00:00')")
    bookings = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("profile"), at.alias("at"))
    got = slots.next_slots(profiles, bookings, F.expr(_NOW), count=6)
    return got.select("profile", F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), F.date_format("at", "yyyy-MM-dd HH:mm").alias("at_utc"), "place")
