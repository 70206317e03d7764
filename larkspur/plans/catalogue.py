"""Every query of the library by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import email, phone, text, url
from larkspur.functions import time as clock
from larkspur.operators import analytics, enrich, nearby, quality_gate, resolve, upsert
from larkspur.plans.base import QUERIES, SQL, Query, query, streamed, t
from larkspur.plans.views import LEADS_SQL, leads

def queries() -> dict[str, Query]:
    from larkspur.plans import discovery, payloads, records, sequences, tables  # noqa: F401 - register their queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from larkspur.plans import discovery, payloads, records, sequences, tables  # noqa: F401

    return dict(SQL)


NOW = "2024-01-30 00:00:00"
TS = "timestamp '2024-01-30 00:00:00'"

# ---- Analytics ------------------------------------------------------------------------------------------------------


@query(f"with {LEADS_SQL} select count(*) as total, count(*) filter (where status = 'Qualified' or coalesce(score, 0) >= 70) as qualified, coalesce(round_even(avg(score), 1), 0.0) as avg_score from leads")
def leads_overview(spark, d):
    return analytics.overview(leads(spark, d))


@query(f"""with b as (select i, {TS} - to_days(7 * (8 - i)) as lo, {TS} - to_days(7 * (7 - i)) as hi from range(8) r(i))
select 'W' || (i + 1) as bucket, count(event_id) as n from b left join events on ts between lo and hi group by i""")
def leads_over_time_8w(spark, d):
    return analytics.weekly(t(spark, d, "events"), "ts", F.lit(NOW).cast("timestamp"))


@query(f"""with {LEADS_SQL}, c as (select case when coalesce(source, '') = '' then 'Unknown' else source end as source, count(*) as n, min(ordinal) as f from leads group by 1)
select source, n, cast(round_even(100.0 * n / (select sum(n) from c), 0) as int) as percent from c order by n desc, f limit 4""")
def source_split_top4(spark, d):
    return analytics.source_split(leads(spark, d))


@query(f"""with {LEADS_SQL}, k(place, status) as (values (0, 'New'), (1, 'Qualified'), (2, 'Contacted'), (3, 'Nurturing'), (4, 'Won'), (5, 'Lost')), c as (select status, count(*) as n, min(ordinal) as f from leads group by 1)
select coalesce(k.status, c.status) as status, coalesce(n, 0) as n, cast(row_number() over (order by coalesce(place, 6), coalesce(f, 0), c.status) as int) as place from k full join c on k.status = c.status""")
def status_breakdown_zero_filled(spark, d):
    return analytics.status_breakdown(leads(spark, d))


@query(f"""with s as (select n_regionkey as plan, count(*) as n from nation group by 1), e as (select count(*) as leads from customer)
select concat('plan_', plan) as plan, n, leads from s, e""")
def platform_dashboard(spark, d):
    plans = t(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))
    total = t(spark, d, "customer").agg(F.count("*").alias("leads"))  # one row
    return plans.join(F.broadcast(total), F.lit(True)).select(F.concat(F.lit("plan_"), F.col("n_regionkey").cast("string")).alias("plan"), "n", "leads")


@query("""with r as (select event_type as source, event_id % 3 <> 0 and event_type <> 'error' as ok, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events)
select source, count(*) as samples, round_even(avg(case when ok then 1.0 else 0.0 end), 3) as rate, avg(case when ok then 1.0 else 0.0 end) < 0.3 and count(*) >= 5 as unhealthy from r where rn <= 100 group by 1""")
def source_health_last100(spark, d):
    o = t(spark, d, "events").select(F.col("event_type").alias("source"), "ts", "event_id", ((F.col("event_id") % 3 != 0) & (F.col("event_type") != "error")).alias("ok"))
    return analytics.last_outcomes(o, "source", [F.desc("ts"), F.desc("event_id")])


@query("""select o_custkey % 25 as workspace, count(*) filter (where o_orderpriority like '1%') as composed, count(*) filter (where o_orderpriority like '2%') as ai, count(*) filter (where o_orderstatus = 'F') as delivered,
count(*) filter (where o_orderpriority like '1%') + count(*) filter (where o_orderpriority like '2%') as total from orders group by 1""")
def daily_send_counters(spark, d):
    o = t(spark, d, "orders")
    composed, ai = F.count_if(F.col("o_orderpriority").startswith("1")), F.count_if(F.col("o_orderpriority").startswith("2"))
    return o.groupBy((F.col("o_custkey") % 25).alias("workspace")).agg(composed.alias("composed"), ai.alias("ai"), F.count_if(F.col("o_orderstatus") == "F").alias("delivered"), (composed + ai).alias("total"))


@query(f"with {LEADS_SQL} select workspace_id, cast(floor(100.0 * count(*) filter (where status = 'Qualified') / count(*) + 0.5) as int) as conversion from leads group by 1")
def conversion_rate(spark, d):
    return leads(spark, d).groupBy("workspace_id").agg(F.floor(100 * F.count_if(F.col("status") == "Qualified") / F.count("*") + 0.5).cast("int").alias("conversion"))


@query("""select o_custkey as job, bool_and(o_orderstatus in ('F', 'O')) as finished, count(*) as items from orders group by 1""")
def job_terminal_status(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("job")).agg(F.every(F.col("o_orderstatus").isin("F", "O")).alias("finished"), F.count("*").alias("items"))


# ---- Workspace reads ------------------------------------------------------------------------------------------------


@query(f"""with {LEADS_SQL} select lead_id, name, email, address from leads
where concat_ws(chr(10), name, email, phone, website, address) ilike '%1 gulshan%' order by lead_id desc limit 25 offset 25""")
def lead_search_page(spark, d):
    found = analytics.search_page(leads(spark, d), "1 gulshan", ["name", "email", "phone", "website", "address"], [F.desc("lead_id")], page=2)
    return found.select("lead_id", "name", "email", "address")


@query("select n_nationkey, n_name from nation where n_name ilike '%a%'")
def workspace_search_ilike(spark, d):
    return t(spark, d, "nation").where(F.col("n_name").ilike("%a%")).select("n_nationkey", "n_name")


@query(f"with {LEADS_SQL} select count(*) as used from leads where source like 'Lead Discovery%' and ordinal >= 10")
def daily_import_used(spark, d):
    return leads(spark, d).where(F.col("source").startswith("Lead Discovery") & (F.col("ordinal") >= 10)).agg(F.count("*").alias("used"))


@query(f"with {LEADS_SQL} select lead_id, email, case when website_present then 'website' else 'non-website' end as site from leads where email is not null and email <> '' and not unsubscribed and not contacted order by lead_id desc limit 200")
def eligible_outreach_top200(spark, d):
    ok = text.filled(F.col("email")) & ~F.col("unsubscribed") & ~F.col("contacted")
    return leads(spark, d).where(ok).orderBy(F.desc("lead_id")).limit(200).select("lead_id", "email", F.when(F.col("website_present"), "website").otherwise("non-website").alias("site"))


@query("""select count(*) as used, greatest(0, 50 - count(*)) as remaining from events where event_type = 'click' and ts >= timestamp '2024-01-14 19:00:00' and ts < timestamp '2024-01-15 06:00:00'""")
def outreach_usage_local_day(spark, d):
    now = F.lit("2024-01-15 06:00:00").cast("timestamp")
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    used = e.where((F.col("event_type") == "click") & (F.col("ts") >= clock.local_midnight(now)) & (F.col("ts") < now)).agg(F.count("*").alias("used"))
    return used.select("used", F.greatest(F.lit(0).cast("long"), 50 - F.col("used")).alias("remaining"))


@query("""select n_nationkey as workspace_id, coalesce(l.n, 0) as leads, coalesce(m.n, 0) as members from nation
left join (select c_nationkey k, count(*) n from customer group by 1) l on l.k = n_nationkey left join (select s_nationkey k, count(*) n from supplier where s_acctbal > 5000 group by 1) m on m.k = n_nationkey""")
def workspace_usage_counts(spark, d):
    count = lambda df, k, name: df.groupBy(F.col(k).alias("workspace_id")).agg(F.count("*").alias(name))
    w = t(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"))
    w = w.join(count(t(spark, d, "customer"), "c_nationkey", "leads"), "workspace_id", "left").join(count(t(spark, d, "supplier").where("s_acctbal > 5000"), "s_nationkey", "members"), "workspace_id", "left")
    return w.select("workspace_id", F.coalesce("leads", F.lit(0)).cast("long").alias("leads"), F.coalesce("members", F.lit(0)).cast("long").alias("members"))


@query("select k as workspace_id, count(*) as seats from (select s_nationkey k from supplier union all select c_nationkey from customer where c_custkey % 10 = 0) group by 1")
def seats_used(spark, d):
    members = t(spark, d, "supplier").select(F.col("s_nationkey").alias("workspace_id"))
    invited = t(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_nationkey").alias("workspace_id"))
    return members.unionByName(invited).groupBy("workspace_id").agg(F.count("*").alias("seats"))


@query("""select s_name as name, 'active' as status, s_suppkey as created from supplier where s_nationkey = 7
union all select c_name, 'pending', c_custkey from customer where c_nationkey = 7 and c_custkey % 10 = 0""")
def team_listing(spark, d):
    members = t(spark, d, "supplier").where("s_nationkey = 7").select(F.col("s_name").alias("name"), F.lit("active").alias("status"), F.col("s_suppkey").alias("created"))
    invited = t(spark, d, "customer").where("c_nationkey = 7 and c_custkey % 10 = 0").select(F.col("c_name").alias("name"), F.lit("pending").alias("status"), F.col("c_custkey").alias("created"))
    return members.unionByName(invited).orderBy("created", "name")


@query("""select n_nationkey as workspace_id, r_name as flag, coalesce(o.enabled, r_regionkey % 2 = 0, false) as enabled from region, nation left join (select s_nationkey k, max(s_acctbal) > 9000 as enabled from supplier group by 1) o on o.k = n_nationkey""")
def feature_flag_effective(spark, d):
    over = t(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.max("s_acctbal") > 9000).alias("own"))
    both = t(spark, d, "nation").join(over, "n_nationkey", "left")
    # All flags ride along as one array: they are a list that an administrator keeps, and each workspace has every one.
    flags = t(spark, d, "region").agg(F.collect_list(F.struct("r_name", "r_regionkey")).alias("flags"))
    every = both.join(F.broadcast(flags), F.lit(True)).select("*", F.explode("flags").alias("f"))
    return every.select(F.col("n_nationkey").alias("workspace_id"), F.col("f.r_name").alias("flag"), F.coalesce("own", F.col("f.r_regionkey") % 2 == 0, F.lit(False)).alias("enabled"))


@query("""select s_suppkey as admin, case when s_suppkey % 10 = 0 then 5 else count(distinct l_shipmode) end as permissions from (select s_suppkey, l_returnflag as l_shipmode from supplier left join lineitem on l_suppkey = s_suppkey) group by 1""")
def admin_effective_permissions(spark, d):
    grants = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_returnflag").distinct().groupBy("s_suppkey").agg(F.collect_set("l_returnflag").alias("p"))
    s = t(spark, d, "supplier").select("s_suppkey").join(grants, "s_suppkey", "left")
    return s.select(F.col("s_suppkey").alias("admin"), F.when(F.col("s_suppkey") % 10 == 0, 5).otherwise(F.coalesce(F.size("p"), F.lit(0))).cast("long").alias("permissions"))


@query("select event_id, user_id, ts from events where event_type = 'purchase' and user_id < 50 order by ts desc, event_id desc limit 200")
def audit_filtered_page(spark, d):
    wanted = {"event_type": F.col("event_type") == "purchase", "actor": F.col("user_id") < 50, "target": None}
    e = t(spark, d, "events")
    for p in wanted.values():
        e = e if p is None else e.where(p)
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "ts")


@query("select o_orderkey as entry, c_name as name, o_orderdate as added_at from orders join customer on c_custkey = o_custkey where o_orderstatus = 'P'")
def crm_list(spark, d):
    o, c = t(spark, d, "orders").where("o_orderstatus = 'P'"), t(spark, d, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("entry"), F.col("c_name").alias("name"), F.col("o_orderdate").alias("added_at"))


@query("select count(*) filter (where o.k is null) as added, count(*) filter (where o.k is not null) as skipped from customer left join (select distinct o_custkey k from orders where o_orderstatus = 'P') o on o.k = c_custkey")
def crm_insert_if_absent(spark, d):
    new = t(spark, d, "customer").select(F.col("c_custkey").alias("lead_id"))
    old = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("lead_id"))
    return upsert.insert_absent(new, old, ["lead_id"], ["lead_id"])[1]


@query(f"with {LEADS_SQL} select lead_id, website_present, cast(row_number() over (partition by workspace_id, website_present order by coalesce(score, -1) desc, ordinal) as int) as place from leads")
def ai_filter_split(spark, d):
    w = Window.partitionBy("workspace_id", "website_present").orderBy(F.coalesce("score", F.lit(-1)).desc(), "ordinal")
    return leads(spark, d).select("lead_id", "website_present", F.row_number().over(w).alias("place"))


@query(f"with {LEADS_SQL} select lead_id, email from leads where not unsubscribed and lead_id in (select o_custkey from orders where o_orderstatus = 'P')")
def hot_leads_semi(spark, d):
    met = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("lead_id"))
    return leads(spark, d).where("not unsubscribed").join(met, "lead_id", "left_semi").select("lead_id", "email")


@query(f"""with {LEADS_SQL}, c as (select lead_id, lower(email) as email, phone from leads), w as (select * from leads where contacted)
select lead_id, coalesce(email in (select lower(email) from w where email is not null), false) or coalesce(replace(phone, ' ', '') in (select replace(phone, ' ', '') from w where phone is not null), false) as already_in_workspace from c""")
def already_in_workspace(spark, d):
    every = leads(spark, d)
    return upsert.mark_known(every.select("lead_id", "email", "phone"), every.where("contacted")).select("lead_id", "already_in_workspace")


@query(f"""with {LEADS_SQL}, k as (select lead_id, lower(email) as m, replace(phone, ' ', '') as p from leads)
select lead_id, coalesce(m in (select m from k where m <> '' group by m having count(*) > 1), false) or coalesce(p in (select p from k where p <> '' group by p having count(*) > 1), false) as already_in_workspace from k""")
def already_among_leads(spark, d):
    return upsert.mark_repeated(leads(spark, d).select("lead_id", "email", "phone")).select("lead_id", "already_in_workspace")


@query("""with l as (select *, row_number() over (partition by conv_id order by turn desc, role, text) rn from conversations)
select conv_id, turn, role, left(text, 80) as preview, conv_id in (select conv_id from conversations where role = 'system') as booked from l where rn = 1""")
def inbox_preview_latest(spark, d):
    c = t(spark, d, "conversations")
    last = analytics.latest(c, ["conv_id"], [F.desc("turn"), "role", "text"])
    booked = c.where("role = 'system'").select("conv_id").distinct().withColumn("b", F.lit(True))
    return last.join(booked, "conv_id", "left").select("conv_id", "turn", "role", F.left("text", F.lit(80)).alias("preview"), F.coalesce("b", F.lit(False)).alias("booked"))


@query("""select conv_id % 10 as account, count(*) filter (where role = 'user') as inbound, count(*) filter (where role = 'assistant') as outreach, count(*) filter (where role <> 'system') as total from conversations where conv_id in (select conv_id from conversations where turn >= 2) group by 1""")
def account_daily_stats(spark, d):
    c = t(spark, d, "conversations")
    active = c.join(c.where("turn >= 2").select("conv_id").distinct(), "conv_id", "left_semi")
    return active.groupBy((F.col("conv_id") % 10).alias("account")).agg(F.count_if(F.col("role") == "user").alias("inbound"), F.count_if(F.col("role") == "assistant").alias("outreach"), F.count_if(F.col("role") != "system").alias("total"))


@query("""select o_orderkey as sequence, coalesce(string_agg(cast(l_linenumber as varchar) || ':' || l_returnflag, ',' order by l_linenumber, l_returnflag), '') as steps from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def sequence_steps_nested(spark, d):
    steps = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("s"))
    said = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_returnflag"])), ",")
    return t(spark, d, "orders").join(steps, "o_orderkey", "left").select(F.col("o_orderkey").alias("sequence"), F.coalesce(said, F.lit("")).alias("steps"))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus <> 'F' order by o_orderdate asc nulls last, o_orderkey limit 20")
def prewarm_batch(spark, d):
    return t(spark, d, "orders").where("o_orderstatus <> 'F'").orderBy(F.col("o_orderdate").asc_nulls_last(), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("""with l as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) rn from events)
select user_id, event_type, event_id, ts + to_hours(24) < timestamp '2024-01-20 00:00:00' as expired from l where rn = 1""")
def cache_lookup(spark, d):
    last = analytics.latest(t(spark, d, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    now = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return last.select("user_id", "event_type", "event_id", clock.expired(F.col("ts") + F.expr("interval 24 hours"), now).alias("expired"))


@query("""with k as (select user_id as m, case event_type when 'view' then 'delivered' when 'click' then 'clicked' when 'error' then 'bounced' end as status, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events where event_type in ('view', 'click', 'error')),
m as (select distinct user_id as provider_message_id from events) select provider_message_id, coalesce(status, 'queued') as status from m left join k on k.m = provider_message_id and rn = 1""")
def delivery_status_latest(spark, d):
    e = t(spark, d, "events")
    messages = e.select(F.col("user_id").alias("provider_message_id"), F.lit("queued").alias("status"), F.lit(None).cast("timestamp_ntz").alias("sent_at")).distinct()
    feed = e.select(F.col("user_id").alias("provider_message_id"), F.col("event_type").alias("event"), "ts", "event_id")
    return upsert.apply_delivery(messages, feed, {"view": "delivered", "click": "clicked", "error": "bounced"}).select("provider_message_id", "status")


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def idempotent_events(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""with c as (select c_custkey as ordinal, c_custkey % 3 = 0 as dup from customer), n as (select *, sum(case when dup then 0 else 1 end) over (order by ordinal) as n from c)
select ordinal, case when n > 60 and not dup then 'daily_limit_reached' when n >= 60 and dup then 'daily_limit_reached' when dup then 'duplicate' else 'imported' end as outcome from n""")
def import_classification(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("ordinal"), (F.col("c_custkey") % 3 == 0).alias("dup"))
    return upsert.classify_import(rows, F.col("dup"), used_today=40, daily_limit=100, used=0, quota=1_000_000).select("ordinal", "outcome")


@query(f"""with {LEADS_SQL}, u as (select email, lead_id, 0 as p from leads where contacted union all select email, lead_id, 1 from leads where not unsubscribed), r as (select *, row_number() over (partition by email order by p, lead_id) rn from u where email is not null)
select email, lead_id, p from r where rn = 1""")
def contact_select_merge(spark, d):
    every = leads(spark, d).where("email is not null")
    both = every.where("contacted").select("email", "lead_id", F.lit(0).alias("p")).unionByName(every.where("not unsubscribed").select("email", "lead_id", F.lit(1).alias("p")))
    return analytics.latest(both, ["email"], ["p", "lead_id"])


@query("""with s as (select timestamp '2024-01-15 09:00:00' + to_minutes(cast(30 * i as bigint)) as slot from range(16) r(i)), b as (select distinct timestamp '2024-01-15 09:00:00' + to_minutes(cast(n_nationkey * 25 as bigint)) as booked from nation where n_nationkey % 4 = 0)
select slot from s where not exists (select 1 from b where slot < booked + to_minutes(30) and booked < slot + to_minutes(30))""")
def meeting_slots(spark, d):
    first, last = "timestamp_ntz '2024-01-15 09:00:00'", "timestamp_ntz '2024-01-15 16:30:00'"
    slots = spark.range(1).select(F.explode(F.expr(f"sequence({first}, {last}, interval 30 minutes)")).alias("slot"))
    # A booking of half an hour touches the slot it starts in and, off the grid, the one after it: an equi join, whatever the number of bookings.
    at = t(spark, d, "nation").where("n_nationkey % 4 = 0").select((F.col("n_nationkey") * 25).cast("long").alias("m"))
    slot = F.floor(F.col("m") / 30).cast("long") * 30
    taken = at.select(F.explode(F.when(F.col("m") % 30 == 0, F.array("m")).otherwise(F.array(slot, slot + 30))).alias("m")).distinct()
    return slots.withColumn("m", F.expr(f"timestampdiff(MINUTE, {first}, slot)")).join(taken, "m", "left_anti").select("slot")


_CITIES = "select n_nationkey as city, n_regionkey as country, cast(n_nationkey * 7 % 120 as double) - 60 as lat, cast(n_nationkey * 13 % 300 as double) - 150 as lon from nation"


@query(f"""with c as ({_CITIES}), p as (select a.city, b.city as near, 2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) as km from c a join c b on a.country = b.country and a.city <> b.city)
select city, near, round(km, 3) as km, cast(rn as int) as place from (select *, row_number() over (partition by city order by round(km, 6), near) rn from p) where rn <= 3""")
def nearby_cities(spark, d):
    c = t(spark, d, "nation").selectExpr("n_nationkey as city", "n_regionkey as country", "cast(n_nationkey * 7 % 120 as double) - 60 as lat", "cast(n_nationkey * 13 % 300 as double) - 150 as lon")
    return nearby.nearest(c, 3).withColumn("km", F.round("km", 3))


@query("""with k(place, key) as (values (0, 'widget'), (1, 'gadget'), (2, 'gizmo'), (3, 'bolt')) select p_partkey, p_name, coalesce((select key from k where p_name like '%' || key || '%' order by place limit 1), lower(p_name)) as niche from part""")
def niche_canonical(spark, d):
    keys = ["widget", "gadget", "gizmo", "bolt"]
    chain = F.coalesce(*(F.when(F.contains("p_name", F.lit(k)), F.lit(k)) for k in keys), F.lower("p_name"))
    return t(spark, d, "part").select("p_partkey", "p_name", chain.alias("niche"))


@query("select n_name, case when lower(n_name) like 'a%' then 0 else 1 end as place from nation where lower(n_name) like '%a%'")
def country_typeahead(spark, d):
    n = F.lower("n_name")
    return t(spark, d, "nation").where(F.contains(n, F.lit("a"))).select("n_name", F.when(n.startswith("a"), 0).otherwise(1).alias("place"))


# ---- Contacts from texts and pages ----------------------------------------------------------------------------------

_MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


_LISTED = f"""with r as (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{_MAIL}'), lambda x: lower(x)) as l from documents),
f as (select doc_id, list_filter(l, lambda x: not list_contains({email.BLOCKED_DOMAINS}, split_part(x, '@', 2)) and not list_contains({email.ASSET_ENDINGS}, regexp_extract(x, '[^.]*$'))) as l from r),
m as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:40] as e from f)"""


@query(f"{_LISTED} select doc_id, array_to_string(e, ',') as emails, len(e) as n from m")
def doc_emails(spark, d):
    e = email.collect_emails(F.coalesce("text", F.lit("")))
    return t(spark, d, "documents").select("doc_id", e.alias("e")).select("doc_id", F.array_join("e", ",").alias("emails"), F.size("e").cast("long").alias("n"))


_DESK = f"""case when list_contains({email.DISPOSABLE}, split_part(e, '@', 2)) then -40 else 0 end + case when regexp_matches(split_part(e, '@', 1), '{email.PLACEHOLDER}') then -25 else 0 end
+ case when list_contains({email.SYSTEM_LOCALS}, split_part(e, '@', 1)) then -30 when list_contains({email.GOOD_LOCALS}, split_part(e, '@', 1)) then 10 else 0 end + case when e like '%.gov' or e like '%.edu' then -5 else 0 end"""


@query(f"""{_LISTED}, x as (select doc_id, unnest(e) as e, generate_subscripts(e, 1) as i from m), s as (select *, row_number() over (partition by doc_id order by {_DESK} desc, i) as rn from x)
select doc_id, e as best from s where rn = 1 and not (list_contains({email.DISPOSABLE}, split_part(e, '@', 2)) and regexp_matches(split_part(e, '@', 1), '{email.PLACEHOLDER}'))""")
def doc_best_email(spark, d):
    found = t(spark, d, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", email.best_email(F.col("text")).alias("best"))
    return found.where("best is not null")


@query()
def doc_phones(spark, d):
    """Every document's numbers and the best of them."""
    docs = t(spark, d, "documents").where(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", phone.collect_phones(F.col("text")).alias("p"), phone.best_phone(F.col("text"), "US").alias("best")).where(F.size("p") > 0).select("doc_id", F.array_join("p", "|").alias("phones"), "best")


@query(f"""with {LEADS_SQL}, p as (select lead_id, phone, regexp_replace(phone, '[^0-9]', '', 'g') as d from leads)
select lead_id, case when length(d) < 7 then null when starts_with(phone, '+') and length(d) >= 11 then '+' || d else d end as normal, right(d, 10) as merge_key from p where phone is not null""")
def phone_normalise(spark, d):
    p = leads(spark, d).where("phone is not null")
    return p.select("lead_id", phone.normalize_phone(F.col("phone"), "US").alias("normal"), phone.merge_key(F.col("phone")).alias("merge_key"))


@query("""select page_id, nullif(left(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), 280), '') as title, regexp_extract(html, 'charset="([^"]*)"', 1) as charset from pages""")
def page_titles(spark, d):
    h = F.col("html")
    return t(spark, d, "pages").select("page_id", F.nullif(F.left(F.trim(F.regexp_extract(h, "<title>([^<]*)</title>", 1)), F.lit(280)), F.lit("")).alias("title"), F.regexp_extract(h, 'charset="([^"]*)"', 1).alias("charset"))


@query("""select page_id, nullif(left(trim(regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)), 280), '') as description from pages""")
def page_meta_description(spark, d):
    return t(spark, d, "pages").select("page_id", url.meta_description(F.col("html")).alias("description"))


@query("""select page_id, len(regexp_extract_all(html, '(?is)<a[^>]+href=["'']([^"''#]+)["''][^>]*>(.*?)</a>')) as links from pages""")
def page_links(spark, d):
    return t(spark, d, "pages").select("page_id", F.size(url.anchors(F.col("html"))).cast("long").alias("links"))


@query()
def page_contact_pages(spark, d):
    return t(spark, d, "pages").select("page_id", F.explode(url.contact_pages(F.col("url"), F.col("html"))).alias("page"))


@query("""with u as (select page_id, url, case when regexp_matches(trim(url), '^https?://') then trim(url) else 'https://' || trim(url) end as f from pages),
p as (select *, regexp_replace(lower(regexp_extract(f, '^[a-z]+://([^/?#]*)', 1)), '^www[.]', '') as host, regexp_replace(regexp_extract(f, '^[a-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') as path from u)
select page_id, case when host <> '' then 'https://' || host || case when path = '/' then path else rtrim(path, '/') end end as site, split_part(regexp_replace(lower(url), '^https?://(www[.])?', ''), '/', 1) as key from p""")
def url_normalise(spark, d):
    return t(spark, d, "pages").select("page_id", url.normalize_website(F.col("url")).alias("site"), url.website_key(F.col("url")).alias("key"))


@query("select doc_id, regexp_matches(lower(text), '" + "|".join(text.LEAVE_ME).replace("'", "''") + "') as wants_out from documents")
def unsubscribe_flags(spark, d):
    return t(spark, d, "documents").select("doc_id", text.wants_out(F.col("text")).alias("wants_out"))


@query("""with p as (select p_partkey, list_distinct(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: length(w) > 1)) as a, list_distinct(list_filter(regexp_extract_all(lower(p_type || ' widget'), '[a-z0-9]+'), lambda w: length(w) > 1)) as b from part)
select p_partkey, round(len(list_intersect(a, b)) / greatest(len(a), len(b)), 4) as similarity from p""")
def name_similarity(spark, d):
    s = text.name_similarity(F.col("p_name"), F.concat("p_type", F.lit(" widget")))
    return t(spark, d, "part").select("p_partkey", F.round(s, 4).alias("similarity"))


@query(r"""select s_suppkey, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') as key, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') as slug, left(s_name, 8) || '••••' as masked from supplier""")
def name_keys(spark, d):
    n = F.col("s_name")
    return t(spark, d, "supplier").select("s_suppkey", text.normalize_name(n).alias("key"), text.slug(n).alias("slug"), text.masked(n).alias("masked"))


@query(r"""select doc_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as plain from (select page_id as doc_id, html from pages)""")
def strip_page_tags(spark, d):
    return t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), text.strip_tags(F.col("html")).alias("plain"))


# ---- Entity resolution ----------------------------------------------------------------------------------------------


@query(f"""with {LEADS_SQL} select lead_id, case when trim(coalesce(name, '')) <> '' then 10 else 0 end + case when trim(coalesce(address, '')) <> '' then 15 else 0 end + case when trim(coalesce(phone, '')) <> '' then 20 else 0 end
+ case when trim(coalesce(email, '')) <> '' then 25 else 0 end + case when trim(coalesce(website, '')) <> '' then 20 else 0 end as completeness from leads""")
def completeness(spark, d):
    return leads(spark, d).select("lead_id", quality_gate.completeness().alias("completeness"))


@query(f"""with {LEADS_SQL} select lead_id, lower(email) as email from leads where phone is not null or email is not null or website <> '' or (name <> '' and trim(coalesce(address, '')) <> '' and lat between -90 and 90 and lon between -180 and 180)""")
def validation_gate(spark, d):
    return quality_gate.gate(leads(spark, d), "US").select("lead_id", "email")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Leads as records of several sources that share names, phones and sites now and then."""
    source = F.element_at(F.array(*map(F.lit, [*resolve.SOURCES, "bing_maps"])), (F.col("ordinal") % 9 + 1).cast("int"))
    few = F.concat(F.lit("Shop "), (F.col("ordinal") % 1301).cast("string"), F.when(F.col("ordinal") % 5 == 0, " Ltd").otherwise(""))
    return leads(spark, d).select(F.col("ordinal").cast("long").alias("ordinal"), few.alias("name"), "phone", "email", F.nullif("website", F.lit("")).alias("website"), "address", source.alias("source"), "lat", "lon", F.col("score").alias("review_count"))


_GROUPS = "ordinal - ordinal % 7"


@query(f"""with {LEADS_SQL}, r as (select ordinal, {_GROUPS} as g, phone, email, address, list_position(['google_maps', 'directory', 'openstreetmap', 'web_search', 'wikidata', 'wikipedia', 'certtransparency', 'dns'], ['google_maps', 'directory', 'openstreetmap', 'web_search', 'wikidata', 'wikipedia', 'certtransparency', 'dns', 'bing_maps'][ordinal % 9 + 1]) as p from leads),
k as (select *, coalesce(p - 1, 8) as rk from r), s as (select *, max(case when ordinal = g then rk end) over (partition by g) as r0 from k)
select g as group_id, count(*) as members, coalesce(arg_max(phone, ordinal) filter (where phone <> '' and rk < r0), arg_min(phone, ordinal) filter (where phone <> '')) as phone, coalesce(arg_max(email, ordinal) filter (where email <> '' and rk < r0), arg_min(email, ordinal) filter (where email <> '')) as email,
coalesce(arg_max(address, ordinal) filter (where address <> '' and rk < r0), arg_min(address, ordinal) filter (where address <> '')) as address from s group by 1""")
def merge_resolution_fields(spark, d):
    c = candidates(spark, d)
    groups = c.select("ordinal", (F.col("ordinal") - F.col("ordinal") % 7).alias("group_id"))
    return resolve.resolve(c, groups).select("group_id", "members", "phone", "email", "address")


_ASSIGN = rf"""with recursive {LEADS_SQL}, c as (select ordinal, 'shop ' || ordinal % 1301 || case when ordinal % 5 = 0 then ' ltd' else '' end as name, phone, website from leads),
k as (select ordinal, regexp_replace(regexp_replace(name, '\bltd\b', '', 'g'), '[^a-z0-9]+', '', 'g') as kn, nullif(right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 10), '') as kp, nullif(split_part(regexp_replace(lower(coalesce(website, '')), '^https?://(www\.)?', ''), '/', 1), '') as ks from c),
f as (select *, min(ordinal) over (partition by kn) as fn, min(ordinal) over (partition by kp) as fp, min(ordinal) over (partition by ks) as fs from k),
p as (select ordinal, coalesce(case when fn < ordinal then fn end, case when kp is not null and fp < ordinal then fp end, case when ks is not null and fs < ordinal then fs end, ordinal) as parent from f),
r as (select ordinal, ordinal as root from p where parent = ordinal union all select p.ordinal, r.root from p join r on p.parent = r.ordinal where p.parent <> p.ordinal)
select ordinal, root as group_id from r"""


@query(_ASSIGN)
def merge_assignment(spark, d):
    return resolve.assign(candidates(spark, d))


_ORDER = "['google_maps', 'directory', 'openstreetmap', 'web_search', 'wikidata', 'wikipedia', 'certtransparency', 'dns']"
_LAST_BETTER = ", ".join(f"coalesce(arg_max({c}, ordinal) filter (where {c} <> '' and rk < r0), arg_min({c}, ordinal) filter (where {c} <> '')) as {c}" for c in ("phone", "website", "email", "address"))


@query(_ASSIGN.replace("select ordinal, root as group_id from r", f""", x as (select r.ordinal, r.root as g, 'Shop ' || l.ordinal % 1301 || case when l.ordinal % 5 = 0 then ' Ltd' else '' end as name, list_append({_ORDER}, 'bing_maps')[l.ordinal % 9 + 1] as source, l.phone, l.website, l.email, l.address, l.score, l.lat, l.lon from r join leads l on l.ordinal = r.ordinal),
y as (select *, coalesce(nullif(list_position({_ORDER}, source), 0), 9) as rk from x), z as (select *, max(case when ordinal = g then rk end) over (partition by g) as r0 from y)
select g as group_id, count(*) as members, max(case when ordinal = g then name end) as name, max(case when ordinal = g then source end) as source, {_LAST_BETTER}, arg_min(score, ordinal) filter (where score <> 0) as review_count, arg_min(lat, ordinal) as lat, arg_min(lon, ordinal) as lon from z group by 1"""))
def merge_businesses(spark, d):
    return resolve.merge(candidates(spark, d))


@query(f"""with {LEADS_SQL}, f as (select o_custkey as lead_id, max(o_orderpriority) as address from orders group by 1)
select l.lead_id, case when coalesce(l.address, '') <> '' then l.address else f.address end as address, case when coalesce(l.address, '') = '' and coalesce(f.address, '') <> '' then 'website' end as enrichment_source from leads l left join f on f.lead_id = l.lead_id""")
def enrichment_gap_fill(spark, d):
    found = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("lead_id")).agg(F.max("o_orderpriority").alias("address"))
    return enrich.fill_gaps(leads(spark, d), found, "lead_id").select("lead_id", "address", "enrichment_source")


@query(f"""with {LEADS_SQL}, s as (select o_custkey as lead_id, cast(floor(max(o_totalprice) / 1000) as int) - 100 as score from orders group by 1)
select l.lead_id, case when s.score is null then l.score else least(greatest(s.score, 0), 100) end as score, case when s.score is null then l.status when s.score >= 70 then 'Qualified' else 'New' end as status from leads l left join s on s.lead_id = l.lead_id""")
def score_to_status(spark, d):
    scores = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("lead_id")).agg((F.floor(F.max("o_totalprice") / 1000).cast("int") - 100).alias("score"))
    return enrich.score_status(leads(spark, d), scores).select("lead_id", "score", "status")


@query("""with k(place, key) as (values (0, 'widget'), (1, 'cold gadget'), (2, 'gizmo part'), (3, 'bolt'))
select p_partkey, coalesce((select key from k where key = lower(p_name)), (select key from k where contains(lower(p_name), key) or contains(key, lower(p_name)) order by place limit 1),
(select key from k where len(list_intersect(string_split(key, ' '), string_split(lower(p_name), ' '))) > 0 order by len(list_intersect(string_split(key, ' '), string_split(lower(p_name), ' '))) desc, place limit 1), lower(p_name)) as niche_key from part""")
def niche_by_words(spark, d):
    return enrich.canonical_niche(t(spark, d, "part"), "p_name", ["widget", "cold gadget", "gizmo part", "bolt"]).select("p_partkey", "niche_key")


@query("select c_custkey, c_name from customer where c_nationkey = 7 and c_acctbal > 1000 and c_name like '%1%' order by c_custkey")
def bound_text_query(spark, d):
    args = {"ws": 7, "least": 1000, "q": "%1%"}
    return spark.sql("select c_custkey, c_name from {c} where c_nationkey = :ws and c_acctbal > :least and c_name like :q order by c_custkey", args=args, c=t(spark, d, "customer"))


@query(f"""with {LEADS_SQL}, v as (select ordinal, case when ordinal % 3 = 0 then 1 when ordinal % 3 = 1 then 2 else 3 end as tier from leads where email is not null), n as (select tier, count(*) n from v group by 1), b as (select tier, coalesce(sum(n) over (order by tier rows between unbounded preceding and 1 preceding), 0) as before from n)
select ordinal, tier from v where tier in (select tier from b where before < 500)""")
def fill_ladder_tiers(spark, d):
    v = leads(spark, d).where("email is not null").select("ordinal", F.when(F.col("ordinal") % 3 == 0, 1).when(F.col("ordinal") % 3 == 1, 2).otherwise(3).alias("tier"))
    return quality_gate.tiers_until(v, 500)


@query(f"""with {LEADS_SQL}, v as (select ordinal, cast(case when email is not null then 25 else 0 end + case when phone is not null then 20 else 0 end as int) as completeness from leads order by ordinal limit 300) select * from v""")
def cut_then_rank(spark, d):
    score = F.when(F.col("email").isNotNull(), 25).otherwise(0) + F.when(F.col("phone").isNotNull(), 20).otherwise(0)
    return quality_gate.cut_then_rank(leads(spark, d).select("ordinal", score.alias("completeness")), 300)


# ---- Streams --------------------------------------------------------------------------------------------------------


@query("select event_id, event_type from events")
def stream_dedup(spark, d):
    from larkspur.streaming.ingest import deduplicated

    return streamed(spark, d, lambda e: deduplicated(e, "event_id").select("event_id", "event_type"), "append").select("event_id", "event_type")
