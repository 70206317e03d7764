"""Queries over single workspaces' records: updates, conversations, accounts, retention, plans, text and list columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import text, url
from larkspur.functions import time as clock
from larkspur.operators import records, resolve
from larkspur.plans.base import query, streamed, t
from larkspur.plans.catalogue import candidates
from larkspur.plans.views import LEADS_SQL, leads


@query(f"""with {LEADS_SQL}, u as (select lead_id, workspace_id, email, 'user' || (lead_id * 7 % 997) || '@mail' || (lead_id * 7 % 50) || '.example.org' as new_email from leads),
b as (select u.*, exists (select 1 from leads l where l.workspace_id = u.workspace_id and lower(l.email) = u.new_email and l.lead_id <> u.lead_id) as blocked from u) select lead_id, case when blocked then email else new_email end as email, blocked from b""")
def lead_update_guard(spark, d):
    every = leads(spark, d)
    n = F.col("lead_id") * 7
    asked = every.select("lead_id", "workspace_id", F.concat(F.lit("user"), n % 997, F.lit("@mail"), n % 50, F.lit(".example.org")).alias("new_email"))
    return records.guarded_update(every, asked)


@query(f"with {LEADS_SQL} select lead_id, email from leads where lower(email) = 'user7@mail7.example.org' or lead_id = 42 order by lead_id limit 1")
def lead_by_email_or_id(spark, d):
    return leads(spark, d).where((F.lower("email") == "user7@mail7.example.org") | (F.col("lead_id") == 42)).orderBy("lead_id").limit(1).select("lead_id", "email")


@query(f"with {LEADS_SQL} select lead_id, email from leads where lower(email) in ('user7@mail7.example.org', 'user8@mail8.example.org') or lead_id in (1, 2, 3, 5, 8)")
def leads_in_lists(spark, d):
    return leads(spark, d).where(F.lower("email").isin("user7@mail7.example.org", "user8@mail8.example.org") | F.col("lead_id").isin(1, 2, 3, 5, 8)).select("lead_id", "email")


@query(f"with {LEADS_SQL} select lead_id from leads where lower(email) <> 'user' || (lead_id % 500) || '@mail' || (lead_id % 50) || '.example.org'")
def inbound_without_own(spark, d):
    own = F.concat(F.lit("user"), F.col("lead_id") % 500, F.lit("@mail"), F.col("lead_id") % 50, F.lit(".example.org"))
    return leads(spark, d).where(F.lower("email") != own).select("lead_id")


@query("with c as (select conv_id, max(turn) as last_turn from conversations group by 1) select m.conv_id, m.turn, m.role, c.last_turn from conversations m join c on c.conv_id = m.conv_id where m.role = 'user'")
def messages_of_conversations(spark, d):
    m = t(spark, d, "conversations")
    c = m.groupBy("conv_id").agg(F.max("turn").alias("last_turn"))
    return m.where("role = 'user'").join(c, "conv_id").select("conv_id", "turn", "role", "last_turn")


@query("""select c_custkey as template, case r.s when 'O' then 'APPROVED' when 'P' then 'PENDING' when 'F' then 'REJECTED' else 'NOT_SUBMITTED' end as status from customer left join (select o_custkey, max(o_orderstatus) as s from orders group by 1) r on r.o_custkey = c_custkey""")
def template_remote_status(spark, d):
    remote = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("template")).agg(F.max("o_orderstatus").alias("s"))
    s = F.col("s")
    status = F.when(s == "O", "APPROVED").when(s == "P", "PENDING").when(s == "F", "REJECTED").otherwise("NOT_SUBMITTED")
    return t(spark, d, "customer").select(F.col("c_custkey").alias("template")).join(remote, "template", "left").select("template", status.alias("status"))


@query("select o_orderkey as message, c_custkey as account, c_custkey is null as quarantined from orders left join customer on c_custkey = o_custkey and c_acctbal > 0")
def account_routing(spark, d):
    accounts = t(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("account"))
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("message"), "o_custkey")
    return o.join(accounts, F.col("o_custkey") == F.col("account"), "left").select("message", "account", F.col("account").isNull().alias("quarantined"))


@query("select event_id, user_id % 30 as workspace_id from events join nation on n_nationkey = user_id % 30 and n_nationkey % 3 = event_id % 3")
def stream_webhook_leads(spark, d):
    from larkspur.streaming.ingest import authorised

    known = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("workspace_id"), F.concat(F.lit("t"), F.col("n_nationkey") % 3).alias("token"))
    sent = lambda e: e.select("event_id", (F.col("user_id") % 30).alias("workspace_id"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("token"))
    return streamed(spark, d, lambda e: authorised(sent(e), known).select("event_id", "workspace_id"), "append").select("event_id", "workspace_id")


@query("""with k as (select user_id as message, case event_type when 'view' then 'delivered' when 'click' then 'clicked' when 'error' then 'bounced' end as status, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type in ('view', 'click', 'error'))
select message, status from k where rn = 1""")
def stream_delivery_latest(spark, d):
    from larkspur.operators import analytics
    from larkspur.streaming.ingest import latest_status

    said = F.when(F.col("event_type") == "view", "delivered").when(F.col("event_type") == "click", "clicked").when(F.col("event_type") == "error", "bounced")
    feed = lambda e: e.select(F.col("user_id").alias("message"), said.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id").where("status is not null")
    rows = streamed(spark, d, lambda e: latest_status(feed(e), "message"), "update")
    return analytics.latest(rows, ["message"], [F.desc("batch_")]).select("message", "status")


@query(f"with {LEADS_SQL} select lead_id, cast(coalesce(email, '') <> '' as int) + cast(coalesce(phone, '') <> '' as int) + cast(coalesce(website, '') <> '' as int) as present from leads")
def contact_presence(spark, d):
    return leads(spark, d).select("lead_id", records.presence("email", "phone", "website").alias("present"))


_NINE = "['google_maps', 'directory', 'openstreetmap', 'web_search', 'wikidata', 'wikipedia', 'certtransparency', 'dns', 'bing_maps']"


@query(f"""with {LEADS_SQL}, k as (select unnest({_NINE}) as source), c as (select {_NINE}[ordinal % 9 + 1] as source, count(*) as n from leads where website <> '' group by 1) select k.source, coalesce(c.n, 0) as n from k left join c on c.source = k.source""")
def counts_by_source(spark, d):
    n = candidates(spark, d).where("website is not null").groupBy("source").agg(F.count("*").alias("n"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, [*resolve.SOURCES, "bing_maps"]))).alias("source"))
    return every.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("select s_suppkey as admin, s_acctbal > 5000 and count(*) filter (where s_acctbal > 5000) over (partition by s_nationkey) <= 1 as blocked from supplier")
def last_admin_guard(spark, d):
    return records.revocable(t(spark, d, "supplier"), "s_nationkey", F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("admin"), "blocked")


_HELD = "select o_orderkey as conversation, o_orderkey % 3 as account, case when o_orderkey % 7 = 0 then null else concat('User', cast(o_custkey % 701 as varchar(20)), '@X.org') end as customer_email, case when o_orderstatus = 'F' then '' else o_orderpriority end as thread_id, case when o_orderkey % 2 = 0 then null else 'known' end as customer_name, o_orderdate as created_at from orders"
_ASKS = "select c_custkey as ordinal, c_custkey % 4 as account, case when c_custkey % 11 = 0 then ' ' else concat(' user', cast(c_custkey * 3 % 997 as varchar(20)), '@x.ORG') end as customer_email, case when c_custkey % 3 = 0 then '' else c_name end as customer_name, case c_custkey % 4 when 0 then null when 1 then 're: ' || c_mktsegment when 2 then ' ' else c_mktsegment end as subject, case when c_custkey % 5 = 0 then null else 'new' || c_custkey end as thread_id from customer"


@query(f"""with h as (select *, lower(customer_email) as key, row_number() over (partition by account, lower(customer_email) order by created_at, conversation) as rn from ({_HELD}) where customer_email is not null),
a as (select *, nullif(lower(trim(customer_email)), '') as key from ({_ASKS})), f as (select *, min(ordinal) over (partition by account, key) as first, first_value(nullif(thread_id, '') ignore nulls) over (partition by account, key order by ordinal rows between unbounded preceding and unbounded following) as new_thread,
first_value(nullif(customer_name, '') ignore nulls) over (partition by account, key order by ordinal rows between unbounded preceding and unbounded following) as new_name, first_value(trim(customer_email)) over (partition by account, key order by ordinal) as spelt, first_value(coalesce(customer_name, '')) over (partition by account, key order by ordinal) as asker, first_value(coalesce(trim(subject), '')) over (partition by account, key order by ordinal) as about from a)
select f.ordinal, f.account, h.conversation, case when f.key is not null then h.conversation is null and f.ordinal = f.first end as created,
case when f.key is not null and h.conversation is null then case when about = '' then 'Re: Conversation with ' || case when asker = '' then spelt else asker end when starts_with(lower(about), 're:') then about else 'Re: ' || about end end as subject,
case when f.key is not null then coalesce(nullif(h.thread_id, ''), new_thread) end as thread_id, case when f.key is not null then coalesce(h.customer_name, new_name) end as customer_name from f left join h on h.account = f.account and h.key = f.key and h.rn = 1""")
def find_or_create_conversation(spark, d):
    held = spark.sql(_HELD.replace("varchar(20)", "string").replace("from orders", "from {o}"), o=t(spark, d, "orders"))
    asked = spark.sql(_ASKS.replace("varchar(20)", "string").replace("from customer", "from {c}"), c=t(spark, d, "customer"))
    return records.find_or_create(held, asked).select("ordinal", "account", "conversation", "created", "subject", "thread_id", "customer_name")


@query("with r as (select *, row_number() over (partition by s_nationkey order by s_acctbal > 5000 desc, s_suppkey) as rn from supplier) select s_nationkey as workspace_id, s_suppkey as account from r where rn = 1")
def active_else_first_account(spark, d):
    got = records.account_choice(t(spark, d, "supplier"), "s_nationkey", F.col("s_acctbal") > 5000, ["s_suppkey"])
    return got.select(F.col("s_nationkey").alias("workspace_id"), F.col("s_suppkey").alias("account"))


@query("""with p as (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 20 offset 20), l as (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey) as rn from lineitem where l_orderkey in (select o_orderkey from p))
select o_orderkey as conversation, o_orderdate as updated_at, l_partkey as preview from p left join l on l_orderkey = o_orderkey and rn = 1""")
def inbox_page_by_update(spark, d):
    c = t(spark, d, "orders").select(F.col("o_orderkey").alias("conversation"), F.col("o_orderdate").alias("updated_at"))
    m = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("conversation"), F.col("l_partkey").alias("preview"), "l_linenumber")
    return records.inbox_page(c, m, "conversation", "updated_at", [F.desc("l_linenumber"), "preview"], 2, 20).select("conversation", "updated_at", "preview")


@query(f"with {LEADS_SQL} select count(*) as total, least(count(*), 25) as shown from leads where concat_ws(chr(10), name, email, phone, website, address) ilike '%gulshan%'")
def lead_search_total(spark, d):
    hit = F.concat_ws("\n", "name", "email", "phone", "website", "address").ilike("%gulshan%")
    return leads(spark, d).where(hit).agg(F.count("*").alias("total")).select("total", F.least("total", F.lit(25)).cast("long").alias("shown"))


@query("select event_id, event_type from events where ts >= timestamp '2024-01-15 00:00:00'")
def retention_before_today(spark, d):
    return records.since(t(spark, d, "events"), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


@query("""select n_nationkey as workspace_id, coalesce(case when n_nationkey % 4 = 0 then 99 end, r_regionkey * 100) as leads_quota, coalesce(case when n_nationkey % 6 = 0 then 7 end, r_regionkey + 1) as seats_quota from nation left join region on r_regionkey = n_regionkey""")
def plan_quotas(spark, d):
    w = t(spark, d, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_regionkey").alias("plan"), F.when(F.col("n_nationkey") % 4 == 0, 99).alias("own_leads_quota"), F.when(F.col("n_nationkey") % 6 == 0, 7).alias("own_seats_quota"))
    plans = t(spark, d, "region").select(F.col("r_regionkey").alias("plan"), (F.col("r_regionkey") * 100).alias("leads_quota"), (F.col("r_regionkey") + 1).alias("seats_quota"))
    return records.with_plan(w, plans, "plan", ["leads_quota", "seats_quota"]).select("workspace_id", "leads_quota", "seats_quota")


@query("select 0 as source_rank, s_suppkey as ordinal, s_name as name, cast(null as varchar) as segment from supplier union all select 1, c_custkey, c_name, c_mktsegment from customer union all select 2, p_partkey, p_name, null from part")
def sources_in_order(spark, d):
    some = lambda name, p, *more: t(spark, d, name).select(F.col(p[0]).alias("ordinal"), F.col(p[1]).alias("name"), *more)
    return records.in_order([some("supplier", ("s_suppkey", "s_name")), some("customer", ("c_custkey", "c_name"), F.col("c_mktsegment").alias("segment")), some("part", ("p_partkey", "p_name"))])


@query(f"with {LEADS_SQL} select lead_id, coalesce(nullif(case when ordinal % 3 = 0 then '' else company end, ''), 'KARACHI') as result_city, ordinal % 4 > 0 as is_fallback_city, case when lower(company) <> 'building' then 'building' end as original_niche from leads")
def tier_tagged_results(spark, d):
    rows = leads(spark, d).select("lead_id", (F.col("ordinal") % 4).alias("tier"), F.when(F.col("ordinal") % 3 == 0, "").otherwise(F.col("company")).alias("city"), F.col("company").alias("niche"))
    return records.tier_tags(rows, "tier", "city", "niche", "KARACHI", "building").select("lead_id", "result_city", "is_fallback_city", "original_niche")


@query(f"""with {LEADS_SQL}, l as (select lead_id, ordinal, case when lead_id % 8 = 0 then '' else name end as name, phone, email, website, address from leads), o as (select o_custkey as k, max(o_orderpriority) filter (where o_orderstatus = 'P') as p, max(o_orderkey) % 3 = 0 as blocked, max(o_orderpriority) filter (where o_orderstatus = 'O') as b, max(o_orderpriority) as g from orders group by 1),
n as (select *, name <> '' and coalesce(phone, '') = '' and coalesce(website, '') = '' as needy from l), r as (select *, row_number() over (partition by needy order by ordinal) as place from n),
x as (select r.*, case when needy and place <= 10 then g end as looked, case when name <> '' and website <> '' then case when blocked then b else p end end as site from r left join o on o.k = lead_id)
select lead_id, coalesce(nullif(address, ''), looked, site) as address, phone, case when looked is not null then 'google_maps' when site is not null then 'website' end as via, case when name = '' then 'failed' else 'done' end as enrichment_status, case when name = '' then 'missing name' end as enrichment_error from x""")
def enrichment_batch(spark, d):
    every = leads(spark, d).select("lead_id", "ordinal", F.when(F.col("lead_id") % 8 == 0, "").otherwise(F.col("name")).alias("name"), "phone", "email", "website", "address")
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("lead_id"))
    only = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))).alias("address")
    plain, browser = o.agg(only("P"), (F.max("o_orderkey") % 3 == 0).alias("blocked")), o.agg(only("O"))
    got = records.enrichment_batch(every, plain, browser, o.agg(F.max("o_orderpriority").alias("address")))
    return got.select("lead_id", "address", "phone", "via", "enrichment_status", "enrichment_error")


@query("select event_id, strftime(ts + interval 5 hours, '%Y-%m-%d %H:%M') as shown, abs(epoch_us(ts) - epoch_us(time_bucket(interval 4 hours, ts) + interval 30 minutes)) < 1800000000 or abs(epoch_us(ts) - epoch_us(time_bucket(interval 4 hours, ts) + interval 150 minutes)) < 1800000000 as near_slot from events")
def display_times(spark, d):
    utc = F.col("ts").cast("timestamp")
    four = F.timestamp_micros(F.unix_micros(utc) - F.pmod(F.unix_micros(utc), F.lit(14_400_000_000)))
    slots = F.array(four + F.expr("interval 30 minutes"), four + F.expr("interval 150 minutes"))
    return t(spark, d, "events").select("event_id", clock.shown(utc).alias("shown"), records.offered(utc, slots).alias("near_slot"))


@query("""with s as (select s_suppkey, ' ' || replace(s_name, '#', ' ') as name, n_name, case when s_suppkey % 3 = 0 then 'Dear client' else 'Dear Supplier, dear Supplier!' end as body from supplier join nation on n_nationkey = s_nationkey)
select s_suppkey, case when contains(body, 'Supplier') then replace(body, 'Supplier', '{{1}}') else body || ' {{1}}' end as template, '<div style="font-family:sans-serif"><p>Hi' || name || ',</p><p>Thanks for your interest — I''m reaching out from <strong>' || n_name || '</strong>.</p><p>Would you have a few minutes this week to connect?</p><p>Best regards,<br/>' || n_name || '</p></div>' as letter,
'<div style="font-family:sans-serif"><p>' || body || '</p><p> two</p></div>' as step from s""")
def filled_templates(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    body, name = F.when(F.col("s_suppkey") % 3 == 0, "Dear client").otherwise("Dear Supplier, dear Supplier!"), F.concat(F.lit(" "), F.replace("s_name", F.lit("#"), F.lit(" ")))
    return s.select("s_suppkey", text.with_parameter(body, name).alias("template"), text.outreach_letter(F.trim(name), F.col("n_name")).alias("letter"), text.paragraphs(F.concat(body, F.lit("\n  \n two\r\n"))).alias("step"))


@query("select p_partkey, least(greatest(p_size, 1) * 3, 150) as fetch_limit from part")
def fetch_limits(spark, d):
    return t(spark, d, "part").select("p_partkey", records.fetch_limit(F.col("p_size")).alias("fetch_limit"))


@query("select l_orderkey as job, string_agg(case when l_linenumber = 2 then 'done' else l_returnflag end, ',' order by l_linenumber, l_partkey, l_returnflag) as items from lineitem group by 1")
def patched_job_items(spark, d):
    got = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))).alias("i"))
    patched = F.transform("i", lambda x: F.when(x["l_linenumber"] == 2, F.lit("done")).otherwise(x["l_returnflag"]))
    return got.select("job", F.array_join(patched, ",").alias("items"))


@query("select event_id, case when event_id % 2 = 0 then 'k=' || (props::json->>'k') || ',seen=' || event_type else 'seen=' || event_type end as props from events")
def map_keys_set_and_dropped(spark, d):
    m = text.map_set(F.from_json("props", "map<string,string>"), "seen", F.col("event_type"))
    m = F.when(F.col("event_id") % 2 == 0, m).otherwise(text.map_drop(m, "k"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return t(spark, d, "events").select("event_id", said.alias("props"))


@query("""with w as (select s_suppkey, s_suppkey % 4 in (1, 3) as vague, regexp_extract_all(lower(n_name), '[a-z]{3,}') as words, 'www.' || lower(replace(n_name, ' ', '')) || '.example.org' as host from supplier join nation on n_nationkey = s_nationkey)
select s_suppkey, vague or len(words) = 0 or len(list_filter(words, lambda x: contains(host, x))) > 0 as own, vague or len(words) = 0 or len(list_filter(words, lambda x: contains('other.example.org', x))) > 0 as other from w""")
def own_site_check(spark, d):
    s = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Dental Care of "), "n_name")).when(k == 1, "The best clinic in Karachi").when(k == 2, F.concat(F.lit("Dr. "), "n_name", F.lit(" & co")))
    href, other = F.concat(F.lit("https://www."), F.lower(F.replace("n_name", F.lit(" "), F.lit(""))), F.lit(".example.org/supplier")), F.concat(F.lit("http://other.example.org/"), F.lower("n_name"))
    return s.select("s_suppkey", records.own_site(name, href).alias("own"), records.own_site(name, other).alias("other"))


@query("""select s_suppkey as admin, coalesce(bool_or(l_returnflag = 'R'), false) as may_revoke from supplier left join lineitem on l_suppkey = s_suppkey group by 1""")
def permission_membership(spark, d):
    grants = t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.collect_set("l_returnflag").alias("p"))
    s = t(spark, d, "supplier").select("s_suppkey").join(grants, "s_suppkey", "left")
    return s.select(F.col("s_suppkey").alias("admin"), records.member_of("R", F.col("p")).alias("may_revoke"))


_SEEN = "case page_id % 5 when 0 then concat(html, ' Please solve the CAPTCHA') when 1 then concat('Unusual Traffic ', html) else html end"


@query(f"with c as (select page_id, case when page_id % 7 = 0 then 403 when page_id % 11 = 0 then 429 when page_id % 13 = 0 then 500 else 200 end as status, {_SEEN} as body from pages) select page_id, status, status in (403, 429) or regexp_matches(lower(body), 'captcha|not a robot|unusual traffic|access denied|verify you are human') as blocked from c")
def challenge_pages(spark, d):
    n = F.col("page_id")
    status = F.when(n % 7 == 0, 403).when(n % 11 == 0, 429).when(n % 13 == 0, 500).otherwise(200)
    return t(spark, d, "pages").select("page_id", status.alias("status"), url.challenge_page(status, F.expr(_SEEN)).alias("blocked"))


@query("""select o_orderkey, 'Hello ' || o_custkey || ' café € & ’' || chr(10) || 'first' || chr(10) || 'second ' || o_orderpriority || chr(10) || 'Head' || chr(10) || 'code' as cleaned, '**Hello** ' || o_custkey || ' café € & ’' || chr(10) || '- first' || chr(10) || '2. second ' || o_orderpriority || chr(10) || '# Head' || chr(10) || '`code`' as reply from orders""")
def cleaned_messages(spark, d):
    """Messages without quotes, tags, entities and light markup, and replies without quotes, tags and entities."""
    said = F.concat(F.lit("<p>**Hello** "), "o_custkey", F.lit(" caf&eacute; &#8364; &amp; &#x2019;</p>- first<br/>2. second "), "o_orderpriority", F.lit("<BR># Head<br>`code`\nOn Mon, 1 Jan, A <a@b.co> wrote:\n> old"))
    return t(spark, d, "orders").select("o_orderkey", text.clean_message(said).alias("cleaned"), text.strip_quotes(said).alias("reply"))


@query()
def site_contacts(spark, d):
    """One contact record of each site in pages; maps and lists as text. Golden cases test it (structured data, ranking)."""
    from larkspur.operators.contacts import site_contacts as of

    got = of(t(spark, d, "pages"), url.website_key(F.col("url")), "page_id", "html")
    said = F.array_join(F.transform(F.array_sort(F.map_entries("social_links")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return got.withColumns({"social_links": said, "email_candidates": F.array_join("email_candidates", ","), "phone_candidates": F.array_join("phone_candidates", "|")})
