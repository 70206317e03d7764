"""Queries whose rules go step by step along an order: cooldowns, imports, breakers, conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import analytics, imports, ordered
from larkspur.plans.base import query, t
from larkspur.plans.views import LEADS_SQL, leads
from larkspur.streaming import health


def _spaced_sql(by: str, seconds: int) -> str:
    """The chain followed event by event: the first moment of a group, then always the first one late enough after it."""
    return f"""with recursive d as (select {by} as g, ts, min(event_id) as event_id from events group by 1, 2),
    n as (select a.g, a.ts, min(b.ts) as next from d a join d b on a.g = b.g and b.ts >= a.ts + interval {seconds} seconds group by 1, 2),
    c as (select g, min(ts) as ts from d group by 1 union all select c.g, n.next from c join n on n.g = c.g and n.ts = c.ts)
    select d.event_id, d.g as account from c join d on d.g = c.g and d.ts = c.ts"""


@query(_spaced_sql("user_id", 25))
def cooled_replies(spark, d):
    return ordered.spaced(t(spark, d, "events"), "user_id", "ts", "event_id", 25_000_000).select("event_id", F.col("user_id").alias("account"))


@query(_spaced_sql("event_type", 3600))
def cooled_scans(spark, d):
    """A few accounts with very many events, and a long cooldown: chains of hundreds of scans."""
    return ordered.spaced(t(spark, d, "events"), "event_type", "ts", "event_id", 3_600_000_000).select("event_id", F.col("event_type").alias("account"))


_MADE = {"email": "case when c_custkey % 5 = 0 then null else concat('U', cast(c_custkey * 7 % 37 as varchar(20)), '@X.org') end", "phone": "case when c_custkey % 7 = 0 then '' else concat('+1 55 ', cast(c_custkey * 11 % 53 as varchar(20))) end"}
_ROWS = f"select c_custkey as ordinal, c_nationkey as workspace_id, {_MADE['email']} as email, {_MADE['phone']} as phone from customer"


@query(f"""with recursive every as ({_ROWS}), k as (select ordinal, workspace_id, lower(email) as e, nullif(regexp_replace(phone, '\\s+', '', 'g'), '') as p from every),
i as (select *, row_number() over (partition by workspace_id order by ordinal) as rn from k where ordinal % 10 <> 0),
h as (select workspace_id, list(e) filter (where e is not null) as es, list(p) filter (where p is not null) as ps from k where ordinal % 10 = 0 group by 1),
s as (select n_nationkey as workspace_id, cast(0 as bigint) as rn, coalesce(es, []) as es, coalesce(ps, []) as ps, 0 as n, false as ended, cast(null as bigint) as ordinal, cast(null as varchar) as outcome, cast(null as varchar) as duplicate from nation left join h on h.workspace_id = n_nationkey
 union all
 select workspace_id, rn, case when outcome = 'imported' and e is not null then list_append(es, e) else es end, case when outcome = 'imported' and p is not null then list_append(ps, p) else ps end, n + cast(outcome = 'imported' as int), ended or outcome = 'quota_exceeded', ordinal, outcome, case when outcome = 'duplicate' then dup end
 from (select s.workspace_id, i.rn, i.ordinal, i.e, i.p, es, ps, n, ended, dup, case when ended then 'not_reached' when n >= s.workspace_id % 5 * 4 + 2 then 'daily_limit_reached' when n >= 10 then 'quota_exceeded' when dup is not null then 'duplicate' else 'imported' end as outcome
  from s join (select *, cast(null as varchar) as x from i) i on i.workspace_id = s.workspace_id and i.rn = s.rn + 1, lateral (select case when list_contains(es, i.e) then 'email' when list_contains(ps, i.p) then 'phone' end as dup) z) y)
select workspace_id, ordinal, outcome, duplicate from s where ordinal is not null""")
def import_in_order(spark, d):
    """A workspace's day has room for 2 to 18 leads, its quota for 10."""
    every = t(spark, d, "customer").selectExpr("c_custkey as ordinal", "c_nationkey as workspace_id", *(f"{e.replace('varchar(20)', 'string')} as {n}" for n, e in _MADE.items()))
    rooms = t(spark, d, "nation").selectExpr("n_nationkey as workspace_id", "n_nationkey % 5 * 4 + 2 as day_room", "10 as quota_room")
    return imports.import_rows(every.where("ordinal % 10 <> 0"), every.where("ordinal % 10 = 0"), rooms).select("workspace_id", "ordinal", "outcome", "duplicate")


@query(f"""with every as ({_ROWS}), k as (select ordinal as lead_id, workspace_id, lower(email) as e, nullif(regexp_replace(phone, '\\s+', '', 'g'), '') as p from every),
u as (select lead_id, workspace_id, 'u' || lead_id * 3 % 37 || '@x.org' as e, '+155' || lead_id * 5 % 53 as p from k)
select lead_id, case when exists (select 1 from k where k.workspace_id = u.workspace_id and k.e = u.e and k.lead_id <> u.lead_id) then 'email' when exists (select 1 from k where k.workspace_id = u.workspace_id and k.p = u.p and k.lead_id <> u.lead_id) then 'phone' end as duplicate from u""")
def lead_update_conflicts(spark, d):
    every = t(spark, d, "customer").selectExpr("c_custkey as lead_id", "c_nationkey as workspace_id", *(f"{e.replace('varchar(20)', 'string')} as {n}" for n, e in _MADE.items()))
    asked = every.selectExpr("lead_id", "workspace_id", "concat('U', lead_id * 3 % 37, '@x.org') as email", "concat('+1 55 ', lead_id * 5 % 53) as phone")
    return imports.update_conflicts(every, asked).select("lead_id", "duplicate")


_SOURCES = "case event_type when 'view' then 'google_maps' when 'click' then 'directory' when 'signup' then 'bizdata' else event_type end"
_KNOWN = "(values " + ", ".join(f"('{s}', {f}, {c})" for s, (f, c) in health.SETTINGS.items()) + ") as known(source, threshold, cooldown_s)"


def _health_sql(source: str, ok: str) -> str:
    """Failures in a row at each outcome, by the successes before it; a breaker is open until its cooldown after the last trip."""
    return f"""with o as (select {source} as source, ts, event_id, {ok} as ok from events), g as (select *, sum(cast(ok as int)) over (partition by source order by ts, event_id) as wins from o),
    r as (select g.*, coalesce(threshold, {health.FAILURES}) as threshold, coalesce(cooldown_s, {health.COOLDOWN}) as cooldown_s, sum(cast(not ok as int)) over (partition by g.source, wins order by ts, event_id) as run, row_number() over (partition by g.source order by ts desc, event_id desc) as back from g left join {_KNOWN} on known.source = g.source),
    s as (select source, cast(count(*) filter (where back <= 100) as int) as samples, round_even(avg(cast(ok as int)) filter (where back <= 100), 3) as rate, avg(cast(ok as int)) filter (where back <= 100) < 0.3 and count(*) >= 5 as unhealthy, cast(coalesce(max(case when back = 1 and not ok then run end), 0) as int) as failures,
    coalesce(epoch_us(max(ts) filter (where not ok and run >= threshold)) / 1e6 + max(cooldown_s), 0.0) as open_until_s, epoch_us(max(ts)) / 1e6 as last_s from r group by 1)
    select source, samples, rate, unhealthy, failures, open_until_s, last_s < open_until_s as open from s"""


def _health(spark, d, source: str, ok: str):
    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    rows = health.source_health(e.select(F.expr(source).alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_id", F.expr(ok).alias("ok")))
    return analytics.latest(rows, ["source"], [F.desc("batch"), "batch_"]).select("source", "samples", "rate", "unhealthy", "failures", "open_until_s", "open")


@query(_health_sql(_SOURCES, "event_id % 3 <> 0"))
def stream_breakers(spark, d):
    """Health and breaker of each source after all events, with each source's own settings."""
    return _health(spark, d, _SOURCES, "event_id % 3 <> 0")


@query(_health_sql("event_type", "event_type <> 'error'"))
def stream_source_health(spark, d):
    return _health(spark, d, "event_type", "event_type <> 'error'")


@query(_health_sql("event_type", "event_id % 3 <> 0 and event_type <> 'error'"))
def stream_source_health_last100(spark, d):
    return _health(spark, d, "event_type", "event_id % 3 <> 0 and event_type <> 'error'")


@query("""with p as (select user_id as job, event_id % 4 as item, case when event_type = 'error' then 'failed' when event_type in ('purchase', 'click', 'view') then 'done' else 'running' end as status, row_number() over (partition by user_id, event_id % 4 order by ts desc, event_id desc) as rn from events)
select job, count(*) as items, count(*) filter (where status in ('done', 'failed')) as done, case when bool_and(status in ('done', 'failed')) then 'done' else 'in_progress' end as status from p where rn = 1 group by 1""")
def stream_job_progress(spark, d):
    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    said = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type").isin("purchase", "click", "view"), "done").otherwise("running")
    p = e.select(F.col("user_id").alias("job"), (F.col("event_id") % 4).alias("item"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("seq"), said.alias("status"))
    return analytics.latest(health.job_progress(p), ["job"], [F.desc("batch_")]).select("job", "items", "done", "status")
