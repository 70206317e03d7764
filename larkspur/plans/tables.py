"""Queries over tables that are kept: snapshots, exports, purges, the live feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larkspur.operators import enrich
from larkspur.operators.purge import Link, purge_tenant
from larkspur.operators.snapshot import Snapshot
from larkspur.plans.base import query, t
from larkspur.session import shared_folder
from larkspur.sources import logs
from larkspur.streaming import feed


@query("""with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) select user_id, event_type, event_id, value from r
where rn = 1 and ts + case when event_type = 'error' then interval 1 hour else interval 24 hours end > (select max(ts) from events)""")
def snapshot_cache(spark, d):
    """A cache filled in three changes, read as of the newest event: rows expire after an hour or a day."""
    e = t(spark, d, "events").withColumn("expires_at", F.when(F.col("event_type") == "error", F.col("ts") + F.expr("interval 1 hour")).otherwise(F.col("ts") + F.expr("interval 24 hours")))
    cache = Snapshot(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", "user_id long, event_type string, event_id long, ts timestamp_ntz, value double, expires_at timestamp_ntz", ["user_id", "event_type"])
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    cuts = [F.lit(first + (last - first) / 3 * k) for k in (1, 2)]
    for part in (e.where(F.col("ts") < cuts[0]), e.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])), e.where(F.col("ts") >= cuts[1])):
        cache.change(part, [F.desc("ts"), F.desc("event_id")])
    return cache.read(F.lit(last)).select("user_id", "event_type", "event_id", "value")


@query("""select 'R-' || o_orderkey as reference, c_name as lead, 'user' || c_custkey || '@mail.org' as email, coalesce(nullif(replace(c_mktsegment, 'BUILDING', ''), ''), '') as company, strftime(o_orderdate, '%Y-%m-%d %H:%M') as date from orders join customer on c_custkey = o_custkey""")
def booked_meetings_file(spark, d):
    """Booking messages parsed, exported as CSV and read back."""
    b = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    company = F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit(" Company: "), "c_mktsegment", F.lit(".")))
    said = F.concat(F.lit("Meeting booked! Reference: R-"), "o_orderkey", F.lit(". Lead: "), "c_name", F.lit(". Email: user"), "c_custkey", F.lit("@mail.org."), F.coalesce(company, F.lit("")), F.lit(" Date: "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"), F.lit("."))
    path = f"{shared_folder(spark)}/bookings-{uuid.uuid4().hex}"
    logs.export_csv(enrich.booking(b.select(said.alias("content"))).select("reference", "lead", "email", "company", "date"), path)
    back = spark.read.csv(path, header=True, schema="reference string, lead string, email string, company string, date string")
    return back.select("reference", "lead", "email", F.coalesce("company", F.lit("")).alias("company"), "date")


_GONE = "with c as (select * from customer where c_nationkey = 7), o as (select * from orders where o_custkey in (select c_custkey from c)), s as (select * from supplier where s_nationkey = 7), l as (select * from lineitem where l_orderkey in (select o_orderkey from o) or l_suppkey in (select s_suppkey from s))"


@query(f"""{_GONE} select 'customer' as name, (select count(*) from customer) - count(*) as kept, count(*) as gone from c union all select 'orders', (select count(*) from orders) - count(*), count(*) from o
union all select 'supplier', (select count(*) from supplier) - count(*), count(*) from s union all select 'lineitem', (select count(*) from lineitem) - count(*), count(*) from l union all select 'part', count(*), 0 from part""")
def tenant_purge(spark, d):
    """What goes with one nation: its customers and suppliers, their orders, and lines that hang on either."""
    links = [Link("orders", "o_custkey", "customer", "c_custkey"), Link("lineitem", "l_orderkey", "orders", "o_orderkey"), Link("lineitem", "l_suppkey", "supplier", "s_suppkey"), Link("lineitem", "l_partkey", "part", "p_partkey")]
    tables = {n: t(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier", "part")}
    stays, goes = purge_tenant(tables, links, {"customer": F.col("c_nationkey") == 7, "supplier": F.col("s_nationkey") == 7})
    counts = [stays[n].select(F.lit(n).alias("name"), F.lit(1).alias("k"), F.lit(0).alias("g")).unionAll(goes[n].select(F.lit(n), F.lit(0), F.lit(1))) for n in tables]
    every = counts[0]
    for c in counts[1:]:
        every = every.unionAll(c)
    return every.groupBy("name").agg(F.sum("k").alias("kept"), F.sum("g").alias("gone"))


@query("""with a as (select user_id % 30 as workspace_id, epoch_us(ts) as at_us, event_type as stage, true as live, 'e' || event_id as detail from events where event_id % 3 <> 0 union all select user_id % 30, epoch_us(ts), event_type, false, 'e' || event_id from events where event_id % 4 <> 1),
o as (select *, row_number() over (partition by workspace_id, at_us, stage order by live desc, detail) as rn from a), n as (select *, row_number() over (partition by workspace_id order by at_us desc, stage) as place from o where rn = 1)
select workspace_id, at_us, stage, live, detail, cast(place as int) as place from n where place <= 40""")
def stream_live_feed(spark, d):
    e = spark.readStream.schema(t(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    a = e.select((F.col("user_id") % 30).alias("workspace_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_type").alias("stage"), F.explode(F.array(F.lit(True), F.lit(False))).alias("live"), F.concat(F.lit("e"), "event_id").alias("detail"), "event_id")
    a = a.where((F.col("live") & (F.col("event_id") % 3 != 0)) | (~F.col("live") & (F.col("event_id") % 4 != 1)))
    return feed.current(feed.live_feed(a.drop("event_id")))
