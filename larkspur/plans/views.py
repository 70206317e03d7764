"""The driver's tables in the roles of a lead database: one expression per column, valid in Spark and in the oracle alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LEADS = {
    "lead_id": "c_custkey",
    "ordinal": "c_custkey",
    "workspace_id": "c_nationkey",
    "name": "c_name",
    "company": "c_mktsegment",
    "score": "case when c_custkey % 11 = 0 then null else cast(floor(abs(c_acctbal)) as int) % 101 end",
    "status": "case c_custkey % 7 when 0 then 'New' when 1 then 'Qualified' when 2 then 'Contacted' when 3 then 'Won' when 4 then 'Hot' when 5 then 'Unsubscribed' else 'New' end",
    "source": "case when c_mktsegment = 'BUILDING' then null when c_custkey % 4 = 0 then concat('Lead Discovery (', lower(c_mktsegment), ')') else c_mktsegment end",
    "email": "case when c_custkey % 5 = 0 then null else concat('User', cast(c_custkey % 997 as varchar(20)), '@mail', cast(c_custkey % 50 as varchar(20)), '.example.org') end",
    "phone": "case when c_custkey % 3 = 0 then null else concat('+1 555 ', cast(1000000 + c_custkey % 5003 as varchar(20))) end",
    "website": "case when c_custkey % 3 = 0 then '' else concat('https://www.shop', cast(c_custkey % 701 as varchar(20)), '.example.com/home?x=1') end",
    "address": "case when c_custkey % 6 = 0 then null else concat(cast(c_custkey % 90 as varchar(20)), ' Gulshan Street') end",
    "lat": "cast(c_custkey % 181 as double) - 90",
    "lon": "cast(c_custkey % 361 as double) - 180",
    "unsubscribed": "c_custkey % 13 = 0",
    "contacted": "c_custkey % 4 = 1",
    "website_present": "c_custkey % 3 <> 0",
}


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(*(f"{e.replace('varchar(20)', 'string')} as {n}" for n, e in LEADS.items()))


LEADS_SQL = "leads as (select " + ", ".join(f"{e} as {n}" for n, e in LEADS.items()) + " from customer)"
