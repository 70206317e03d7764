"""Deleting a tenant from tables that hang on each other."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """child.column names parent.key."""

    child: str
    column: str
    parent: str
    key: str


def purge_tenant(tables: dict[str, DataFrame], links: Iterable[Link], tenant: dict[str, Column]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(what stays, what goes) of each table: a tenant's own rows, and all rows that name a row that goes, however far down.

    tenant: for the tables that know their tenant, which rows are the one's to delete. Parents are decided before their children;
    each child meets the distinct keys of its parents' rows that go, by semi-joins, so that a row found by several ways goes once.
    Null references hang on nothing. Tables that hang on each other in a circle are refused (ValueError).
    """
    links = list(links)
    order = TopologicalSorter({name: [x.parent for x in links if x.child == name] for name in tables})
    try:
        names = [n for n in order.static_order() if n in tables]
    except CycleError as e:
        raise ValueError(f"tables hang on each other in a circle: {e.args[1]}") from e
    stays, goes = {}, {}
    for name in names:
        df = tables[name].withColumn("gone_", F.coalesce(tenant[name], F.lit(False)) if name in tenant else F.lit(False))
        for i, x in enumerate(x for x in links if x.child == name and x.parent in goes):
            keys = goes[x.parent].select(F.col(x.key).alias("k_")).where("k_ is not null").distinct().withColumn(f"by{i}_", F.lit(True))
            df = df.join(keys, F.col(x.column) == F.col("k_"), "left").drop("k_").withColumn("gone_", F.col("gone_") | F.coalesce(f"by{i}_", F.lit(False))).drop(f"by{i}_")
        stays[name], goes[name] = df.where("not gone_").drop("gone_"), df.where("gone_").drop("gone_")
    return stays, goes
