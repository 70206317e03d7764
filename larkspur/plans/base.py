"""What the query modules share: the register of queries with their SQL, tables, streams over the event files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The result of a stream over all event files there are, written as Parquet to the shared folder, a folder per batch."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = t(spark, d, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    out = build(source)

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch_", F.lit(n)).write.mode("overwrite").parquet(f"{top}/out/batch={n}")

    q = out.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(T.StructType([*out.schema.fields, T.StructField("batch_", T.IntegerType())])).parquet(f"{top}/out/*")
