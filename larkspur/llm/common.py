"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.session import durable, remove_folder, shared_folder

__all__ = ["durable", "held_out", "labelled", "mapped", "shared_folder", "staged", "star_join", "table"]

#: Bytes of values that a worker turns into Python objects at once.
PART = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def staged(spark: SparkSession) -> Iterator[Callable[[str, DataFrame], DataFrame]]:
    """Gives stage(name, df): df written as Parquet to the shared folder and reread.

    A stage's files go once the next one's are written; the last one's stay for the reader.
    """
    top, last = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", []

    def stage(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        if last:
            remove_folder(spark, last.pop())
        last.append(f"{top}/{name}")
        return spark.read.parquet(last[0])

    yield stage


def _parts(b: pa.RecordBatch, places: list[int]) -> Iterator[pa.RecordBatch]:
    """b in pieces of PART bytes in the given columns; a longer row stands alone."""
    if b.num_rows < 2 or sum(b.column(p).nbytes for p in places) <= PART:
        yield b
        return
    half = b.num_rows // 2
    yield from _parts(b.slice(0, half), places)
    yield from _parts(b.slice(half), places)


def mapped(df: DataFrame, columns: list[str], fields: str, make: Callable[..., list], keep: bool = True) -> DataFrame:
    """df with the columns of ``fields`` (DDL): make() gets lists of the values of columns and gives lists of the new ones.

    All other columns pass as Arrow, so that a null beside a long doesn't turn it into a float. Rows are
    worked on in parts of bounded size, as a batch of long texts and what is made of them would fill a worker.
    Without keep the columns that make() reads don't come out, so that texts aren't sent back for nothing.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    added = T.StructType.fromDDL(fields)
    kinds, places = to_arrow_schema(added), [df.columns.index(c) for c in columns]
    stay = [i for i in range(len(df.columns)) if keep or i not in places]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _parts(batch, places):
                made = make(*(b.column(p).to_pylist() for p in places))
                new = [pa.array(m, k.type) for m, k in zip(made, kinds)]
                del made
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in stay), *new], names=[*(b.schema.names[i] for i in stay), *added.names])

    return df.mapInArrow(run, T.StructType([*(df.schema.fields[i] for i in stay), *added.fields]))


def star_join(rows: DataFrame, one: DataFrame, key: str, total: int, many: str) -> DataFrame:
    """rows inner-joined with ``one``, which has one row a key and in ``many`` the number of rows of that key.

    Keys with over a thousandth of the total rows (100 at least) are at most 1,000, whatever the
    data's size; they are broadcast, so that no task holds all rows of such a key. The others are shuffled.
    """
    hot = F.col(many) > max(100, total // 1000)
    values = [c for c in one.columns if c not in (key, many)]
    few = one.where(hot).select(key, F.struct(*values).alias("hot_"))
    rows = rows.join(F.broadcast(few), key, "left")
    warm = rows.where("hot_ is not null").select(*(c for c in rows.columns if c != "hot_"), *(F.col(f"hot_.{v}").alias(v) for v in values))
    return warm.unionByName(rows.where("hot_ is null").drop("hot_").join(one.where(~hot).drop(many), key))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels no classifier may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(k, t, y): texts and labels of at most per_class labelled rows of each class, and the classes' whole sizes.

    The sample is taken from the labels by a hash of their keys, so that only its bounded number of keys
    is broadcast to the documents and no text is shuffled before it is picked. Rows whose label is null or
    neither 0 nor 1, or whose key is null or held out, don't count; of several texts with one key the one
    with the least hash counts; a null text is empty.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = reduce(DataFrame.unionAll, [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(per_class) for y in (0, 1)])
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = texts.join(F.broadcast(picked.distinct()), "k")
    return found.groupBy("k", "y").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.length("t"))).alias("t")), sizes
