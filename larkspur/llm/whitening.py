"""Whitening of embeddings by two exact-centred passes over their distinct vectors.

The first pass sums the whole-number vectors exactly, which gives the mean. The second
sums outer products of the centred vectors by matrix products in tasks. Partial sums
meet in treeAggregate. The driver gets one d x d matrix, whose eigenvectors (LAPACK's
symmetric solver) are broadcast and project every row. A third pass measures how far
the whitened vectors' covariance is from the identity.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import durable
from larkspur.llm.vectors import common_length, packed, unpack, whole

#: Whole numbers are floor(SCALE * component). A constant added to all of them, such as a million, changes neither n * x - S nor x - S / n.
SCALE = 64
COMPONENTS = 16
#: Rows of one matrix product.
BLOCK = 4096


@dataclass
class Whitening:
    d: int
    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: as long where it fits, as Python numbers where it doesn't."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if most * self.n + max(map(abs, self.sums), default=0) < 2**63:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, centred while exact and only then made double."""
        return (self.offsets(x) / self.n).astype(np.float64)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int]:
        a = self.offsets(x)
        if a.dtype != object and a.shape[1] * float(np.abs(a).max(initial=0)) ** 2 < 2.0**62:
            return (a * a).sum(axis=1).tolist()
        return (a.astype(object) ** 2).sum(axis=1).tolist()


def _tree_sum(rows: DataFrame, zero: np.ndarray, part: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of part() over all batches: each partition hands on one array of zero's shape, treeAggregate merges them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = zero
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                total = total + part(batch.slice(lo, BLOCK))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["v"])

    return rows.mapInArrow(run, "v binary").rdd.treeAggregate(zero, lambda total, row: total + pickle.loads(row.v), lambda a, b: a + b)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Mean, axes and variances of the distinct whole-number vectors of df.

    Rows take part whose vector has the table's most common length and only finite components. At most
    ``components`` axes come out, only such as the vectors vary along: an axis whose variance is nothing beside
    the largest one's (below d * 2^-52 of it) can't be whitened. The sign of an axis is the one that makes its
    largest entry positive. The driver holds a few d x d matrices, whatever the number of rows.
    """
    d = common_length(df, vector)
    none = Whitening(d, 0, [0] * d, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    if not d:
        return none
    distinct = durable(packed(df, vector, d, SCALE, []).distinct())
    first = np.zeros(d + 1, object)

    def counted(b: pa.RecordBatch) -> np.ndarray:
        x = unpack(b.column(0), d)
        small = max(int(x.max(initial=0)), -int(x.min(initial=0))) * BLOCK < 2**63
        return np.array([len(x), *map(int, (x if small else x.astype(object)).sum(axis=0))], object)

    n, *sums = map(int, _tree_sum(distinct, first, counted))
    if not n:
        return none
    model = Whitening(d, n, sums, none.axes, none.values, none.explained)

    def outer(b: pa.RecordBatch) -> np.ndarray:
        c = model.centred(unpack(b.column(0), d))
        return c.T @ c

    covariance = _tree_sum(distinct, np.zeros((d, d)), outer) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    able = values > max(values[0], 0) * d * 2.0**-52
    axes = axes[:, able] * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])[able]
    model = Whitening(d, n, sums, axes, values[able], values[able] / np.trace(covariance))
    k = len(model.values)
    if k:
        # The centred vectors add up to exactly nothing, and so do their images: they are centred as they are.
        def squared(b: pa.RecordBatch) -> np.ndarray:
            w = model.apply(unpack(b.column(0), d))
            return w.T @ w

        model.identity_error = float(np.abs(_tree_sum(distinct, np.zeros((k, k)), squared) / n - np.eye(k)).max())
    return model


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """df's rows that take part (see fit()), with ``whitened``, an array of double, and ``deviation``, sum((n * x - S)^2), exact.

    Rows stay one for one, repeats and null ids included; null vectors, those of another length than the fitted
    ones and those with null or non-finite components go. Columns of df with one of the two names come out with
    ``_in`` appended.
    """
    clash = {c: f"{c}_in" for c in df.columns if c.lower() in ("whitened", "deviation")}
    df, vector = df.withColumnsRenamed(clash), clash.get(vector, vector)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(vector)
    kind = df.schema[vector].dataType.elementType
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        df = df.withColumn(vector, F.col(vector).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Whitening = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                ok, x = whole(part.column(at), m.d, SCALE) if m.d else (np.zeros(part.num_rows, bool), np.zeros((0, 0), np.int64))
                w = m.apply(x) if len(x) else np.zeros((0, len(m.values)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                sums = pa.array(map(Decimal, m.deviations(x) if len(x) else []), pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([*part.filter(pa.array(ok)).columns, lists, sums], names=[*part.schema.names, "whitened", "deviation"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *T.StructType.fromDDL("whitened array<double>, deviation decimal(38,0)").fields]))


def digest(embeddings: DataFrame) -> DataFrame:
    """vec_id, component (from 1), n, deviation (null where a long can't hold it), whitened, explained, identity_error."""
    model = fit(embeddings)
    rows = whiten(embeddings.select("vec_id", "embedding"), model).select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, map(float, model.explained))).cast("array<double>"), F.col("component"))
    rows = rows.withColumn("component", (F.col("at") + 1).cast("int")).withColumn("n", F.lit(model.n).cast("long"))
    return rows.select("vec_id", "component", "n", "deviation", "whitened", share.alias("explained"), F.lit(model.identity_error).alias("identity_error"))
