"""Vectors as exact whole numbers: floor(scale * component), packed into bytes.

A vector is packed in the narrowest of 2, 4 and 8 bytes that holds all its numbers, so
that equal vectors have equal bytes and group, join and shuffle as one short value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS = (np.int16, np.int32, np.int64)
#: Numbers of this size and more don't count as finite: a long could not hold them or what is made of them.
HUGE = 2.0**62


def common_length(df: DataFrame, vector: str) -> int:
    """The length of most non-null vectors, of equally common ones the smaller; 0 without any."""
    got = df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return got.n if got else 0


def whole(column: pa.Array, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows take part, their floor(scale * component) as long): rows of d components, none null, not finite or huge."""
    ok = pc.equal(pc.fill_null(pc.list_value_length(column), -1), d).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        c = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # nulls are NaN
        x = np.floor(c * scale)
    good = (np.abs(x) < HUGE).all(axis=1)
    ok[ok] = good
    return ok, x[good].astype(np.int64)


def pack(x: np.ndarray) -> list[bytes]:
    most, d = np.maximum(x.max(axis=1, initial=0), ~x.min(axis=1, initial=0)), x.shape[1]
    out: list[bytes] = [b""] * len(x)
    for kind, below in zip(WIDTHS, (0, *(np.iinfo(k).max + 1 for k in WIDTHS[:2]))):
        at = np.flatnonzero((most >= below) & (most <= np.iinfo(kind).max))
        raw, step = x[at].astype(kind).tobytes(), d * np.dtype(kind).itemsize
        for j, i in enumerate(at):
            out[i] = raw[j * step : (j + 1) * step]
    return out


def unpack(column: pa.Array, d: int) -> np.ndarray:
    size, out = pc.binary_length(column).to_numpy(zero_copy_only=False), np.empty((len(column), d), np.int64)
    for kind in WIDTHS:
        here = size == d * np.dtype(kind).itemsize
        if here.any():
            out[here] = np.frombuffer(b"".join(column.filter(pa.array(here)).to_pylist()), kind).reshape(-1, d)
    return out


def packed(df: DataFrame, vector: str, d: int, scale: int, keep: list[str]) -> DataFrame:
    """keep and ``x``, the packed whole numbers, of the rows that take part."""
    df = df.select(*keep, F.col(vector).alias("x"))
    if not isinstance(df.schema["x"].dataType.elementType, (T.FloatType, T.DoubleType)):
        df = df.withColumn("x", F.col("x").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                ok, x = whole(part.column(len(keep)), d, scale)
                rest = part.filter(pa.array(ok))
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.array(pack(x), pa.binary())], names=[*keep, "x"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("x", T.BinaryType())]))
