"""Embedding whitening: principal components of whole-number vectors, and every row's projection on them.

An entry c becomes x = floor(256 * c), so sums are exact. The components come from the covariance of the distinct x: the
Gramian of the exactly centred rows by MLlib's RowMatrix, divided by n, and its eigenvectors on the driver, which
holds numbers for each pair of dimensions and nothing for each row. The components are broadcast and rows whitened in
Arrow batches. Repeated vectors are made distinct before they meet, so none fills a task.

Defined cases: a row whose vector is null, holds null, NaN or an infinity, or an entry whose x is beyond
2**31, is dropped; so is one that doesn't have the length most rows have (ties: the shorter); repeated rows each give their rows;
a null vec_id passes; a component without variance isn't given, so equal vectors, one vector or empty ones give no rows, as
an empty table does; a deviation beyond a long is null; other columns don't matter. More than MOST_DIMENSIONS are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Steps of one unit, components given, and the largest x.
STEPS, COMPONENTS, LARGEST = 256, 4, 1 << 31
#: Dimensions for which the driver holds the square of covariances: 128 MB.
MOST_DIMENSIONS = 4096


@dataclass(frozen=True)
class Whitener:
    """What whitening needs, of a size that depends on the dimensions alone.

    The mean is ``floor + rest / n`` in each dimension, ``rest`` whole and below ``n``.
    """

    n: int
    floor: np.ndarray
    rest: np.ndarray
    components: np.ndarray  # a column each
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A row of whitened entries for each row of ``x``."""
        return self.centred(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 of each row, exact; None beyond a long."""
        near = np.abs(self.centred(x)).max(axis=1, initial=0.0) * self.n
        small = near * near * x.shape[1] < 2.0**62
        whole = np.zeros(len(x), np.int64)
        part = (x[small] - self.floor) * self.n - self.rest
        whole[small] = (part * part).sum(axis=1)
        out: list[int | None] = whole.tolist()
        for i in np.flatnonzero(~small):
            exact = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(x[i] - self.floor, self.rest, strict=True))
            out[i] = exact if exact < 1 << 63 else None
        return out


def whole_numbers(vector: Column) -> Column:
    """The vector's x, an array of longs; null where the row takes no part."""
    scaled = F.transform(vector, lambda c: c.cast("double") * STEPS)
    # NaN is above every number for Spark, so it fails the bound too.
    fine = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & F.coalesce(F.abs(c.cast("double")) * STEPS < LARGEST, F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("long")))


def prepared(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key`` and x of the rows that take part, written."""
    numbers = common.written(rows.select(F.col(key), whole_numbers(F.col(vector)).alias("x")).where(F.col("x").isNotNull()))
    most = numbers.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = most["size"] if most else 0
    if size > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {size} dimensions; {MOST_DIMENSIONS} are the most")
    return numbers.where(F.size("x") == size)


def fitted(x: DataFrame, components: int = COMPONENTS) -> tuple[Whitener | None, DataFrame]:
    """The whitener of the distinct vectors of ``x`` (None if nothing varies), and these, written."""
    fit = common.written(x.select("x").distinct())
    each = fit.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    sums = [int(r["s"]) for r in each.orderBy("at").collect()]  # one for each dimension
    n = fit.count()
    if not sums:
        return None, fit
    floor, rest = [s // n for s in sums], [s % n for s in sums]
    mean = F.array(*[F.struct(F.lit(f).cast("long").alias("f"), F.lit(r / n).alias("r")) for f, r in zip(floor, rest, strict=True)])
    off = F.zip_with("x", mean, lambda v, m: (v - m["f"]).cast("double") - m["r"])
    vectors = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(off).alias("v")), "v")
    gram = RowMatrix(vectors, n, len(sums)).computeGramianMatrix().toArray()
    covariance = gram / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    sound = values > len(sums) * np.finfo(float).eps * max(trace, 0.0)
    if not sound.any():
        return None, fit
    values, axes = values[sound], axes[:, sound]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])  # the largest entry is positive
    return Whitener(n, np.array(floor, np.int64), np.array(rest, np.int64), np.ascontiguousarray(axes), values, trace), fit


def apply(x: DataFrame, whitener: Whitener, key: str) -> DataFrame:
    """``key``, deviation and the array ``whitened`` of every row of ``x``."""
    shared = x.sparkSession.sparkContext.broadcast(whitener)
    schema = T.StructType([x.schema[key], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            if len(batch):
                v = np.stack(batch["x"].to_numpy())
                yield pd.DataFrame({key: batch[key], "deviation": pd.array(own.deviation(v), "Int64"), "whitened": list(own.whiten(v))})

    return x.select(key, "x").mapInPandas(run, schema)


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """The largest entry by which the whitened fit list's covariance differs from the identity."""
    k = len(whitener.values)
    flat = apply(fit.withColumn("_key", F.lit(0)), whitener, "_key").select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = flat.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened_rows(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``key``, component, n, deviation, whitened, explained and identity_error: a row for each vector that takes part and each component."""
    x = prepared(rows, key, vector)
    whitener, fit = fitted(x, components)
    outputs = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if whitener is None:
        schema = T.StructType([x.schema[key], *T._parse_datatype_string(outputs).fields])
        return x.sparkSession.createDataFrame([], schema)
    error, shares = identity_error(fit, whitener), [float(v / whitener.trace) for v in whitener.values]
    out = apply(x, whitener, key).select(key, "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(
        key,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(whitener.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, shares))[F.col("_at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
