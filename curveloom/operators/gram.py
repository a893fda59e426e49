"""Means and centred products of many columns in one pass: one matrix product an Arrow batch, merged in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows and columns of a block of the matrix; blocks are merged apart from each other.
BLOCK = 512
# Columns up to which every pair is an aggregate of its own: no row leaves the JVM then.
FEW_COLUMNS = 5
# Partial blocks are merged in so many places before they meet in one.
FIRST_MERGES = 32

_SCHEMA = "i int, j int, place int, n long, mean_i binary, mean_j binary, products binary"


@dataclass
class Moments:
    """Row count, means and centred sums of products."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    def add(self, other: "Moments") -> "Moments":
        """The moments of both row sets, from differences of means: no large numbers cancel."""
        n = self.n + other.n
        if not self.n or not other.n:
            return other if not self.n else self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n),
                       self.products + other.products + np.outer(step, step) * (self.n * other.n / n))

    def covariance(self) -> np.ndarray:
        return self.products / (self.n - 1)


def _rows_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The complete rows of a list column with ``size`` finite numbers each."""
    lists = batch.column(0)
    sized = np.array(lists.value_lengths().fill_null(0)) == size
    values = lists.filter(pa.array(sized)).flatten().to_numpy(zero_copy_only=False).astype(float)
    values = values.reshape(-1, size)
    return values[np.isfinite(values).all(axis=1)]


def _merge(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple] = {}
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.frombuffer(row["mean_i"]), np.frombuffer(row["mean_j"])
                products = np.frombuffer(row["products"]).reshape(len(a), len(b))
                key = tuple(row[k] for k in keys)
                if key in found:
                    n0, a0, b0, p0 = found[key]
                    n = n0 + row["n"]
                    da, db = a - a0, b - b0
                    products = p0 + products + np.outer(da, db) * (n0 * row["n"] / n)
                    a, b = a0 + da * (row["n"] / n), b0 + db * (row["n"] / n)
                    found[key] = n, a, b, products
                else:
                    found[key] = row["n"], a, b, products
        out = [{"i": k[0], "j": k[1], "place": 0, "n": v[0], "mean_i": v[1].tobytes(), "mean_j": v[2].tobytes(),
                "products": v[3].tobytes()} for k, v in found.items()]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                ("i", pa.int32()), ("j", pa.int32()), ("place", pa.int32()), ("n", pa.int64()),
                ("mean_i", pa.binary()), ("mean_j", pa.binary()), ("products", pa.binary())]))

    return blocks.repartition(*keys).mapInArrow(run, _SCHEMA)


def moments(df: DataFrame, vector: Column, size: int, block: int = BLOCK) -> Moments:
    """Moments of an array column of ``size`` numbers; rows with a missing or non-finite number are left out.

    Each task adds up its batches and hands on blocks of the matrix; these are merged in some places first and then
    in one task a block. Only the final matrix, ``size`` squared numbers, reaches the driver.
    """
    starts = list(range(0, size, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Moments(0, np.zeros(size), np.zeros((size, size)))
        for batch in batches:
            rows = _rows_of(batch, size)
            if len(rows):
                mean = rows.mean(axis=0)
                rows = rows - mean
                found = found.add(Moments(len(rows), mean, rows.T @ rows))
        if not found.n:
            return
        place = TaskContext.get().partitionId() % FIRST_MERGES
        for i, a in enumerate(starts):
            for j, b in enumerate(starts[i:], i):
                yield pa.RecordBatch.from_pydict({
                    "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()),
                    "place": pa.array([place], pa.int32()), "n": pa.array([found.n], pa.int64()),
                    "mean_i": [found.mean[a:a + block].tobytes()], "mean_j": [found.mean[b:b + block].tobytes()],
                    "products": [found.products[a:a + block, b:b + block].tobytes()]})

    parts = df.select(vector.cast("array<double>").alias("v")).mapInArrow(run, _SCHEMA)
    whole = Moments(0, np.zeros(size), np.zeros((size, size)))
    for row in _merge(_merge(parts, ["i", "j", "place"]), ["i", "j"]).toLocalIterator():
        a, b = starts[row["i"]], starts[row["j"]]
        one, other = np.frombuffer(row["mean_i"]), np.frombuffer(row["mean_j"])
        products = np.frombuffer(row["products"]).reshape(len(one), len(other))
        whole.n = row["n"]
        whole.mean[a:a + block] = one
        whole.products[a:a + block, b:b + block] = products
        whole.products[b:b + block, a:a + block] = products.T
    return whole


def column_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Moments of columns over the rows where all are finite."""
    size = len(columns)
    values = [F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]
    if size > FEW_COLUMNS:
        return moments(df, F.array(*values), size)
    finite = [F.abs(f"v{i}") < F.lit(float("inf")) for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    row = df.select(*values).where(reduce(and_, finite, F.lit(True))).agg(
        F.count(F.lit(1)), *[F.avg(f"v{i}") for i in range(size)], *[F.covar_pop(f"v{i}", f"v{j}") for i, j in pairs]).first()
    found = Moments(row[0], np.zeros(size), np.zeros((size, size)))
    if found.n:
        found.mean[:] = row[1:1 + size]
        for (i, j), covariance in zip(pairs, row[1 + size:]):
            found.products[i, j] = found.products[j, i] = covariance * found.n
    return found
