"""Exact interpolated quantiles per group for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. It
is used only for groups measured to be small. Beyond that, values are counted in buckets of a
fixed increasing function (in each task first, in Arrow batches where the groups are few), the buckets
that hold the wanted positions are found from the counts, and only the values in those buckets are put
in order, equal values as one. A bucket with more different values than a task should order is cut into
slices between its smallest and largest value, and so on until each fits: a bucket spans less than one
part in 88 of its values, so the bits of a double are used up after five cuts, however the values lie. NULL and non-finite values
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from curveloom.functions.scalars import finite, null_unless_finite
from curveloom.operators.skew import cut_lineage

LARGEST_BUFFERED_GROUP = 50_000
# Rows of different values that one task puts in order.
LARGEST_CELL = 2_000_000
# Tables with one row per group and quantile are broadcast up to this many rows.
MOST_BROADCAST_GROUPS = 20_000
BUCKETS_PER_E_FOLD = 128
BUCKET_OFFSET = 100_000
SLICES = 1024


@dataclass(frozen=True)
class GroupSizes:
    groups: int
    largest: int

    def buffered(self, limit: int = LARGEST_BUFFERED_GROUP) -> bool:
        return self.largest <= limit


def measure_groups(df: DataFrame, keys: Sequence[str]) -> GroupSizes:
    """Number of groups and rows of the largest one; only the key columns are read."""
    found = df.groupBy(*keys).count().agg(
        F.count(F.lit(1)).alias("groups"), F.max("count").alias("largest")
    ).first()
    return GroupSizes(found["groups"], found["largest"] or 0)


def buffered_quantile(value: Column, q: float) -> Column:
    return F.percentile(null_unless_finite(value), F.lit(float(q)))


def magnitude_bucket(v: Column) -> Column:
    """Integer that never decreases with ``v``: its sign and the rounded logarithm of its size."""
    size = (F.floor(F.ln(F.abs(v)) * F.lit(float(BUCKETS_PER_E_FOLD))) + BUCKET_OFFSET).cast("int")
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))


# Types of keys whose values are the same in Python, Arrow and Spark.
_PLAIN_KEYS = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType, T.DoubleType)
# Partial counts that a task holds before it combines them.
MOST_COUNTS = 500_000
_BUCKET_BITS, _NAME_BITS = 20, 12


def _bits_bucket(v: np.ndarray) -> np.ndarray:
    """Integer that never decreases with ``v``: sign, exponent and the first seven bits of the fraction."""
    size = (np.abs(v).view(np.int64) >> 45) + 1
    return np.where(v > 0, size, np.where(v < 0, -size, 0))


def _plain(value):
    """A key that equals itself, also where it is not a number."""
    return "not a number" if value != value else value


def _batch_groups(batch: pa.RecordBatch, keys: Sequence[str]) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's group in the batch, and the key values of the groups."""
    code = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        coded = batch[k].dictionary_encode(null_encoding="encode")
        code = code * len(coded.dictionary) + coded.indices.to_numpy()
    _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, list(zip(*[batch[k].take(pa.array(first)).to_pylist() for k in keys])) if keys else [()] * len(first)


def _finite_values(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    values = batch[f"_v{i}"].to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.isfinite(values))
    return rows, values[rows]


def _bucket_counts(flat: DataFrame, keys: Sequence[tuple[str, str]], n_values: int) -> DataFrame:
    """(keys, _name, _bucket, _n): values counted by each task."""
    names = [k for k, _ in keys]
    kinds = flat.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        parts, held = [], 0

        def leave() -> pa.RecordBatch:
            codes, counts = (np.concatenate(p) for p in zip(*parts))
            cells, at = np.unique(codes, return_inverse=True)
            total = np.bincount(at, counts, len(cells)).astype(np.int64)
            listed = list(known)
            groups = [listed[g] for g in cells >> (_BUCKET_BITS + _NAME_BITS)]
            low = cells & ((1 << _BUCKET_BITS + _NAME_BITS) - 1)
            return pa.RecordBatch.from_pydict({
                **{k: pa.array([g[i] for g in groups], to_arrow_type(kinds[k].dataType)) for i, k in enumerate(names)},
                "_name": pa.array(low >> _BUCKET_BITS, pa.int32()),
                "_bucket": pa.array((low & (1 << _BUCKET_BITS) - 1) - (1 << _BUCKET_BITS - 1), pa.int32()),
                "_n": pa.array(total)})

        for batch in batches:
            group, found = _batch_groups(batch, names)
            own = np.array([known.setdefault(g, len(known)) for g in found], np.int64)
            for i in range(n_values):
                rows, values = _finite_values(batch, i)
                if not len(rows):
                    continue
                bucket = _bits_bucket(values)
                low = bucket.min()
                width = int(bucket.max() - low) + 1
                counts = None
                if width * len(found) <= 64 * len(rows) + 65_536:
                    counts = np.bincount(group[rows] * width + (bucket - low))
                    at = np.flatnonzero(counts)
                    counts, group_at, bucket_at = counts[at], at // width, at % width + low
                else:
                    cells, counts = np.unique(group[rows] << _BUCKET_BITS | (bucket - low), return_counts=True)
                    group_at, bucket_at = cells >> _BUCKET_BITS, (cells & (1 << _BUCKET_BITS) - 1) + low
                parts.append((((own[group_at] << _NAME_BITS | i) << _BUCKET_BITS) + bucket_at + (1 << _BUCKET_BITS - 1), counts))
                held += len(counts)
            if held > MOST_COUNTS:
                yield leave()
                parts, held = [], 0
                known.clear()
        if parts:
            yield leave()

    schema = "".join(f"{k} {t}, " for k, t in keys) + "_name int, _bucket int, _n long"
    return flat.mapInArrow(run, schema)


def _values_in(flat: DataFrame, keys: Sequence[tuple[str, str]], n_values: int, cells: Sequence[Row]) -> DataFrame:
    """(keys, _name, _bucket, _v): the values of the wanted buckets. A group's wanted buckets follow one another."""
    names = [k for k, _ in keys]
    ends: dict[tuple, dict[int, tuple[int, int]]] = {}
    for *key, name, bucket in map(tuple, cells):
        of = ends.setdefault(tuple(map(_plain, key)), {})
        low, high = of.get(name, (bucket, bucket))
        of[name] = min(low, bucket), max(high, bucket)
    shared = flat.sparkSession.sparkContext.broadcast(ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, found = _batch_groups(batch, names)
            of = [shared.value.get(tuple(map(_plain, g)), {}) for g in found]
            for i in range(n_values):
                rows, values = _finite_values(batch, i)
                bucket = _bits_bucket(values)
                low, high = (np.array([o.get(i, (1, 0))[side] for o in of], np.int64)[group[rows]] for side in (0, 1))
                kept = np.flatnonzero((low <= bucket) & (bucket <= high))
                if len(kept):
                    yield pa.RecordBatch.from_arrays([
                        *[batch[k].take(pa.array(rows[kept])) for k in names], pa.array(np.full(len(kept), i, np.int32)),
                        pa.array(bucket[kept].astype(np.int32)), pa.array(values[kept])], names=[*names, "_name", "_bucket", "_v"])

    schema = "".join(f"{k} {t}, " for k, t in keys) + "_name int, _bucket int, _v double"
    return flat.mapInArrow(run, schema)


def _holding(counts: DataFrame, by: list[str], path: list[str], ranked: bool) -> DataFrame:
    """Cells of ``counts`` (by, path, _n) that hold a wanted position.

    Cells are in the order of ``path``; ``_base`` positions lie before the first cell of a group.
    """
    order = Window.partitionBy(*by).orderBy(*path)
    earlier = F.coalesce(
        F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    if not ranked:
        counts = counts.withColumn(
            "_rank", (F.sum("_n").over(Window.partitionBy(*by)) - 1) * F.col("_q")
        ).withColumn("_base", F.lit(0).cast("long"))
    return (
        counts.withColumn("_before", F.col("_base") + earlier)
        .where(
            (F.col("_before") <= F.ceil("_rank")) & (F.col("_before") + F.col("_n") > F.floor("_rank"))
        )
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: dict[str, tuple[str, float]],
    sizes: GroupSizes | None = None,
    every_group: bool = True,
    largest_cell: int = LARGEST_CELL,
) -> DataFrame:
    """One row per group: for each ``name: (value column, q)`` the interpolated quantile.

    A group without values gets NULL, or no row unless ``every_group`` is set (which reads the
    keys once more). Pass ``sizes`` to reuse an earlier measurement.
    """
    keys = list(keys)
    sizes = measure_groups(df, keys) if sizes is None else sizes
    by = [*keys, "_name"]
    few = sizes.groups * len(wanted) * 2 <= MOST_BROADCAST_GROUPS

    def small(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if few else table

    q = F.get(F.array(*[F.lit(float(q)) for _, q in wanted.values()]), F.col("_name"))
    columns = [F.col(c).cast("double") for c, _ in wanted.values()]
    in_arrow = few and all(isinstance(df.schema[k].dataType, _PLAIN_KEYS) for k in keys)
    if in_arrow:
        flat = df.select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(f"_v{i}") for i, c in enumerate(columns)])
        types = [(f"_k{i}", df.schema[k].dataType.simpleString()) for i, k in enumerate(keys)]
        renamed = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
        counts = _bucket_counts(flat, types, len(columns)).select(*renamed, "_name", "_bucket", "_n")
    else:
        long = df.select(*keys, F.posexplode(F.array(*columns)).alias("_name", "_v")).where(finite(F.col("_v"))).withColumn(
            "_bucket", magnitude_bucket(F.col("_v")))
        counts = long.select(*by, "_bucket", F.lit(1).alias("_n"))
    counts = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_n"))
    path = ["_bucket"]
    cells = cut_lineage(_holding(counts.withColumn("_q", q), by, path, ranked=False))
    long = _values_in(flat, types, len(columns), cells.select(*by, "_bucket").collect()).select(
        *renamed, "_name", "_bucket", "_v") if in_arrow else long
    # Equal values are one row from here on; the rows are few unless the values of a cell differ.
    values = cut_lineage(
        long.groupBy(*by, *path, "_v").agg(F.count(F.lit(1)).alias("_n"))
        .join(small(cells.select(*by, *path, "_rank", "_before")), [*by, *path]))
    while True:
        cell = [*by, *path, "_rank"]
        ends = values.groupBy(*cell).agg(
            F.count(F.lit(1)).alias("_different"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        if (ends.agg(F.max("_different")).first()[0] or 0) <= largest_cell:
            break
        place = F.try_divide(F.col("_v") - F.col("_min"), F.col("_max") - F.col("_min")) * SLICES
        level = f"_slice_{len(path)}"
        rows = values.join(small(ends.drop("_different")), cell).withColumn(
            level, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(SLICES - 1.0), place)).cast("int"), F.lit(0))
        ).drop("_min", "_max")
        counts = rows.groupBy(*cell, "_before", level).agg(F.sum("_n").alias("_n")).withColumnRenamed("_before", "_base")
        cells = cut_lineage(_holding(counts, cell, [level], ranked=True))
        path = [*path, level]
        values = cut_lineage(rows.drop("_before", "_rank").join(
            small(cells.select(*by, *path, "_rank", "_before")), [*by, *path]))

    running = Window.partitionBy(*by, *path).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = values.withColumn("_upto", F.col("_before") + F.sum("_n").over(running))

    def value_at(position: Column) -> Column:
        start = F.col("_upto") - F.col("_n")
        return F.max(F.when((start <= position) & (position < F.col("_upto")), F.col("_v")))

    answers = placed.groupBy(*by, "_rank").agg(
        value_at(F.floor("_rank")).alias("_a"), value_at(F.ceil("_rank")).alias("_b")
    ).withColumn(
        "_answer",
        F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_rank") - F.floor("_rank")),
    )
    per_group = answers.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == i, F.col("_answer"))).alias(name)
        for i, name in enumerate(wanted)
    ])
    if not keys or not every_group:
        return per_group
    return df.select(*keys).distinct().join(per_group, keys, "left")
