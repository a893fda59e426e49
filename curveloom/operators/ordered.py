"""Ordered-row operators that stay parallel inside one very long group.

``OrderedRows`` answers row number, previous row, next row and nearest earlier / later value per
group. Groups of ordinary size are plain window functions. A hot group (see ``skew``) is cut into
consecutive blocks at sampled split points; each block is its own window partition, and a summary
of one row per block carries the values over the block borders. The results are the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveloom.operators.skew import HotKeys, cut_lineage, find_hot_keys, separate

SAMPLES_PER_BLOCK = 40
SPLITS_PER_LIST = 128


@dataclass(frozen=True)
class Ordered:
    """One requested column: ``kind`` is number, previous, next, last_known or next_known."""

    kind: str
    column: str | None = None


def number() -> Ordered:
    """Row number within the group, from 1."""
    return Ordered("number")


def previous(column: str) -> Ordered:
    """Value on the row before; NULL on the first row."""
    return Ordered("previous", column)


def following(column: str) -> Ordered:
    """Value on the row after; NULL on the last row."""
    return Ordered("next", column)


def last_known(column: str) -> Ordered:
    """Latest non-NULL value up to and including the row."""
    return Ordered("last_known", column)


def next_known(column: str) -> Ordered:
    """Earliest non-NULL value from the row on."""
    return Ordered("next_known", column)


class OrderedRows:
    """Rows of ``df`` grouped by ``keys`` and ordered by ``order`` (together unique).

    Pass ``hot`` to reuse an earlier measurement of the same rows and keys.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        hot: HotKeys | None = None,
    ) -> None:
        self.df = df
        self.keys = list(keys)
        self.order = list(order)
        self.hot = find_hot_keys(df, keys) if hot is None else hot
        self.cold: DataFrame | None = None
        if self.hot.any:
            self.cold, hot_rows = separate(df, self.hot)
            # Read for the sample, for the block summary and for the rows themselves.
            self.df = cut_lineage(hot_rows)

    def add(self, **wanted: Ordered) -> DataFrame:
        if self.cold is None:
            return self._add_plain(self.df, self.keys, wanted)
        return self._add_plain(self.cold, self.keys, wanted).unionByName(self._add_blocked(wanted))

    # -- one window partition per group ------------------------------------------------------

    def _windows(self, partition: list[str]) -> tuple:
        ascending = Window.partitionBy(*partition).orderBy(*[F.col(c).asc() for c in self.order])
        descending = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in self.order])
        return ascending, descending

    def _expression(self, wanted: Ordered, partition: list[str]) -> Column:
        ascending, descending = self._windows(partition)
        if wanted.kind == "number":
            return F.row_number().over(ascending).cast("long")
        value = F.col(wanted.column)
        if wanted.kind == "previous":
            return F.lag(value).over(ascending)
        if wanted.kind == "next":
            return F.lead(value).over(ascending)
        # A frame that grows from the start costs one pass; the reverse order gives the other side.
        window = ascending if wanted.kind == "last_known" else descending
        growing = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return F.last(value, ignorenulls=True).over(growing)

    def _add_plain(
        self, df: DataFrame, partition: list[str], wanted: dict[str, Ordered]
    ) -> DataFrame:
        return df.select(
            "*", *[self._expression(w, partition).alias(name) for name, w in wanted.items()]
        )

    # -- blocks of a hot group ----------------------------------------------------------------

    def split_points(self) -> DataFrame:
        """Per hot key an array of arrays of split points; bounded by the number of blocks.

        The points come from a sample and are then fixed values, so evaluating the plan again,
        after a lost executor too, cuts the group at the same places.
        """
        hot, spark = self.hot.table, self.df.sparkSession
        n_hot_rows = hot.agg(F.sum("n_rows")).first()[0]
        n_blocks = n_hot_rows // self.hot.rows_per_block + hot.count()
        fraction = min(1.0, SAMPLES_PER_BLOCK * n_blocks / n_hot_rows)
        sample = (
            self.df.join(F.broadcast(hot.select(*self.keys)), self.keys, "left_semi")
            .select(*self.keys, F.struct(*self.order).alias("_at"))
            .sample(fraction=fraction, seed=17)
        )
        by_key = Window.partitionBy(*self.keys).orderBy("_at")
        every = max(1, int(fraction * self.hot.rows_per_block))
        points = (
            sample.withColumn("_n", F.row_number().over(by_key))
            .where(F.col("_n") % F.lit(every) == 0)
            .withColumn("_list", F.floor((F.col("_n") / F.lit(every) - 1) / SPLITS_PER_LIST))
            .groupBy(*self.keys, "_list")
            .agg(F.array_sort(F.collect_list("_at")).alias("_points"))
            .groupBy(*self.keys)
            .agg(F.array_sort(F.collect_list(F.struct("_list", "_points"))).alias("_splits"))
        )
        return spark.createDataFrame(points.collect(), points.schema)

    def _with_blocks(self) -> DataFrame:
        here = F.struct(*self.order)

        def at_or_before(point: Column) -> Column:
            return point <= here

        # Two short searches instead of one long one: first the list, then the place in it.
        lists = F.size(
            F.filter(F.col("_splits"), lambda s: at_or_before(F.get(s["_points"], F.lit(0))))
        )
        inside = F.size(
            F.filter(F.get(F.col("_splits"), lists - 1)["_points"], at_or_before)
        )
        block = (
            F.when(F.col("_splits").isNull() | (lists == 0), F.lit(0))
            .otherwise((lists - 1) * SPLITS_PER_LIST + inside)
        )
        splits = F.broadcast(self.split_points())
        return (
            self.df.join(splits, self.keys, "left")
            .withColumn("_block", block)
            .drop("_splits")
        )

    def _add_blocked(self, wanted: dict[str, Ordered]) -> DataFrame:
        blocked = self._with_blocks()
        partition = [*self.keys, "_block"]
        columns = sorted({w.column for w in wanted.values() if w.column is not None})
        at = F.struct(*self.order)
        summary = blocked.groupBy(*partition).agg(
            F.count(F.lit(1)).alias("_rows"),
            *[F.min_by(F.struct(c), at).alias(f"_first_{c}") for c in columns],
            *[F.max_by(F.struct(c), at).alias(f"_last_{c}") for c in columns],
            *[
                F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), at)).alias(f"_first_known_{c}")
                for c in columns
            ],
            *[
                F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), at)).alias(f"_last_known_{c}")
                for c in columns
            ],
        )
        # One row per block of a hot key: a bounded table, also within one window partition.
        by_block = Window.partitionBy(*self.keys).orderBy("_block")
        before = by_block.rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*self.keys).orderBy(F.col("_block").desc()).rowsBetween(
            Window.unboundedPreceding, -1
        )
        carried = summary.select(
            *partition,
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
            *[F.lag(f"_last_{c}").over(by_block).alias(f"_carry_previous_{c}") for c in columns],
            *[F.lead(f"_first_{c}").over(by_block).alias(f"_carry_next_{c}") for c in columns],
            *[
                F.last(f"_last_known_{c}", ignorenulls=True).over(before)
                .alias(f"_carry_last_known_{c}") for c in columns
            ],
            *[
                F.last(f"_first_known_{c}", ignorenulls=True).over(after)
                .alias(f"_carry_next_known_{c}") for c in columns
            ],
        )
        inner = {f"_in_{name}": w for name, w in wanted.items()}
        ascending, descending = self._windows(partition)
        rows = self._add_plain(blocked, partition, inner).select(
            "*",
            (F.row_number().over(ascending) == 1).alias("_opens"),
            (F.row_number().over(descending) == 1).alias("_closes"),
        ).join(F.broadcast(carried), partition, "left")

        def finished(name: str, w: Ordered) -> Column:
            value = F.col(f"_in_{name}")
            if w.kind == "number":
                return value + F.coalesce(F.col("_offset"), F.lit(0))
            carry = F.col(f"_carry_{w.kind}_{w.column}")[w.column]
            if w.kind == "previous":
                return F.when(F.col("_opens"), carry).otherwise(value)
            if w.kind == "next":
                return F.when(F.col("_closes"), carry).otherwise(value)
            return F.coalesce(value, carry)

        return rows.select(
            *self.df.columns, *[finished(name, w).alias(name) for name, w in wanted.items()]
        )
