"""Finding the few keys that are too large for one task, and joining around them.

A key is *hot* when it holds more rows than a task should work on: a share of all rows, and never
more than ``TASK_ROWS``, however large the table. A list of hot keys too long to be broadcast is
joined by a shuffle; everything else uses ordinary shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveloom.session import shared_folder

# Keys below this many rows are never worth splitting, whatever their share.
SMALLEST_HOT_KEY = 2_000_000
# A hot key holds more than 1 / (4 * shuffle partitions) of the rows, or more than a task's budget.
HOT_KEYS_PER_PARTITION = 4
TASK_ROWS = 20_000_000
# Up to this many hot keys are broadcast.
MOST_BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class HotKeys:
    """Hot keys of a table: ``table`` holds the key columns and ``n_rows``; None when there are none."""

    keys: tuple[str, ...]
    rows_per_block: int
    table: DataFrame | None = None
    few: bool = True

    @property
    def any(self) -> bool:
        return self.table is not None

    def small(self, df: DataFrame) -> DataFrame:
        """A table of one row a hot key, marked for broadcasting if the keys are few."""
        return F.broadcast(df) if self.few else df

    def finer(self, keys: Sequence[str]) -> "HotKeys | None":
        """The same verdict for a key that refines this one; None (to be measured) when some are hot."""
        return None if self.any else HotKeys(tuple(keys), self.rows_per_block)


def find_hot_keys(
    df: DataFrame, keys: Sequence[str], smallest: int = SMALLEST_HOT_KEY
) -> HotKeys:
    """Measure ``df`` (only its key columns are read) and list the hot keys."""
    keys = tuple(keys)
    spark = df.sparkSession
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.agg(F.sum("n_rows").alias("total"), F.max("n_rows").alias("largest")).first()
    total, largest = totals["total"] or 0, totals["largest"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, int(HOT_KEYS_PER_PARTITION * partitions))
    threshold = min(max(smallest, total // pieces), max(smallest, TASK_ROWS))
    if largest <= threshold:
        return HotKeys(keys, threshold)
    hot = counts.where(F.col("n_rows") > F.lit(threshold))
    # Fewer than total / threshold keys can be hot.
    few = total // threshold <= MOST_BROADCAST_KEYS
    table = spark.createDataFrame(hot.collect(), hot.schema) if few else cut_lineage(hot)
    return HotKeys(keys, threshold, table, few)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Keep ``df`` as files in the shared folder the cluster names in ``spark.checkpoint.dir``.

    For plans that read ``df`` more than once: without it every further step would repeat all
    earlier ones.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def separate(rows: DataFrame, hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys, and rows of hot keys; null keys are never hot."""
    keys = list(hot.keys)
    hot_list = hot.small(hot.table.select(*keys))
    return (
        rows.join(hot_list, keys, "left_anti").select(*rows.columns),
        rows.join(hot_list, keys, "left_semi").select(*rows.columns),
    )


def attach(rows: DataFrame, facts: DataFrame, hot: HotKeys, how: str = "inner") -> DataFrame:
    """Join one row of facts per key onto many rows per key.

    Without hot keys this is a plain equi-join whose strategy the optimizer picks. With hot keys
    their facts (a bounded number of rows) are broadcast and only the other keys are shuffled.
    """
    keys = list(hot.keys)
    if not hot.any:
        return rows.join(facts, keys, how)
    hot_list = hot.small(hot.table.select(*keys))
    cold = rows.join(hot_list, keys, "left_anti").join(
        facts.join(hot_list, keys, "left_anti"), keys, how
    )
    split = rows.join(hot_list, keys, "left_semi").join(
        hot.small(facts.join(hot_list, keys, "left_semi")), keys, how
    )
    return cold.unionByName(split)


def with_facts(rows: DataFrame, facts: dict[str, Column], hot: HotKeys) -> DataFrame:
    """Add aggregates of each key to all its rows.

    Keys of ordinary size are window aggregates: consecutive steps on the same key then share one
    shuffle and read the source once. Rows of hot keys are stored, aggregated before the shuffle and
    met with their one row of facts.
    """
    window = Window.partitionBy(*hot.keys)
    over_windows = [c.over(window).alias(name) for name, c in facts.items()]
    if not hot.any:
        return rows.select("*", *over_windows)
    cold, hot_rows = separate(rows, hot)
    hot_rows = cut_lineage(hot_rows)
    per_key = hot_rows.groupBy(*hot.keys).agg(*[c.alias(name) for name, c in facts.items()])
    return cold.select("*", *over_windows).unionByName(
        hot_rows.join(hot.small(per_key), list(hot.keys)).select(*rows.columns, *facts)
    )


def reasons(rows: DataFrame, keys: Sequence[str], reason: str = "reason") -> DataFrame:
    """One row (keys, reason) per rejected key."""
    return rows.where(F.col(reason).isNotNull()).groupBy(*keys).agg(
        F.min(reason).alias("reason")
    )
