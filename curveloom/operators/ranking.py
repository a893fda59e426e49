"""Exact ranks over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curveloom.functions.draws import digest

# Three hex digits: 4,096 ranges of md5 values, evenly filled whatever the ids look like.
PREFIX_DIGITS = 3


def rank_by_digest(ids: DataFrame, id_column: str, seed: int, stream: str = "") -> DataFrame:
    """Distinct ids in the order of their seeded md5: columns id, ``position``, ``n_ids``.

    Ids are ranked inside ranges of the digest; the range sizes (4,096 rows at most) give the
    offset of each range. Only that bounded table is ever sorted in one place.
    """
    keyed = ids.select(id_column).distinct().withColumn(
        "_digest", digest(F.col(id_column), seed, stream)
    ).withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
    sizes = keyed.groupBy("_prefix").agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy(F.lit(0))
    earlier = everything.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_prefix",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(everything).alias("n_ids"),
    )
    inside = Window.partitionBy("_prefix").orderBy("_digest", id_column)
    return (
        keyed.withColumn("_inside", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_prefix")
        .select(
            id_column,
            (F.col("_offset") + F.col("_inside")).alias("position"),
            "n_ids",
        )
    )
