"""Matching requested conditions to returned ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.operators.curves import thousandths
from curveloom.operators.ordered import OrderedRows, last_known, next_known
from curveloom.operators.skew import HotKeys, attach, find_hot_keys

MATCH_TOLERANCE = 1e-3


def nearest_match(
    requested: DataFrame,
    returned: DataFrame,
    keys: Sequence[str],
    value: str,
    payload: Sequence[str],
    ordinal: str,
    tolerance: float = MATCH_TOLERANCE,
    hot: HotKeys | None = None,
) -> DataFrame:
    """The returned row closest in ``value`` to each requested row, within ``tolerance``.

    Both sides are merged in value order, so the candidates of a request are the nearest returned
    value on either side: no pairs are formed. Of equally close rows the one with the smaller
    ordinal wins. Adds ``matched`` (the returned value) and the payload, NULL without a match.
    """
    keys = list(keys)
    # Of equal returned values only the first can win.
    best = returned.groupBy(*keys, value).agg(
        F.min(F.struct(ordinal, *payload)).alias("_hit")
    )
    kept = requested.columns
    asked = requested.select(
        *keys, value, F.lit(1).alias("_kind"), F.struct(*kept).alias("_row")
    )
    answers = best.select(
        *keys, value, F.lit(0).alias("_kind"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"),
        F.struct(F.col(value).alias("value"), F.col("_hit").alias("hit")).alias("_hit"),
    )
    merged = answers.unionByName(asked, allowMissingColumns=True)
    if hot is None:
        # Counted before duplicates are removed: cheaper, and never too few.
        hot = find_hot_keys(requested.select(*keys).unionByName(returned.select(*keys)), keys)
    seen = OrderedRows(merged, keys, [value, "_kind"], hot).add(
        _below=last_known("_hit"), _above=next_known("_hit")
    ).where(F.col("_kind") == 1)

    def candidate(side: str) -> Column:
        c = F.col(side)
        return F.when(c.isNotNull(), F.struct(
            F.abs(c["value"] - F.col(value)).alias("distance"),
            c["hit"][ordinal].alias("ordinal"),
            c.alias("match"),
        ))

    chosen = F.least(candidate("_below"), candidate("_above"))
    within = chosen["distance"] <= F.lit(tolerance)
    return seen.withColumn("_chosen", F.when(within, chosen["match"])).select(
        *[F.col("_row")[c].alias(c) for c in kept],
        F.col("_chosen")["value"].alias("matched"),
        *[F.col("_chosen")["hit"][c].alias(c) for c in payload],
    )


def unmatched(matched: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Failure rows of ``nearest_match``."""
    return matched.where(F.col("matched").isNull()).select(
        *keys,
        value,
        F.concat(
            F.lit("condition "), F.format_string("%.3f", F.col(value)), F.lit(": not returned")
        ).alias("reason"),
    )


def rounded_key_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, payload: Sequence[str],
    ordinal: str, how: str = "left",
) -> DataFrame:
    """Join on ``value`` rounded to three decimals; the last right row of a key wins."""
    keys = list(keys)
    keyed = right.withColumn("_key", thousandths(F.col(value))).groupBy(*keys, "_key").agg(
        F.max(F.struct(ordinal, *payload)).alias("_hit")
    )
    asked = left.withColumn("_key", thousandths(F.col(value)))
    return attach(asked, keyed, find_hot_keys(asked, [*keys, "_key"]), how).select(
        *left.columns, *[F.col("_hit")[c].alias(c) for c in payload]
    )


def broadcast_conditions(df: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Expand condition arrays row by row; arrays of one value stretch to the longest."""
    longest = F.greatest(*[F.size(c) for c in conditions]) if len(conditions) > 1 else F.size(conditions[0])
    fits = F.lit(True)
    for c in conditions:
        fits = fits & ((F.size(c) == 1) | (F.size(c) == longest))
    stretched = [
        F.when(F.size(c) == 1, F.array_repeat(F.get(F.col(c), F.lit(0)), longest)).otherwise(F.col(c))
        .alias(c)
        for c in conditions
    ]
    others = [c for c in df.columns if c not in conditions]
    checked = df.select(
        *others,
        F.when(fits, F.arrays_zip(*stretched)).otherwise(
            F.raise_error(F.lit("condition arrays have different lengths"))
        ).alias("_zip"),
    )
    return checked.select(*others, F.posexplode("_zip").alias("condition_no", "_c")).select(
        *others, "condition_no", *[F.col("_c")[c].alias(c) for c in conditions]
    )


def sweep(df: DataFrame, **axes: Column) -> DataFrame:
    """Every combination of the axis arrays for each row (row-local, nothing is shuffled)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(values))
    return df


def resolve_entities(specs: DataFrame, catalog: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Look up each spec by its normalised name; returns (resolved, rejects with reason)."""
    key = F.lower(F.trim(F.col(name)))
    carried = [c for c in catalog.columns if c != name]
    # Of entries with the same normalised name the smallest row is used, on every run.
    entries = catalog.groupBy(key.alias("_name")).agg(F.min(F.struct(*carried)).alias("_entry"))
    named = specs.withColumn("_name", key)
    looked = attach(named, entries, find_hot_keys(named, ["_name"]), "left")
    resolved = looked.where(F.col("_entry").isNotNull()).select(
        *specs.columns, *[F.col("_entry")[c].alias(c) for c in carried]
    )
    rejected = looked.where(F.col("_entry").isNull()).select(
        *specs.columns, F.lit("could not resolve the name").alias("reason")
    )
    return resolved, rejected
