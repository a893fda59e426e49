"""The polar table together with the outlines of its entities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curveloom.functions.scalars import cosine_stations
from curveloom.operators.curves import detect_branches, outline_is_valid, resample_outline
from curveloom.operators.quality import (
    POLAR_COLUMNS, enforce, polar_rules, require_catalogued, require_columns,
)
from curveloom.operators.skew import HotKeys
from curveloom.operators.split import entity_split, fixed_holdout_split
from curveloom.sources.tables import POLAR_SCHEMA, read_csv
from curveloom.sources.text import parse_pairs, point_rows, read_texts, rejected


@dataclass(frozen=True)
class CurveDataset:
    """``polars`` (one row per entity and condition), ``outlines`` (one per entity), ``rejects``."""

    polars: DataFrame
    outlines: DataFrame
    rejects: DataFrame

    def validate(self) -> "CurveDataset":
        """Fail unless all columns exist, the rules hold and every entity has an outline."""
        require_columns(self.polars, POLAR_COLUMNS, "polar")
        enforce(self.polars, polar_rules([c for c in POLAR_COLUMNS if c != "entity_id"]))
        require_catalogued(self.polars, self.outlines, "entity_id")
        return self

    def split(self, holdout: DataFrame | None = None, seed: int = 42, **fractions: float) -> DataFrame:
        """(entity_id, split); no entity is on two sides."""
        if holdout is None:
            return entity_split(self.polars, "entity_id", seed=seed, strict=True, **fractions)
        return fixed_holdout_split(
            self.polars, "entity_id", holdout, seed=seed, strict=True, **fractions
        )


def outlines_from_texts(
    texts: DataFrame, n_points: int = 100, hot: HotKeys | None = None
) -> tuple[DataFrame, DataFrame]:
    """Resampled outlines from (entity_id, text) and the rejects of either step with reason."""
    parsed = parse_pairs(texts)
    branches, unusable = detect_branches(
        point_rows(parsed, ["entity_id"]), ["entity_id"], "x", "y", "ord", hot
    )
    outlines = resample_outline(branches, ["entity_id"], "x", "y", cosine_stations(n_points)).where(
        outline_is_valid(F.col("x"), F.col("upper_y"), F.col("lower_y"))
    )
    return outlines, rejected(parsed, ["entity_id"]).unionByName(unusable)


def coordinate_texts(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity_id, text): one text of each entity that has any, from ``texts`` (path, text).

    A file belongs to the entity its name spells, in either case, with ``.dat``, ``.txt`` or nothing
    behind it; of several the first in this order is taken, then the first path.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    endings = {".dat": 0, ".txt": 1}
    candidates = [
        F.struct(F.regexp_replace(name, rf"\{ending}$", "").alias("stem"), F.lit(place).alias("place"))
        for ending, place in endings.items()
    ]
    entries = F.filter(
        F.array(*candidates, F.struct(name.alias("stem"), F.lit(2).alias("place"))),
        lambda c: (c["place"] == 2) | (c["stem"] != name),
    )
    named = texts.select("path", "text", F.explode(entries).alias("_c"))
    wanted = entities.select("entity_id").distinct()
    return wanted.join(named, F.lower("entity_id") == F.col("_c.stem")).groupBy("entity_id").agg(
        F.min_by("text", F.struct("_c.place", "path")).alias("text")
    )


def load_dataset(
    spark: SparkSession, polar_csv: str, coordinates: str, n_points: int = 100,
    strict: bool = True,
) -> CurveDataset:
    """Polars from CSV, outlines from a folder with one coordinate file per entity."""
    polars = read_csv(spark, polar_csv, POLAR_SCHEMA)
    matched = coordinate_texts(polars.select("entity_id"), read_texts(spark, coordinates))
    outlines, rejects = outlines_from_texts(matched, n_points)
    dataset = CurveDataset(polars, outlines, rejects)
    return dataset.validate() if strict else dataset
