"""Tolerant parsing of whitespace tables held in text: one text per row or per file.

A text is parsed inside its row with array functions, so parsing shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curveloom.functions.scalars import is_whole, ratio_or_null

FEWEST_ROWS = 8

# Line ends and a plain decimal number (fixed patterns).
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_OR_SPECIAL = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|nan|inf|infinity)$"

POLAR_FIELDS = ("alpha", "CL", "CD", "CDp", "CM", "Top_Xtr", "Bot_Xtr")
DUMP_FIELDS = ("s", "x", "y", "ue_vinf", "dstar", "theta", "cf")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def parse_lines(
    text: Column, fields: Sequence[str], commas: bool = False, specials: bool = False
) -> Column:
    """Array of structs of the first numbers of every line that starts with enough of them."""
    pattern = NUMBER_OR_SPECIAL if specials else NUMBER
    separator = r"[\s,]+" if commas else r"\s+"

    def words(line: Column) -> Column:
        # One field more than needed: the rest of the line stays unsplit.
        start = r"^[\s,]+" if commas else r"^\s+"
        return F.slice(
            F.split(F.lower(F.regexp_replace(line, start, "")), separator, len(fields) + 1),
            1, len(fields),
        )

    def numbers(found: Column) -> Column:
        good = (F.size(found) == len(fields)) & F.forall(found, lambda w: w.rlike(pattern))
        return F.when(good, F.transform(found, lambda w: w.try_cast("double")))

    def named(values: Column) -> Column:
        return F.struct(*[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(fields)])

    # Each step is bound to the next one's variable, so a line is split and read once.
    split = F.transform(F.split(text, LINE_END), words)
    read = F.filter(F.transform(split, numbers), lambda values: values.isNotNull())
    return F.transform(read, named)


def parse_pairs(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``points`` (array of x, y) and ``reason`` (NULL for a usable text).

    The first two fields of a line count; commas separate too; other lines are skipped. At least
    eight finite pairs are needed. A leading pair of point counts is dropped: whole numbers above
    2 in front of at least nine pairs that all stay within 2.
    """
    infinity = F.lit(float("inf"))
    pairs = F.filter(
        parse_lines(F.col(text), ("x", "y"), commas=True),
        lambda p: (F.abs(p["x"]) < infinity) & (F.abs(p["y"]) < infinity),
    )
    first = F.get("_pairs", F.lit(0))
    rest = F.slice("_pairs", 2, F.greatest(F.size("_pairs") - 1, F.lit(0)))
    counts = (
        (F.size("_pairs") > FEWEST_ROWS + 1)
        & (first["x"] > 2.0) & (first["y"] > 2.0) & is_whole(first["x"]) & is_whole(first["y"])
        & F.forall(rest, lambda p: (F.abs(p["x"]) <= 2.0) & (F.abs(p["y"]) <= 2.0))
    )
    return df.withColumn("_pairs", pairs).withColumns({
        "points": F.when(counts, rest).otherwise(F.col("_pairs")),
        "reason": F.when(
            F.size("_pairs") < FEWEST_ROWS, F.lit("at least eight numeric rows are required")
        ),
    }).drop("_pairs")


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reason").isNull()).drop("reason")


def rejected(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parsed.where(F.col("reason").isNotNull()).select(*keys, "reason")


def point_rows(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per point of the usable texts: keys, ord from 1, x, y."""
    return usable(parsed).select(*keys, F.posexplode("points").alias("_i", "_p")).select(
        *keys, (F.col("_i") + 1).alias("ord"), "_p.x", "_p.y"
    )


def parse_polar(df: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Rows of seven numbers as a result table; a NULL or empty text gives no rows."""
    parsed = parse_lines(F.coalesce(F.col(text), F.lit("")), POLAR_FIELDS, specials=True)
    return df.select(*keys, F.posexplode(parsed).alias("_i", "_r")).select(
        *keys, (F.col("_i") + 1).alias("ord"), "_r.*"
    )


def parse_dump(df: DataFrame, keys: Sequence[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows of seven numbers with the shape factor H; too short or missing texts are rejected.

    A zero momentum thickness and non-finite values become NULL.
    """
    parsed = df.withColumn("_rows", parse_lines(F.col(text), DUMP_FIELDS, specials=True))
    reason = F.when(F.col(text).isNull(), F.lit("text is missing")).when(
        F.size("_rows") < FEWEST_ROWS, F.lit("the text has not enough rows")
    )
    checked = parsed.withColumn("reason", reason)
    infinity = F.lit(float("inf"))

    def clean(c: Column) -> Column:
        return F.when((F.abs(c) < infinity) & ~F.isnan(c), c)

    rows = checked.where(F.col("reason").isNull()).select(
        *keys, F.posexplode("_rows").alias("_i", "_r")
    ).select(
        *keys, (F.col("_i") + 1).alias("ord"),
        *[clean(F.col("_r")[c]).alias(c) for c in DUMP_FIELDS],
        ratio_or_null(F.col("_r")["dstar"], F.col("_r")["theta"]).alias("H"),
    )
    return rows, rejected(checked, keys)
