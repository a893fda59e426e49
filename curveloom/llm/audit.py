"""Filter interaction audit: relations of failing ids, and what each filter removes after each prefix of others."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curveloom.llm.common import BLANKS, attach, stored, word_count

#: Limits of the five filters (fixed values).
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITALS_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
FILTERS = "ABCDE"

KEY = ["key_a", "key_b"]


@dataclass(frozen=True)
class Audit:
    """Stored relations of one audit: the failing ids of each filter, labelled ids and the size of each part."""

    failing: dict[str, DataFrame]
    labelled: DataFrame
    parts: DataFrame


def text_filters(text: Column) -> dict[str, Column]:
    """What fails a document by its own text: A few words, B few distinct words, C many capitals, D symbols."""
    bare = F.btrim(text, F.lit(BLANKS))
    words = word_count(text)
    distinct = F.when(words > 0, F.size(F.array_distinct(F.split(bare, r"[\x20\x09-\x0D]+")))).otherwise(0)
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * distinct < LEAST_DISTINCT_PERCENT * words,
        "C": 100 * capitals > MOST_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }


def relations(docs: DataFrame, labels: DataFrame) -> Audit:
    """One stored table of failing ids a filter, from whole texts; E fails texts that a smaller doc_id has too.

    An id is a 128-bit hash of doc_id, part and text; rows that repeat all three are one id with a count, so
    neither repeated rows nor null ids fall together. Nulls: a null text is empty, a null lang is the part "", and
    a null doc_id is neither smaller nor larger than another, so E never fails it and no label is its own.
    """
    text, part = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    own = text_filters(F.col("text"))
    plain = docs.select("doc_id", text.alias("text"), part.alias("part")).select(
        "doc_id", "part", *[F.xxhash64(F.lit(i), "text").alias(f"text_{i}") for i in range(2)],
        *[c.alias(name) for name, c in own.items()],
    )
    named = ["doc_id", "part", "text_0", "text_1"]
    rows = stored(plain.select(
        *[F.xxhash64(F.lit(i), *named).alias(k) for i, k in enumerate(KEY)], "*"))

    def ids(found: DataFrame) -> DataFrame:
        return stored(found.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n_docs")))

    failing = {name: ids(rows.where(name)) for name in own}
    same_text = stored(rows.groupBy("text_0", "text_1").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1"))
    failing["E"] = ids(attach(rows, same_text, ["text_0", "text_1"], "n").where("doc_id > least"))

    marks = labels.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")).where("good or toxic")
    rows_of = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("weight"))
    marked = stored(marks.join(rows_of, "doc_id"))
    labelled = stored(attach(rows, marked, ["doc_id"], "weight").groupBy(*KEY).agg(
        F.first("good").alias("good"), F.first("toxic").alias("toxic")))
    return Audit(failing, labelled, stored(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_docs"))))


def _counts(audit: Audit) -> DataFrame:
    """Per part, filter and prefix (a bit set of other filters): removed, redundant, good_lost and toxic_lost.

    Each failing id meets every prefix that does not hold its own filter. A left anti join with the failing
    ids of the prefix's filters leaves what the filter removes after it, a left semi join what the prefix has
    removed before. All joins are on the id, so no key is frequent.
    """
    names = sorted(audit.failing)
    everyone = None
    for i, name in enumerate(names):
        tagged = audit.failing[name].select(*KEY, "part", "n_docs", F.lit(i).alias("own"))
        everyone = tagged if everyone is None else everyone.unionByName(tagged)
    prefixes = F.filter(
        F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)), lambda s: F.getbit(s, F.col("own")) == 0)
    asked = everyone.repartition(*KEY).select("*", F.explode(prefixes).alias("prefix"))
    held = everyone.select(*[F.col(k).alias(f"held_{k}") for k in KEY], F.col("own").alias("bit")).repartition(
        *[f"held_{k}" for k in KEY])
    before = F.getbit("prefix", F.col("bit")) == 1
    for k in KEY:
        before = before & (F.col(k) == F.col(f"held_{k}"))
    group = ["part", "own", "prefix"]
    removed = asked.join(held, before, "left_anti").join(audit.labelled, KEY, "left").groupBy(*group).agg(
        F.sum("n_docs").alias("removed"),
        F.sum(F.when(F.col("good"), F.col("n_docs"))).alias("good_lost"),
        F.sum(F.when(F.col("toxic"), F.col("n_docs"))).alias("toxic_lost"))
    redundant = asked.join(held, before, "left_semi").groupBy(*group).agg(F.sum("n_docs").alias("redundant"))
    return removed.join(redundant, group, "full")


def _steps(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Every order of the filters, step by step, with the filters before each step as a bit set: of a fixed size."""
    rows = []
    for order in permutations(range(len(names))):
        prefix = 0
        for step, own in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, own, prefix))
            prefix |= 1 << own
    schema = T.StructType([T.StructField(n, t) for n, t in (
        ("filter_order", T.StringType()), ("step", T.IntegerType()), ("own", T.IntegerType()),
        ("prefix", T.IntegerType()))])
    return df.sparkSession.createDataFrame(rows, schema)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter removes at each step of every order of the filters, per part (language).

    Returns part, filter_order, step and counts of documents: kept after the step, removed by it, redundant
    (failing, but removed before), unique_fails (failing this filter only), good_lost and toxic_lost (removed,
    and labelled so) and shapley (removed by the filter, summed over all orders). All combinations are returned,
    also with zeros. ``relations`` says what nulls and repeated rows give; an empty table has no parts and
    gives no rows. Only the columns doc_id, text, lang and doc_id, quality, toxic are read.
    """
    audit = relations(docs, labels)
    names = sorted(audit.failing)
    full = (1 << len(names)) - 1
    counts = _counts(audit)
    before = F.bit_count("prefix")
    # A prefix of k filters stands before its filter in k! (n - 1 - k)! orders.
    weight = F.element_at(F.array(*[
        F.lit(factorial(k) * factorial(len(names) - 1 - k)) for k in range(len(names))]), before + 1)
    amounts = ["removed", "redundant", "good_lost", "toxic_lost"]
    subsets = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda s: F.getbit(s, F.col("own")) == 0)
    grid = audit.parts.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))).alias("own")).select(
        "*", F.explode(subsets).alias("prefix"))
    known = stored(grid.join(counts, ["part", "own", "prefix"], "left").select(
        "part", "n_docs", "own", "prefix", *[F.coalesce(c, F.lit(0)).alias(c) for c in amounts]))
    alone = F.col("prefix") == F.lit(full) - F.pow(F.lit(2), F.col("own")).cast("int")
    facts = known.groupBy("part", "own").agg(
        F.sum(F.when(alone, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"))
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    return known.join(F.broadcast(_steps(docs, names)), ["own", "prefix"]).join(facts, ["part", "own"]).select(
        "part", "filter_order", "step", (F.col("n_docs") - F.sum("removed").over(so_far)).alias("kept"),
        "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
