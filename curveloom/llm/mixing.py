"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveloom.llm.common import stored, unused, word_count

#: Weights dealt to the sources in the order of their names, again and again.
WEIGHTS = (3, 1, 2)
#: What the mix holds, as a share of all words, and how often a source may be repeated at most.
SHARE, MOST_PASSES = 1.5, 2
#: Words in a block.
BLOCK = 32
#: Documents in a shard, and shards in a group; apportionment goes from source to group to shard.
SHARD_DOCS, GROUP_SHARDS = 512, 1024
SEED = 42


def seeded(*parts: Column | str, seed: int = SEED) -> Column:
    """A number below 2**60 drawn from the md5 of the parts and the seed; null counts as empty."""
    texts = [F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts, F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE,
                   passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, n_docs, place, target): words each source shall give.

    ``share`` of all words is shared by weight; a target stops at ``passes`` times its source, and
    what is left is shared among the others by weight until none is above. Sources stand in the order
    of their code points, null last. The windows run over one row a source.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    places = sources.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") - 1) % len(weights) + 1)
    )
    # Sources reach their stop in the order of stop / weight. Level: what a unit of weight gets if
    # exactly the sources before stop. The first source that does not stop at its level sets it for all.
    stop = F.col("source_size") * F.lit(passes)
    by_stop = Window.orderBy(stop / F.col("weight"), "place")
    everyone = Window.partitionBy()
    levels = places.select(
        "*", stop.alias("stop"),
        F.coalesce(F.sum(stop).over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("weight").over(by_stop.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        (F.sum("source_size").over(everyone) * F.lit(share)).alias("budget"),
    ).withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    holds = F.col("level") * F.col("weight") <= F.col("stop")
    set_for_all = F.min(F.when(holds, F.struct(F.col("stop") / F.col("weight"), "place", "level"))).over(everyone)
    return levels.withColumn("level", set_for_all["level"]).select(
        "source", "source_size", "n_docs", "place",
        F.least(F.col("stop").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop").cast("double"))).alias("target"),
    )


def apportion(parties: DataFrame, within: Sequence[str], names: Sequence[str], votes: str, seats: str,
              gains: str) -> DataFrame:
    """Add ``gains``: the seats each party gets of the ``seats`` of its electorate ``within``.

    Sainte-Laguë: the seats go to the highest quotients votes / (2k + 1); ties go by ``names``. With n
    parties a divisor of votes / (seats + n/2) gives seats enough and one of votes / (seats - n/2) not
    too many, so only the quotients between these, about two a party, are ranked.
    """
    everyone = Window.partitionBy(*within)
    total, n = F.sum(votes).over(everyone), F.count(F.when(F.col(votes) > 0, 1)).over(everyone)
    counted = parties.select("*", total.cast("double").alias("__all"), n.alias("__n"))
    share = F.col(votes) / F.col("__all")
    least = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("__n") / 2) + 0.5) - 1)
    most = F.floor(share * (F.col(seats) + F.col("__n") / 2) + 0.5) + 1
    bounded = counted.select(
        "*", F.when(F.col(votes) > 0, least).otherwise(0).cast("long").alias("__least"),
        F.when(F.col(votes) > 0, most).otherwise(0).cast("long").alias("__most"),
    ).withColumn("__open", F.col(seats) - F.sum("__least").over(everyone))
    quotients = bounded.where("__most > __least").select(
        *within, *names, "__open", F.col(votes).alias("__votes"),
        F.explode(F.sequence("__least", F.col("__most") - 1)).alias("__k"),
    ).withColumn("__quotient", F.col("__votes") / (2 * F.col("__k") + 1))
    ranked = quotients.withColumn("__rank", F.row_number().over(
        Window.partitionBy(*within).orderBy(F.col("__quotient").desc(), *names)
    )).where("__rank <= __open")
    won = ranked.groupBy(*within, *names).agg(F.count(F.lit(1)).alias("__won"))
    keys = [*within, *names]
    won = won.select(*[F.col(k).alias(f"__{k}") for k in keys], "__won")
    joined = F.lit(True)
    for k in keys:
        joined = joined & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return bounded.join(won, joined, "left").select(
        *parties.columns, (F.col("__least") + F.coalesce("__won", F.lit(0))).alias(gains)
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES,
        block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED) -> DataFrame:
    """Words to take from every document.

    Returns doc_id, source, size, source_size, target, taken and where the words are: ``whole``
    (times the whole text is taken) and the words from ``part_start`` on, ``part_words`` of them and
    ``more_words`` from the start of the text, in a last, partial pass.

    The targets become blocks of ``block`` words, apportioned to sources, to groups of shards and to
    shards, each by Sainte-Laguë. Shards are dealt by hash of doc_id, so a source of any size is many
    shards. The documents of a shard stand in seeded order as a ring of words; its quota of blocks is
    taken from a seeded block on, around the ring. Null texts have size 0 and give nothing; a null
    source is a source of its own; repeated rows are documents of their own. Reruns agree.
    """
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sizes, weights, share, passes).withColumn(
        "__seats", F.floor(F.sum("source_size").over(Window.partitionBy()) * F.lit(share) / block + 0.5)
    )
    targets = apportion(targets, [], ["place"], "target", "__seats", "quota").drop("__seats")
    targets = stored(targets.withColumnRenamed("source", "name"))
    # One row a source: below the optimizer's limit it is broadcast, else both sides are shuffled.
    placed = sizes.join(targets, sizes["source"].eqNullSafe(targets["name"])).select(
        "doc_id", "source", "size", "place",
        F.pmod(seeded("doc_id", F.lit("shard"), seed=seed), F.ceil(F.col("n_docs") / shard_docs)).alias("shard"),
        seeded("doc_id", F.lit("order"), seed=seed).alias("draw"),
    ).withColumn("part", F.floor(F.col("shard") / GROUP_SHARDS))
    shards = stored(placed.groupBy("place", "part", "shard").agg(F.sum("size").alias("shard_size")))
    groups = shards.groupBy("place", "part").agg(F.sum("shard_size").alias("group_size"))
    groups = apportion(groups.join(targets.select("place", "quota"), "place"), ["place"], ["part"],
                       "group_size", "quota", "group_quota")
    quotas = apportion(shards.join(groups.select("place", "part", "group_quota"), ["place", "part"]),
                       ["place", "part"], ["shard"], "shard_size", "group_quota", "blocks")
    runs = stored(quotas.select(
        "place", "shard", "shard_size",
        F.least(F.col("blocks") * block, F.col("shard_size") * passes).alias("run"),
        (F.pmod(seeded("place", "shard", F.lit("start"), seed=seed),
                F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block))) * block).alias("start"),
    ))
    ring = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, 0)
    at = placed.withColumn("end", F.sum("size").over(ring)).join(runs, ["place", "shard"]).join(
        targets.select("place", "source_size", "target"), "place"
    ).withColumn("begin", F.col("end") - F.col("size"))
    # The run goes around the ring ``whole`` times; its rest covers [start, start + rest), of which
    # what lies beyond the end of the ring is [0, over).
    rest = F.when(F.col("shard_size") > 0, F.col("run") % F.col("shard_size")).otherwise(0)
    whole = F.when(F.col("shard_size") > 0, F.floor(F.col("run") / F.col("shard_size"))).otherwise(0)
    over = F.greatest(F.lit(0), F.col("start") + F.col("rest") - F.col("shard_size"))
    first = F.greatest(F.col("begin"), F.col("start"))
    return at.withColumns({"rest": rest, "whole": whole}).withColumn("over", over).select(
        "doc_id", "source", "size", "source_size", "target", "whole",
        F.when(F.least(F.col("end"), F.col("start") + F.col("rest")) > first, first - F.col("begin"))
        .otherwise(0).alias("part_start"),
        F.greatest(F.lit(0), F.least(F.col("end"), F.col("start") + F.col("rest")) - first).alias("part_words"),
        F.greatest(F.lit(0), F.least(F.col("end"), F.col("over")) - F.col("begin")).alias("more_words"),
    ).withColumn("taken", F.col("size") * F.col("whole") + F.col("part_words") + F.col("more_words"))


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of the mix with its standing parameters."""
    return mix(docs).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _most_first(x: Column, y: Column) -> Column:
    return F.when(x > y, -1).when(x < y, 1).otherwise(0)


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix as rows of ``docs``: a whole text as often as it is taken whole, and the words that a
    partial pass takes, in their order, as a text of their own with the white space before each word.

    Documents of which nothing is taken go. Rows that repeat a doc_id fare alike only if their sizes
    are equal; which of them a partial pass meets is not defined.
    """
    taken = mix(docs.select("doc_id", "source", "text"), **options)
    key_a, key_b, decided, n = unused(docs, "__a", "__b", "__all", "__n")

    def row_key(size: Column) -> list[Column]:
        """Two numbers for id, source and size of a row: joins and windows on them deal rows once."""
        return [F.xxhash64(F.lit(i), "doc_id", "source", size).alias(name) for i, name in enumerate((key_a, key_b))]

    decisions = taken.select(
        *row_key(F.col("size")), F.struct("taken", "whole", "part_start", "part_words", "more_words").alias("decision"),
    ).groupBy(key_a, key_b).agg(F.array_sort(F.collect_list("decision"), _most_first).alias(decided))
    # The n-th row of an id meets the n-th decision; ids are nearly unique, so these are small windows.
    nth = F.row_number().over(Window.partitionBy(key_a, key_b).orderBy(F.xxhash64("text")))
    rows = docs.select("*", *row_key(word_count(F.col("text")))).withColumn(n, nth)
    copy, decision = unused(docs, "__copy", "__decision")
    met = rows.join(decisions, [key_a, key_b]).select(
        *docs.columns, F.get(decided, F.col(n) - 1).alias(decision),
    ).where(F.col(decision)["taken"] > 0)
    whole, begin, count, rest = (F.col(decision)[c] for c in ("whole", "part_start", "part_words", "more_words"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = lambda start, n: F.array_join(F.slice(words, start + 1, n), "")
    zero = F.lit(0)
    times = F.when(whole > 0, F.array_repeat("text", whole.cast("int"))).otherwise(
        F.array().cast("array<string>"))
    part = F.when(count > 0, F.array(cut(begin.cast("int"), count.cast("int"))))
    more = F.when(rest > 0, F.array(cut(zero, rest.cast("int"))))
    none = F.array().cast("array<string>")
    copies = F.concat(times, F.coalesce(part, none), F.coalesce(more, none))
    return met.withColumn(copy, F.explode(copies)).select(
        *[F.col(copy).alias(c) if c == "text" else docs[c] for c in docs.columns])
