"""Exact line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import BLANKS, HOT_PARTS, stored, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of a level that are compacted into one run of the next.
FANOUT = 4
#: Batches in which a whole table is added to the runs; more than ``FANOUT``, so later ones meet compacted runs.
BATCHES = 6


def line_key(line: Column) -> Column:
    """The line with ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _row_key(prefix: int) -> Column:
    """One half of what identifies a row; rows that repeat id and text share it and fare alike."""
    return F.xxhash64(F.lit(prefix), "doc_id", "text")


def line_hashes(docs: DataFrame, least_length: int = 40) -> DataFrame:
    """One row for each line whose key has ``least_length`` code points or more.

    (row_a, row_b) identify the row, (key_a, key_b) the key by 128 bits, ``at`` is the place of the
    line from 0, and ``first`` says whether the key occurs in the row for the first time.
    """
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), line_key)
    hashed = F.transform(keys, lambda key, i: F.struct(
        F.when(F.length(key) >= least_length, F.xxhash64(key)).alias("key_a"),
        F.xxhash64(F.lit(1), key).alias("key_b"), i.alias("at"),
    ))
    long_enough = F.array_sort(F.filter(hashed, lambda line: line["key_a"].isNotNull()))
    rows = docs.select("doc_id", _row_key(0).alias("row_a"), _row_key(1).alias("row_b"),
                       long_enough.alias("lines"))
    marked = F.transform("lines", lambda line, i: F.struct(
        line["key_a"].alias("key_a"), line["key_b"].alias("key_b"), line["at"].alias("at"),
        F.when(i == 0, F.lit(True)).otherwise(
            (F.get("lines", i - 1)["key_a"] != line["key_a"]) | (F.get("lines", i - 1)["key_b"] != line["key_b"])
        ).alias("first"),
    ))
    return rows.select("doc_id", "row_a", "row_b", F.inline(marked))


def _document_rows(lines: DataFrame) -> DataFrame:
    """One row for each key and document; rows that share a doc_id are one document."""
    return lines.where("first").select("key_a", "key_b", "doc_id")


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("key_a", "key_b").agg(
        F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.sum("n_lines").alias("n_lines")
    )


@dataclass
class LineRuns:
    """Levelled runs: each is a stored table of keys, sorted by hash, with the number of documents
    that hold the key, the largest doc_id of them and the number of lines.

    A new batch is anti-joined with the runs. Its keys that no run holds become a run of level 0, so runs never
    share a key; counts of the keys that are known already are kept beside the runs, as ``updates``. ``FANOUT``
    runs of a level are compacted into one of the next, so n batches leave a number of runs that grows with the
    logarithm of n and each key is rewritten as often. Batches must not share documents.
    """

    fanout: int = FANOUT
    levels: list[list[DataFrame]] = field(default_factory=list)
    updates: list[DataFrame] = field(default_factory=list)

    def add(self, lines: DataFrame) -> None:
        """Add the lines of a batch, as ``line_hashes`` gives them."""
        counts = _document_rows(lines).distinct().groupBy("key_a", "key_b").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        if self.levels:
            counts = stored(counts)
            self.updates.append(stored(counts.join(self._keys(), ["key_a", "key_b"], "left_semi")))
        self._push(0, self.unseen(counts))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stored(run.sortWithinPartitions("key_a", "key_b")))
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(level + 1, self._union(full).repartition("key_a"))

    @staticmethod
    def _union(runs: list[DataFrame]) -> DataFrame:
        first, *rest = runs
        for run in rest:
            first = first.unionByName(run)
        return first

    @property
    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _keys(self) -> DataFrame:
        return self._union(self.runs).select("key_a", "key_b")

    def known(self) -> DataFrame:
        """(key_a, key_b, n_docs, last_doc, n_lines) over all batches: the runs, and what was counted again."""
        if not self.runs:
            raise ValueError("no batch was added")
        return _merged(self._union(self.runs + self.updates)) if self.updates else self._union(self.runs)

    def unseen(self, lines: DataFrame) -> DataFrame:
        """The lines, or counted keys, of a batch whose key no run holds: the anti-join with the runs, which are
        read as one table so that the batch is shuffled once."""
        return lines.join(self._keys(), ["key_a", "key_b"], "left_anti") if self.runs else lines


def repeated_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5,
                   batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(row_a, row_b, at) of the lines that go.

    A key held by ``least_docs`` documents or more loses its lines in all rows but those of the
    largest doc_id holding it. A null id counts as one document below all others.
    """
    # A line is hashed once, whatever the number of batches.
    lines = stored(line_hashes(docs, least_length).withColumn(
        "batch", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(batches)).cast("int")
    ))
    runs = LineRuns(fanout)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch))
    frequent = stored(runs.known().where(F.col("n_docs") >= least_docs))
    total = frequent.agg(F.sum("n_lines")).first()[0] or 0
    # Keys above one part in HOT_PARTS of the frequent lines are fewer than that: broadcast.
    is_hot = F.col("n_lines") * F.lit(HOT_PARTS) > F.lit(total)
    columns = ["key_a", "key_b", "last_doc"]
    hot, cold = frequent.where(is_hot).select(columns), frequent.where(~is_hot).select(columns)
    few = F.broadcast(hot)
    held = lines.join(few, ["key_a", "key_b"]).unionByName(
        lines.join(F.broadcast(hot.select("key_a", "key_b")), ["key_a", "key_b"], "left_anti").join(
            cold, ["key_a", "key_b"])
    )
    return held.where(~F.col("doc_id").eqNullSafe(F.col("last_doc"))).select("row_a", "row_b", "at")


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the places of the sorted array ``dropped``, as slices between them: one pass."""
    n = F.size(dropped)
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(
        lines,
        F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1) + 1,
        F.when(i == n, F.size(lines)).otherwise(F.get(dropped, i))
        - F.when(i == 0, 0).otherwise(F.get(dropped, i - 1) + 1),
    )))


def drop_repeated_lines(docs: DataFrame, least_length: int = 40, least_docs: int = 5,
                        batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All columns of ``docs`` with ``text`` freed of repeated lines, and n_lines and n_dropped (long).

    Texts are split at \\n; null and empty texts are one empty line, and stay as they are. Lines that
    stay are joined by \\n as they were. Each text is shuffled once, to meet its list of places.
    """
    at, a, b, row_a, row_b = unused(docs, "__at", "__a", "__b", "__ra", "__rb")
    gone = repeated_lines(
        docs.select("doc_id", "text"), least_length, least_docs, batches, fanout
    ).groupBy("row_a", "row_b").agg(F.array_sort(F.collect_set("at")).alias(at))
    gone = gone.select(F.col("row_a").alias(a), F.col("row_b").alias(b), at)
    keyed = docs.select("*", _row_key(0).alias(row_a), _row_key(1).alias(row_b))
    met = keyed.join(
        gone, (F.col(row_a) == F.col(a)) & (F.col(row_b) == F.col(b)), "left"
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(
        F.array_join(_without(lines, F.col(at)), "\n"))
    kept = [text.alias(c) if c == "text" else docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(
        *kept, F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of the table without its repeated lines."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )
