"""Near duplicates by SimHash fingerprints, linked by shards of a vantage-point tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import attach, map_batches, stored, text_bytes, unused
from curveloom.llm.components import connected_components

#: Fingerprints the tree is fitted on at most; the tree only places shards, all fingerprints are linked.
TREE_SAMPLE = 65_536
#: Fingerprints a shard should hold; inside a shard the same split goes on down to this size.
LEAF = 4_096
#: Most distances computed at once.
BLOCK = 1 << 22


def _fingerprint(text: bytes | None, n: int) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    width = min(n, len(words))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(first), 1 << 16):
        hashes = np.array(
            [digest(joined[a:b], 42) for a, b in zip(first[at:at + (1 << 16)], last[at:at + (1 << 16)])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of each whole text.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles of ``shingle`` words are joined
    by one space and kept as often as they occur; a shorter text is one shingle. A bit is set if more
    than half of the XXH64 values (seed 42) have it. No words (null, empty, blank): zero.
    """
    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        values = np.array([_fingerprint(t, shingle) for t in text_bytes(batch["text"])], np.uint64)
        return {"doc_id": batch["doc_id"], "fingerprint": pa.array(values.view(np.int64))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "text"], run, f"doc_id {kind}, fingerprint long")


def _distance(values: np.ndarray, other: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ other)


@dataclass
class VantageTree:
    """Nodes in arrays: vantage point, radius, and children (a negative child is the leaf ``-1 - child``)."""

    points: np.ndarray
    radii: np.ndarray
    near: np.ndarray
    far: np.ndarray
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int) -> "VantageTree":
        """Median splits of a sample until there are about ``leaves`` parts or nothing can be split."""
        points, radii, near, far = [], [], [], []
        count = 0

        def grow(part: np.ndarray, wanted: int) -> int:
            nonlocal count
            split = _split(part) if wanted > 1 else None
            if split is None:
                count += 1
                return -count
            at = len(points)
            point, radius, inside = split
            points.append(point)
            radii.append(radius)
            near.append(0)
            far.append(0)
            near[at] = grow(part[inside], wanted // 2)
            far[at] = grow(part[~inside], wanted - wanted // 2)
            return at

        grow(sample, leaves)
        return cls(np.array(points, np.uint64), np.array(radii, np.int64), np.array(near, np.int64),
                   np.array(far, np.int64), count)

    def route(self, values: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, leaf, is_home): each value's home, and the leaves it must ask.

        For two values within ``reach`` at least one asks the home of the other: at a node that
        parts them, the one beyond the radius is at most ``reach`` beyond it, by the triangle bound.
        """
        found: list[tuple[np.ndarray, int, bool]] = []
        nothing = np.empty(0, np.int64)
        todo = [(0 if len(self.points) else -1, np.arange(len(values)), nothing)]
        while todo:
            node, home, asks = todo.pop()
            if not len(home) and not len(asks):
                continue
            if node < 0:
                found += [(home, -1 - node, True), (asks, -1 - node, False)]
                continue
            point, radius = self.points[node], self.radii[node]
            at_home = _distance(values[home], point).astype(np.int64)
            at_asks = _distance(values[asks], point).astype(np.int64)
            beyond = (at_home > radius) & (at_home <= radius + reach)
            todo.append((self.near[node], home[at_home <= radius],
                         np.concatenate([asks[at_asks <= radius + reach], home[beyond]])))
            todo.append((self.far[node], home[at_home > radius], asks[at_asks > radius - reach]))
        at = np.concatenate([f[0] for f in found]) if found else nothing
        leaf = np.concatenate([np.full(len(f[0]), f[1], np.int64) for f in found]) if found else nothing
        is_home = np.concatenate([np.full(len(f[0]), f[2]) for f in found]) if found else np.empty(0, bool)
        return at, leaf, is_home


def _split(part: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point (the value farthest from the first one), the median radius and who is inside."""
    if len(part) < 2:
        return None
    point = part[np.argmax(_distance(part, part[0]))]
    distance = _distance(part, point).astype(np.int64)
    radius = int(np.partition(distance, (len(part) - 1) // 2)[(len(part) - 1) // 2])
    inside = distance <= radius
    if inside.all():
        radius = int(distance.max()) - 1
        inside = distance <= radius
    return (point, radius, inside) if inside.any() and not inside.all() else None


class _Groups:
    """Group number of each value of a shard."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, one: int, others: np.ndarray) -> None:
        found = np.unique(self.of[others])
        mine = self.of[one]
        if len(found) == 1 and found[0] == mine:
            return
        least = min(mine, found[0])
        self.of[np.isin(self.of, np.append(found, mine))] = least


def _link(values: np.ndarray, home: np.ndarray, asks: np.ndarray, reach: int, groups: _Groups) -> None:
    """Join the groups of all pairs within reach, of which one at least is at home.

    Large parts are split like the tree as long as a split makes less work.
    """
    todo = [(home, asks)]
    while todo:
        home, asks = todo.pop()
        if not len(home):
            continue
        if len(home) > LEAF and (split := _split(values[home])) is not None:
            point, radius, inside = split
            at_home = _distance(values[home], point).astype(np.int64)
            at_asks = _distance(values[asks], point).astype(np.int64)
            beyond = (at_home > radius) & (at_home <= radius + reach)
            near = (home[inside], np.concatenate([asks[at_asks <= radius + reach], home[beyond]]))
            far = (home[~inside], asks[at_asks > radius - reach])
            work = sum(len(h) * (len(h) + len(a)) for h, a in (near, far))
            if work < 0.9 * len(home) * (len(home) + len(asks)):
                todo += [near, far]
                continue
        everyone = np.concatenate([home, asks])
        rows = max(1, BLOCK // len(home))
        for at in range(0, len(everyone), rows):
            block = everyone[at:at + rows]
            close = _distance(values[block][:, None], values[home][None, :]) <= reach
            hits = close.sum(axis=1)
            # A value at home always meets itself.
            alone = np.arange(at, at + len(block)) < len(home)
            for i in np.flatnonzero(hits > alone):
                groups.join(block[i], home[close[i]])


def links(distinct: DataFrame, reach: int = 2) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within ``reach`` bits do.

    ``distinct`` holds each fingerprint once. Each shard emits at most one edge for each value in
    it, to the least value of its group there, so a dense group makes no pairs.
    """
    n = distinct.count()
    # A bounded sample in hash order, to place the shards.
    share = min(1.0, 2 * TREE_SAMPLE / max(1, n))
    sample = distinct.where(F.pmod(F.xxhash64("fingerprint"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    taken = np.array([r[0] for r in sample.limit(TREE_SAMPLE).collect()], np.int64).view(np.uint64)
    tree = VantageTree.fit(np.sort(taken), max(1, min(len(taken) // 64, -(-n // LEAF))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            at, leaf, is_home = tree.route(values, reach)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(leaf), "fingerprint": pa.array(values[at].view(np.int64)),
                "is_home": pa.array(is_home),
            })

    def link(shard: pd.DataFrame) -> pd.DataFrame:
        values = shard["fingerprint"].to_numpy().view(np.uint64)
        is_home = shard["is_home"].to_numpy()
        groups = _Groups(len(values))
        _link(values, np.flatnonzero(is_home), np.flatnonzero(~is_home), reach, groups)
        members = pd.DataFrame({"a": values.view(np.int64), "g": groups.of})
        members["b"] = members.groupby("g")["a"].transform("min")
        return members.loc[members["a"] != members["b"], ["a", "b"]]

    routed = distinct.select("fingerprint").mapInArrow(route, "shard long, fingerprint long, is_home boolean")
    return routed.groupBy("shard").applyInPandas(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents linked at ``reach`` or fewer bits.

    component_id is the smallest doc_id reachable, the document itself included. Null ids never are
    the smallest unless all ids of a component are null. Repeated rows give repeated rows. Texts
    without words share fingerprint zero and are linked like any other. Other columns are not read.
    """
    prints = stored(fingerprints(docs, shingle))
    distinct = stored(prints.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least")
    ))
    edges = stored(links(distinct.select("fingerprint"), reach))
    roots = connected_components(edges)
    placed = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "n_docs", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = stored(placed.join(smallest, "root").select("fingerprint", "n_docs", "component_id"))
    return attach(prints, facts, ["fingerprint"], "n_docs").select("doc_id", "fingerprint", "component_id")


def one_of_each(docs: DataFrame, smallest_ids: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that stay: exactly one of each component.

    ``smallest_ids`` gives the smallest doc_id of each component of its rows (component_id). It gets the rank of
    each row as doc_id: rows with an id before others, the smallest id, then a hash of the text and a row key,
    so rows that share an id, or have none, are chosen from one by one. Of rows that repeat id and text one is kept.
    """
    row = [F.xxhash64(F.lit(i), "doc_id", "text") for i in range(2)]
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.xxhash64("text").alias("of_text"),
                    row[0].alias("row_a"), row[1].alias("row_b"))
    row_a, row_b, a, b = unused(docs, "__ra", "__rb", "__ka", "__kb")
    staying = smallest_ids(docs.select(rank.alias("doc_id"), "text")).select(
        F.col("component_id.row_a").alias(a), F.col("component_id.row_b").alias(b))
    keyed = docs.select("*", row[0].alias(row_a), row[1].alias(row_b))
    # A plain equality, so that the texts, once dealt by row key, are not dealt again for the repeated rows.
    met = (F.col(row_a) == F.col(a)) & (F.col(row_b) == F.col(b))
    return keyed.join(staying, met, "left_semi").dropDuplicates([row_a, row_b]).drop(row_a, row_b)


def keep_one(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, as ``one_of_each`` chooses it."""
    return one_of_each(docs, lambda rows: near_duplicates(rows, shingle, reach).select("component_id").distinct())
