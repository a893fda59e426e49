"""Regression trees grown leaf by leaf on a binned table: many trees, targets and candidates share each scan.

Rows are binned once and kept in blocks, a column after the other. Where only sums are asked for, rows that share all
bins are one cell with their number and the means of their labels, so scans grow with the cells. A scan sums labels and counts by (tree, leaf, feature, bin) inside the tasks; the sums are
merged by leaf, where its best cut is found. Only cuts and counts reach the driver, which decides what to split next:
always the leaf with the largest gain. Sums are never stored: a leaf of many labels has more numbers than its rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curveloom.session import stored

# Bins of a feature: a bin number is one byte.
MOST_BINS = 256
# A feature with up to so many values (as estimated) gets a cut between each two of them.
FEW_VALUES = 200
# Numbers in the sums of one scan of one task; more leaves wait for the next scan.
SCAN_NUMBERS = 16_000_000
# Rows that tasks work on together: one block of the stored table.
PIECE_ROWS = 32_768
# Rows a cell has at least on average where drawn rows are summed by cell, and how many times the bytes of the rows the sums may take.
CELL_ROWS = 4
CELL_SPACE = 4
# Cells up to which rows are grouped by the values of their features, if these are few, before they are binned.
VALUE_CELLS = 100_000
# Numbers of a block of such sums, and rows of a task that sums them.
BLOCK_NUMBERS = 2_000_000
CLUSTER_ROWS = 1_000_000
# Bytes of a row group of blocks, looked at after every block; files can be read by several tasks between them.
GROUPS = {"parquet.block.size": 16 * 2**20, "parquet.page.size.row.check.min": 1}
# Of fewer rows at a node, all nodes are walked down together.
FEW_ROWS = 64
# A cut must lower the mean squared error of its leaf by more than this share of one.
LEAST_GAIN = 1e-12

_SUMS = "tree int, node int, sums binary"
_SPLITS = "tree int, node int, n double, totals binary, feature int, bin int, gain double, n_left double"


@dataclass(frozen=True)
class Bins:
    """Ascending cuts of each feature; a value's bin is the number of cuts below it. ``few``: no feature has many values."""

    features: tuple[str, ...]
    cuts: tuple[np.ndarray, ...]
    few: bool = False

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], most: int = MOST_BINS) -> "Bins":
        """Cuts between the values of features with few, else at quantiles: three scans for all features.

        The quantiles come from a mergeable summary; its size does not grow with the rows.
        """
        counted = df.agg(*[F.approx_count_distinct(f).alias(str(i)) for i, f in enumerate(features)]).first()
        few = [i for i in range(len(features)) if (counted[str(i)] or 0) <= min(FEW_VALUES, most - 1)]
        many = [f for i, f in enumerate(features) if i not in few]
        quantiles = dict(zip(many, df.approxQuantile(many, [k / most for k in range(1, most)], 0.25 / most))) if many else {}
        values = df.agg(*[F.collect_set(F.col(features[i]).cast("double")).alias(str(i)) for i in few]).first() if few else {}
        cuts = []
        for i in range(len(features)):
            if i in few:
                own = np.unique(np.array(values[str(i)], dtype=float))
                own = own[np.isfinite(own)]
                cuts.append((own[1:] + own[:-1]) / 2)
            else:
                cuts.append(np.unique(np.array(quantiles[features[i]], dtype=float)))
        return cls(tuple(features), tuple(c[: most - 1] for c in cuts), not many)

    def of(self, values: np.ndarray) -> np.ndarray:
        """Bin numbers of a matrix of rows x features; a missing value is above all cuts."""
        return np.array([np.searchsorted(c, values[:, i], "left") for i, c in enumerate(self.cuts)], np.uint8).T


# Numbers of a block, each column after the other; rows of a block are all held back or none is.
_BLOCKS = {"key": np.int64, "n": float, "bins": np.uint8, "labels": float, "spread": float, "state": float}
_BLOCK_SCHEMA = "held boolean, size int, " + ", ".join(f"{c} binary" for c in _BLOCKS)


@dataclass
class Block:
    """Rows, or cells of rows that share their bins: ``n`` rows with the means ``labels`` and the squares ``spread`` around them.

    Cells of drawn rows have a column of ``n`` and columns of means for each tree, and no key: nothing is drawn again.
    """

    held: bool
    key: np.ndarray
    n: np.ndarray
    bins: np.ndarray
    labels: np.ndarray
    spread: np.ndarray
    state: np.ndarray


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        size = batch["size"][i].as_py()
        matrices = [np.frombuffer(batch[c][i].as_buffer(), kind).reshape(-1, size).T for c, kind in _BLOCKS.items()]
        yield Block(batch["held"][i].as_py(), *matrices)


def _block_row(held: bool, size: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A block from matrices of columns x rows; what is not given stays empty."""
    return pa.RecordBatch.from_pydict({
        "held": pa.array([held]), "size": pa.array([size], pa.int32()),
        **{c: pa.array([np.ascontiguousarray(columns[c], kind).tobytes() if c in columns else b""], pa.binary())
           for c, kind in _BLOCKS.items()}})


def _packed(codes: np.ndarray) -> pa.Array:
    """The bins of each row as one value."""
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())


def _unpacked(column: pa.Array, n_features: int) -> np.ndarray:
    fixed = column.cast(pa.binary(n_features))
    return np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * n_features:][:len(fixed) * n_features].reshape(-1, n_features)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _in_blocks(df: DataFrame, columns: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> DataFrame:
    """The rows of each task in stored blocks; ``columns`` gives the matrices (columns x rows) of a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bool, list[dict[str, np.ndarray]]] = {False: [], True: []}
        sizes = {False: 0, True: 0}

        def leave(held: bool) -> pa.RecordBatch:
            parts = waiting[held]
            row = _block_row(held, sizes[held], {c: np.concatenate([p[c] for p in parts], axis=1) for c in parts[0]})
            waiting[held], sizes[held] = [], 0
            return row

        for batch in batches:
            found, marks = columns(batch), batch["held"].to_numpy(zero_copy_only=False).astype(bool)
            for held in (False, True):
                own = np.flatnonzero(marks == held)
                if len(own):
                    waiting[held].append({c: v[:, own] for c, v in found.items()})
                    sizes[held] += len(own)
                if sizes[held] >= PIECE_ROWS:
                    yield leave(held)
        for held in (False, True):
            if sizes[held]:
                yield leave(held)

    return stored(df.mapInArrow(run, _BLOCK_SCHEMA), GROUPS)


def _numbers(df: DataFrame, bins: Bins, labels: Sequence[str], held: Column, *more: Column) -> DataFrame:
    numbers = [F.col(c).cast("double") for c in [*bins.features, *labels]]
    return df.select(*more, F.coalesce(held, F.lit(False)).alias("held"), F.array(*numbers).alias("v"))


def binned_rows(df: DataFrame, bins: Bins, labels: Sequence[str], key: Column, held: Column) -> DataFrame:
    """Stored blocks of rows: key, bins and labels, for trees that draw rows."""
    n = len(bins.features)

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        values = _matrix(batch["v"], batch.num_rows)
        return {"key": batch["key"].to_numpy(zero_copy_only=False)[None], "bins": bins.of(values[:, :n]).T, "labels": values[:, n:].T}

    return _in_blocks(_numbers(df, bins, labels, held, key.alias("key")), columns)


def binned_cells(df: DataFrame, bins: Bins, labels: Sequence[str], held: Column) -> DataFrame:
    """Stored blocks of cells: all that trees on every row, and their losses, are grown from.

    A tree sends the rows of a cell the same way, so their number, the means of their labels and the squares around
    these give the same sums as the rows one by one. Features of few values are grouped by them, and only the groups are
    binned; other rows are binned first.
    """
    n, k = len(bins.features), len(labels)
    few = bins.few and np.prod([len(c) + 1.0 for c in bins.cuts]) <= VALUE_CELLS

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch["v"], batch.num_rows)
            yield pa.RecordBatch.from_pydict({
                "held": batch["held"], "bins": _packed(bins.of(values[:, :n])), **{f"y{i}": pa.array(values[:, n + i]) for i in range(k)}})

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        if few:
            return bins.of(np.array([batch[f"x{i}"].to_numpy(zero_copy_only=False) for i in range(n)], float).T)
        return _unpacked(batch["bins"], n)

    def columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"n": batch["n"].to_numpy()[None], "bins": codes(batch).T, "labels": np.array([batch[f"m{i}"].to_numpy() for i in range(k)]),
                "spread": np.array([batch[f"s{i}"].to_numpy() for i in range(k)])}

    if few:
        by = [f"x{i}" for i in range(n)]
        coded = df.select(
            F.coalesce(held, F.lit(False)).alias("held"), *[F.col(f).cast("double").alias(x) for f, x in zip(bins.features, by)],
            *[F.col(c).cast("double").alias(f"y{i}") for i, c in enumerate(labels)])
    else:
        by = ["bins"]
        coded = _numbers(df, bins, labels, held).mapInArrow(
            code, "held boolean, bins binary, " + ", ".join(f"y{i} double" for i in range(k)))
    cells = coded.groupBy("held", *by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.avg(f"y{i}").alias(f"m{i}") for i in range(k)],
        *[(F.var_pop(f"y{i}") * F.count(f"y{i}")).alias(f"s{i}") for i in range(k)])
    return _in_blocks(cells, columns)


@dataclass(frozen=True)
class TreeSpec:
    """What a tree is grown for: columns of the residuals, limits, and how rows and features are drawn."""

    targets: tuple[int, ...]
    leaves: int
    min_leaf: int
    depth: int | None = None
    share: float = 1.0
    bootstrap: int | None = None
    seed: int = 42


def drawn_cells(rows: DataFrame, specs: Sequence[TreeSpec], n_features: int, n_labels: int) -> DataFrame:
    """Stored blocks of cells with the number of rows that each tree draws and the means of their labels.

    Every row is drawn once here instead of in every scan, and scans grow with the cells. Where cells hold few rows, so that
    their sums take more than the rows, the blocks of rows are given back as they are.
    """
    fitted = rows.where(~F.col("held"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in _blocks(batch)):
            yield pa.RecordBatch.from_pydict({"bins": _packed(block.bins)})

    kept = [F.col(c) if c in ("held", "size", "bins") else F.lit(b"").alias(c) for c in rows.columns]
    cells = fitted.select(*kept).mapInArrow(code, "bins binary").groupBy("bins").agg(F.count(F.lit(1)).alias("n"))
    found = cells.agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.max("n").alias("largest")).first()
    numbers = len(specs) * (1 + n_labels)
    space = found["cells"] * (n_features + 8 * numbers) / max(1, found["rows"] or 0) / (n_features + 8 * (1 + n_labels))
    if not found["cells"] or found["rows"] < CELL_ROWS * found["cells"] or space > CELL_SPACE:
        return rows

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (b for batch in batches for b in _blocks(batch)):
            yield pa.RecordBatch.from_pydict({
                "bins": _packed(block.bins), "key": pa.array(block.key[:, 0]),
                **{f"y{i}": pa.array(block.labels[:, i]) for i in range(n_labels)}})

    single = fitted.mapInArrow(unfold, "bins binary, key long, " + ", ".join(f"y{i} double" for i in range(n_labels)))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-found["rows"] // CLUSTER_ROWS))
    share = -(-found["rows"] // parts)
    if found["largest"] > share:
        # At most one cell a task is that large; its rows go to several tasks, whose sums add up.
        large = cells.where(F.col("n") > share).select("bins", F.ceil(F.col("n") / share).alias("pieces"))
        single = single.join(F.broadcast(large), "bins", "left").withColumn(
            "cell", F.xxhash64("bins", F.coalesce(F.pmod("key", "pieces"), F.lit(0))))
    else:
        single = single.withColumn("cell", F.xxhash64("bins"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        size = 0

        def leave() -> pa.RecordBatch:
            n, codes, labels = (np.concatenate(c, axis=-1) for c in zip(*waiting))
            return _block_row(False, size, {"n": n, "bins": codes, "labels": labels.reshape(-1, size)})

        for batch in (b for b in batches if b.num_rows):
            codes = _unpacked(batch["bins"], n_features)
            # Rows come in the order of their cells; a cell that goes on in the next batch is two cells with the same bins.
            first = np.append(0, 1 + np.flatnonzero((codes[1:] != codes[:-1]).any(axis=1)))
            key = batch["key"].to_numpy().view(np.uint64)
            weight = np.array([_draws(spec, key) for spec in specs])
            n = np.add.reduceat(weight, first, axis=1)
            sums = [np.add.reduceat(weight * batch[f"y{i}"].to_numpy(), first, axis=1) for i in range(n_labels)]
            waiting.append((n, codes[first].T, np.stack(sums, axis=1) / np.maximum(n, 1)[:, None]))
            size += len(first)
            if size >= min(PIECE_ROWS, max(1, BLOCK_NUMBERS // numbers)):
                yield leave()
                waiting, size = [], 0
        if size:
            yield leave()

    return stored(single.repartition(parts, "cell").sortWithinPartitions("cell").select(
        "bins", "key", *[f"y{i}" for i in range(n_labels)]).mapInArrow(add, _BLOCK_SCHEMA), GROUPS)


@dataclass
class Tree:
    """A grown tree in arrays: feature -1 is a leaf, rows with a bin up to ``bin`` go left."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    n: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        return walk(self.feature, self.bin, self.left, self.right, bins)


def walk(feature: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The leaf of each row, from the root down."""
    rows, nodes = _ends(feature, at, left, right, values, np.arange(len(values)))
    out = np.empty(len(values), np.int64)
    out[rows] = nodes
    return out


def _ends(
    feature: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, values: np.ndarray, rows: np.ndarray,
    asked: Sequence[int] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their leaves), of the rows that end in a leaf of ``asked`` if it is given.

    Many rows are parted node by node; what is left of few rows at a node goes down together, a level at a time.
    """
    wanted = np.full(len(feature), asked is None)
    if asked is not None:
        wanted[asked] = True
        # Children come after their parents.
        for node in np.flatnonzero(feature >= 0)[::-1]:
            wanted[node] |= wanted[left[node]] | wanted[right[node]]
    todo, ends, few = [(0, rows)], [], []
    while todo:
        node, mine = todo.pop()
        if not len(mine) or not wanted[node]:
            continue
        if feature[node] < 0 or len(mine) < FEW_ROWS:
            (ends if feature[node] < 0 else few).append((mine, np.full(len(mine), node)))
            continue
        goes_left = values[:, feature[node]][mine] <= at[node]
        todo += [(left[node], mine[goes_left]), (right[node], mine[~goes_left])]
    if few:
        mine, node = (np.concatenate(p) for p in zip(*few))
        open_rows = np.arange(len(mine))
        while len(open_rows):
            now = node[open_rows]
            goes_left = values[mine[open_rows], feature[now]] <= at[now]
            node[open_rows] = np.where(goes_left, left[now], right[now])
            open_rows = open_rows[feature[node[open_rows]] >= 0]
        kept = wanted[node]
        ends.append((mine[kept], node[kept]))
    if not ends:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found, nodes = (np.concatenate(p) for p in zip(*ends))
    return found, nodes


@dataclass
class _Growing:
    """A tree being grown: all nodes looked at so far, split or not."""

    spec: TreeSpec
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    #: node -> (rows, sums, best feature, best bin, gain, rows on the left)
    known: dict[int, tuple] = field(default_factory=dict)

    def may_split(self, node: int) -> bool:
        n, _, feature, _, gain, _ = self.known[node]
        deep = self.spec.depth is not None and self.depth[node] >= self.spec.depth
        return feature >= 0 and not deep and n >= 2 * self.spec.min_leaf and gain > LEAST_GAIN * n

    def plan(self) -> tuple[list[int], list[int]]:
        """(splits, of these the ones whose children are not known yet), by largest gain first."""
        splits, waiting = [], []
        heap = [(-self.known[0][4], 0)] if 0 in self.known and self.may_split(0) else []
        while heap and len(splits) < self.spec.leaves - 1:
            _, node = heapq.heappop(heap)
            splits.append(node)
            if self.left[node] in self.known:
                for child in (self.left[node], self.right[node]):
                    if self.may_split(child):
                        heapq.heappush(heap, (-self.known[child][4], child))
            else:
                waiting.append(node)
        return splits, waiting

    def open(self, node: int) -> None:
        """Give a node its children, to be looked at in the next scan."""
        if self.left[node] >= 0:
            return
        _, _, self.feature[node], self.bin[node], _, _ = self.known[node]
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.depth.append(self.depth[node] + 1)

    def finished(self) -> Tree:
        """Only the nodes that are split, and their children."""
        splits = set(self.plan()[0])
        order = [0]
        for node in order:
            if node in splits:
                order += [self.left[node], self.right[node]]
        place = {node: i for i, node in enumerate(order)}
        inner = [node in splits for node in order]
        return Tree(
            np.array([self.feature[n] if s else -1 for n, s in zip(order, inner)], np.int64),
            np.array([self.bin[n] if s else 0 for n, s in zip(order, inner)], np.int64),
            np.array([place[self.left[n]] if s else -1 for n, s in zip(order, inner)], np.int64),
            np.array([place[self.right[n]] if s else -1 for n, s in zip(order, inner)], np.int64),
            np.array([self.known[n][1] / max(self.known[n][0], 1e-300) for n in order]).reshape(len(order), -1),
            np.array([self.known[n][0] for n in order]))


#: Distribution function of the number of times a row is drawn (Poisson with mean one).
_DRAWN = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1, *range(1, 12)])])


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """Uniform draws in [0, 1) from keys and a seed."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / 2**53


def _draws(spec: TreeSpec, key: np.ndarray) -> np.ndarray:
    """How often a tree draws each row."""
    if spec.bootstrap is None:
        return np.ones(len(key))
    drawn, at = np.zeros(len(key), np.uint8), _mixed(key, spec.bootstrap)
    for least in _DRAWN:
        drawn += at > least
    return drawn.astype(float)


def _leaf_sums(codes: np.ndarray, rows: np.ndarray, slot: np.ndarray, slots: int, weight: np.ndarray, labels: Sequence[np.ndarray],
               n_bins: int) -> np.ndarray:
    """(slot, feature, bin, 1 + labels): counts and sums of the labels of ``rows``."""
    out = np.empty((slots, codes.shape[1], n_bins, 1 + len(labels)))
    weighted = [weight[rows]]
    weighted += [y[rows] * weighted[0] for y in labels]
    first = slot * n_bins
    for k in range(codes.shape[1]):
        cell = first + codes[:, k][rows]
        for t, values in enumerate(weighted):
            out[:, k, :, t] = np.bincount(cell, values, slots * n_bins).reshape(slots, n_bins)
    return out


def best_cut(sums: np.ndarray, min_leaf: int, allowed: np.ndarray) -> tuple[int, int, float, float]:
    """(feature, bin, gain, rows on the left) of the cut that lowers the squared error most, over all labels.

    ``sums`` is (feature, bin, 1 + labels). Of equal gains the first feature and the lowest bin win; feature -1: none.
    """
    total = sums[0].sum(axis=0)
    left = np.cumsum(sums, axis=1)[:, :-1]
    n, rest = left[..., 0], total[0] - left[..., 0]
    fits = (n >= min_leaf) & (rest >= min_leaf) & allowed[:, None]
    if not fits.any():
        return -1, 0, 0.0, 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 1:] ** 2).sum(axis=-1) / n + ((total[1:] - left[..., 1:]) ** 2).sum(axis=-1) / rest
    gain = np.where(fits, gain - (total[1:] ** 2).sum() / total[0], -np.inf)
    k, b = np.unravel_index(np.argmax(gain), gain.shape)
    return int(k), int(b), float(gain[k, b]), float(n[k, b])


@dataclass
class Residuals:
    """Labels a tree sees: label ``of`` minus what the trees of a model say so far (``models`` is None for plain labels).

    ``base`` is the constant each model starts with, ``trees`` holds its trees since the state in the rows was stored.
    """

    of: np.ndarray
    base: np.ndarray
    trees: list[list[Tree]]
    rate: np.ndarray

    def apply(self, block: Block) -> np.ndarray:
        return block.labels[:, self.of] - self.predictions(block)

    def predictions(self, block: Block) -> np.ndarray:
        """(row, model), column after column as in the block; without a stored state all start at the base."""
        out = np.zeros((len(self.base), len(block.bins))).T + self.base
        if block.state.size:
            out += block.state
        for m, trees in enumerate(self.trees):
            for tree in trees:
                out[:, m] += (self.rate[m] * tree.value[:, 0])[tree.leaf(block.bins)]
        return out


def with_state(rows: DataFrame, residuals: Residuals) -> DataFrame:
    """The blocks with the predictions so far, stored: trees in ``residuals`` are walked for the last time."""
    shared = rows.sparkSession.sparkContext.broadcast(residuals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_blocks(batch)):
                now = np.ascontiguousarray(shared.value.predictions(block).T)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, 1).columns[:-1], pa.array([now.tobytes()], pa.binary())], names=batch.schema.names)

    return stored(rows.mapInArrow(run, _BLOCK_SCHEMA), GROUPS)


def _scan(rows: DataFrame, trees: dict[int, _Growing], asked: dict[int, list[int]], residuals: Residuals | None,
          n_bins: int, losses: bool) -> DataFrame:
    """The best cut of each node that ``asked`` names, by tree; and the losses so far as tree -1."""
    context = rows.sparkSession.sparkContext
    shared = context.broadcast({
        j: (t.spec, *map(np.array, (t.feature, t.bin, t.left, t.right)), asked[j]) for j, t in trees.items() if asked[j]})
    extra = context.broadcast(residuals)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        loss = None
        for block in (b for batch in batches for b in _blocks(batch)):
            seen = extra.value.apply(block) if extra.value else block.labels
            once = block.n[:, 0] if block.n.size else np.ones(len(seen))
            if losses:
                squares = once @ seen ** 2
                if block.spread.size:
                    squares += block.spread.sum(axis=0)[extra.value.of]
                own = np.zeros((2, 1 + seen.shape[1]))
                own[int(block.held)] = [once.sum(), *squares]
                loss = own if loss is None else loss + own
            if block.held:
                continue
            every = np.arange(len(seen))
            for j, (spec, feature, at, left, right, nodes) in shared.value.items():
                rows, weight, first = every, once, 0
                if block.n.shape[1] > 1:
                    weight, first = block.n[:, j], j * (seen.shape[1] // block.n.shape[1])
                elif block.key.size:
                    weight = _draws(spec, block.key[:, 0].view(np.uint64))
                if spec.bootstrap is not None:
                    rows = np.flatnonzero(weight)
                rows, ends = _ends(feature, at, left, right, block.bins, rows, nodes)
                slot_of = np.full(len(feature), -1, np.int64)
                slot_of[nodes] = np.arange(len(nodes))
                found = _leaf_sums(
                    block.bins, rows, slot_of[ends], len(nodes), weight, [seen[:, first + t] for t in spec.targets], n_bins)
                if j in sums:
                    sums[j] += found
                else:
                    sums[j] = found
        if loss is not None:
            yield _sum_rows([(-1, -1, loss)])
        for j, found in sums.items():
            yield _sum_rows([(j, p, s) for p, s in zip(shared.value[j][-1], found)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for tree, node, data in zip(*(batch[c].to_pylist() for c in ("tree", "node", "sums"))):
                values = np.frombuffer(data)
                found[tree, node] = found[tree, node] + values if (tree, node) in found else values
        out = []
        for (j, node), values in found.items():
            if j < 0:
                out.append((-1, -1, 0.0, values.tobytes(), -1, 0, 0.0, 0.0))
                continue
            spec = shared.value[j][0]
            sums = values.reshape(-1, n_bins, 1 + len(spec.targets))
            draw = _mixed(np.arange(len(sums)) + node * 100_003 + (spec.bootstrap or 0) * 7919, spec.seed + 1)
            allowed = np.argsort(np.argsort(draw)) < max(1, round(spec.share * len(sums)))
            total = sums[0].sum(axis=0)
            out.append((j, node, float(total[0]), total[1:].tobytes(), *best_cut(sums, spec.min_leaf, allowed)))
        if out:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            names = ("tree", "node", "n", "totals", "feature", "bin", "gain", "n_left")
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, zip(*out), kinds)})

    n_asked = sum(map(len, asked.values())) + losses
    return rows.mapInArrow(count, _SUMS).repartition(
        min(n_asked, context.defaultParallelism), "tree", "node").mapInArrow(merge, _SPLITS)


def _sum_rows(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    trees, nodes, sums = zip(*rows)
    return pa.RecordBatch.from_pydict({
        "tree": pa.array(trees, pa.int32()), "node": pa.array(nodes, pa.int32()),
        "sums": pa.array([np.ascontiguousarray(s).tobytes() for s in sums], pa.binary())})


def grow(
    rows: DataFrame, specs: Sequence[TreeSpec], n_features: int, n_bins: int = MOST_BINS,
    residuals: Residuals | None = None,
) -> tuple[list[Tree], np.ndarray | None]:
    """All trees of ``specs`` at once, and the losses before them (held or not x rows and squared errors).

    Each scan looks at the children of every leaf that would be split as far as is known, so a tree needs about as
    many scans as it is deep, and all trees share them. Leaves that others overtake later stay unsplit.
    """
    trees = [_Growing(s) for s in specs]
    size, loss = n_features * n_bins, None
    queue = {j: [0] for j in range(len(trees))}
    while any(queue.values()):
        # As many leaves as the memory of a task holds; the others wait.
        now, room = {}, SCAN_NUMBERS
        for j, nodes in queue.items():
            cost = size * (1 + len(specs[j].targets))
            now[j] = nodes[:max(2 if room == SCAN_NUMBERS else 0, room // cost // 2 * 2)]
            room -= cost * len(now[j])
        first = residuals is not None and loss is None
        for r in _scan(rows, dict(enumerate(trees)), now, residuals, n_bins, first).collect():
            if r["tree"] < 0:
                loss = np.frombuffer(r["totals"]).reshape(2, -1)
            else:
                trees[r["tree"]].known[r["node"]] = (
                    r["n"], np.frombuffer(r["totals"]), r["feature"], r["bin"], r["gain"], r["n_left"])
        for j, tree in enumerate(trees):
            # A node without rows, as of an empty table, has nothing to split.
            for node in now[j]:
                tree.known.setdefault(node, (0.0, np.zeros(len(specs[j].targets)), -1, 0, 0.0, 0.0))
            queue[j] = [] if 0 in tree.known else [0]
            for node in tree.plan()[1]:
                tree.open(node)
                queue[j] += [tree.left[node], tree.right[node]]
    if residuals is not None and loss is None:
        loss = np.zeros((2, 1 + len(residuals.of)))
    return [t.finished() for t in trees], loss
