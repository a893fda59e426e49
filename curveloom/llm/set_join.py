"""Exact Jaccard join of n-gram sets by a token-group matrix: similar texts form groups, only groups whose token
union can hold enough of a text's n-grams are opened."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curveloom.llm.common import attach, map_batches, stored, text_bytes
from curveloom.llm.components import connected_components

#: Buckets of the table of token frequencies, by the leading bits of a token; it is of this size for any input.
BUCKET_BITS = 20
#: Bits of the filter of rows whose sets are wanted (a row that passes by chance only costs time).
FILTER_BITS = 26
#: Tokens of the members of a group that meet in one task; a larger group is cut into blocks.
BLOCK_TOKENS = 1 << 20
#: Prefix tokens in a part of the token-group matrix.
PART_TOKENS = 1 << 20
#: Cells of the matrix that are looked up at once.
ASKED = 1 << 20
#: Numbers in a row of a table that tasks hand on in pieces.
PIECE = 4096

_record = np.dtype([("token", "<u8"), ("nid", "<i8"), ("home", "<i8"), ("n", "<i4"), ("hot", "?")])


#: Base of the polynomial hash of a word's bytes; odd, so its powers can be divided by.
_BASE = 0x9E3779B97F4A7C15
#: Bytes of a text that are hashed together.
SECTION = 1 << 16
_is_blank = np.zeros(256, bool)
_is_blank[list(b" \t\n\x0b\x0c\r")] = True


def _powers(base: int, n: int) -> np.ndarray:
    values = np.full(n, base, np.uint64)
    values[:1] = 1
    return np.multiply.accumulate(values)


_up, _down = _powers(_BASE, SECTION), _powers(pow(_BASE, -1, 1 << 64), SECTION)


def _word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: differences of running sums of the bytes times powers of a base."""
    values = np.frombuffer(data, np.uint8)
    edge = np.diff(_is_blank[values].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = (_up, _down) if len(values) <= SECTION else (
        _powers(_BASE, len(values)), _powers(pow(_BASE, -1, 1 << 64), len(values)))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * up[:len(values)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return found ^ (found >> np.uint64(29))


def _sections(data: bytes) -> Iterator[bytes]:
    """Parts of a text, cut at blanks; a part is longer than a section only if it starts with a word that is."""
    while len(data) > SECTION:
        cut = max(data.rfind(blank, 0, SECTION) for blank in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r"))
        if cut < 0:
            later = [at for blank in (b" ", b"\n", b"\t", b"\x0b", b"\x0c", b"\r") if (at := data.find(blank, SECTION)) >= 0]
            cut = min(later, default=len(data) - 1)
        yield data[:cut + 1]
        data = data[cut + 1:]
    yield data


def token_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit tokens of the word n-grams; fewer words are one n-gram, no words none.

    A-Z are lower-cased and words are ``[^\\x20\\x09-\\x0D]+``.
    """
    of_words = [_word_hashes(s) for s in _sections((text or b"").lower())]
    of_words = of_words[0] if len(of_words) == 1 else np.concatenate(of_words)
    if not len(of_words):
        return of_words
    width = min(n, len(of_words))
    count = len(of_words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ of_words[i:i + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _needed(n: int, percent: int) -> int:
    """Tokens that two sets must share, if the larger one has n."""
    return -(-percent * n // 100)


def _slack(n: int) -> int:
    """Tokens of a prefix beyond what would make two linked sets share one: linked sets share so many of them."""
    return 1 + n // 20


def _ordered(tokens: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(prefix in the order of all tokens, levels of it, home token) of a set.

    Tokens are ordered by the level of their frequency, rare ones first, then by value. With o(n) tokens needed
    and s(n) of slack, a prefix has n - o(n) + s(n) tokens, so the prefixes of linked sets share s of the smaller size
    at least. The home is of the most frequent kind of token in the prefix the one of the least value: copies
    and near copies mostly have the same, and texts that only share a passage do not.
    """
    level = levels[(tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    spare = len(tokens) - _needed(len(tokens), percent) + 1
    prefix = order[: min(len(tokens), spare - 1 + _slack(len(tokens)))]
    of_prefix = level[prefix]
    home = tokens[prefix[np.argmax(of_prefix == of_prefix.max())]]
    return tokens[prefix], of_prefix, int(home.view(np.int64))


def _rows(df: DataFrame, columns: Iterable[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]],
          schema: str) -> DataFrame:
    """``run`` over the Arrow batches of a partition; it yields columns by name."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns_ in run(batches):
            yield pa.RecordBatch.from_pydict(columns_)

    return df.select(*columns).mapInArrow(over, schema)


def _pieces(values: np.ndarray) -> dict[str, pa.Array]:
    """A task's table as rows of ``PIECE`` numbers, without those that are all zero."""
    table = values.reshape(-1, PIECE)
    some = np.flatnonzero(table.any(axis=1))
    return {"piece": pa.array(some, pa.int32()), "data": pa.array([table[i].tobytes() for i in some], pa.binary())}


def _merged(pieces: DataFrame, kind: str, into: np.ufunc, finish: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The tables of all tasks merged piece by piece: as many rows as a table has pieces, however many tasks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch["piece"].to_pylist(), batch["data"].to_pylist()):
                values = np.frombuffer(data, kind).astype(np.int64 if into is np.add else kind)
                found[piece] = into(found[piece], values) if piece in found else values
        yield {"piece": pa.array(list(found), pa.int32()),
               "data": pa.array([finish(v).tobytes() for v in found.values()], pa.binary())}

    return _rows(pieces.repartition("piece"), ["piece", "data"], run, "piece int, data binary")


def _table(merged: DataFrame, size: int, kind: str) -> np.ndarray:
    values = np.zeros((size // PIECE, PIECE), kind)
    for row in merged.collect():
        values[row["piece"]] = np.frombuffer(row["data"], kind)
    return values.reshape(-1)


def token_levels(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(level of each bucket of tokens, number of tokens of all texts).

    Level 0 holds tokens that stand out from the mean bucket by less than twice; each doubling is a level more.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts, total = np.zeros(1 << BUCKET_BITS, np.uint32), 0
        for batch in batches:
            for text in text_bytes(batch["text"]):
                tokens = token_set(text, n)
                total += len(tokens)
                np.add.at(counts, (tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), 1)
        found = _pieces(counts)
        yield found | {"total": pa.array([0] * len(found["piece"]), pa.int64())}
        yield {"piece": pa.array([None], pa.int32()), "data": pa.array([None], pa.binary()),
               "total": pa.array([total], pa.int64())}

    counted = stored(_rows(docs, ["text"], count, "piece int, data binary, total long"))
    total = counted.agg(F.sum("total")).first()[0] or 0
    usual = 2 * (total >> BUCKET_BITS) + 16
    merged = _merged(counted.where("piece is not null").select("piece", "data"), "<u4", np.add,
                     lambda v: np.frexp(v // usual)[1].astype(np.uint8))
    return _table(merged, 1 << BUCKET_BITS, "u1"), total


def _documents(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, row key, size n, node (digest of the set; null for none), its short form nid, its home and the number of
    frequent tokens in its prefix (hot) of each text."""
    table = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        nodes, nids, homes, sizes, hots = [], [], [], [], []
        for text in text_bytes(batch["text"]):
            tokens = token_set(text, n)
            node = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
            nodes.append(node)
            nids.append(int.from_bytes(node[:8], "little", signed=True) if node else None)
            _, level, home = _ordered(tokens, table.value, percent) if node else (None, np.empty(0), None)
            homes.append(home)
            hots.append(int((level > 0).sum()))
            sizes.append(len(tokens))
        return {"doc_id": batch["doc_id"], "row_a": batch["row_a"], "node": pa.array(nodes, pa.binary()),
                "nid": pa.array(nids, pa.int64()), "home": pa.array(homes, pa.int64()), "n": pa.array(sizes, pa.int64()),
                "hot": pa.array(hots, pa.int64())}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs, ["doc_id", "row_a", "text"], run,
                       f"doc_id {kind}, row_a long, node binary, nid long, home long, n long, hot long")


def _dealt(key: np.ndarray, rows: np.ndarray, parts: int) -> dict[str, pa.Array]:
    """Records as rows (part, data), by the low bits of their keys."""
    part = (((key & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return {"part": pa.array(part[first], pa.int64()),
            "data": pa.array([r.tobytes() for r in np.split(rows, first[1:])], pa.binary())}


def _each_part(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[np.ndarray]:
    """The records of each part, of sorted rows."""
    now, waiting = None, []
    for batch in batches:
        for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist()):
            if part != now and waiting:
                yield np.concatenate(waiting)
                waiting = []
            now = part
            waiting.append(np.frombuffer(data, kind))
    if waiting:
        yield np.concatenate(waiting)


def _nid(tokens: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_128_digest(tokens.tobytes())[:8], "little", signed=True)


def _shared(docs: DataFrame, n: int, percent: int, levels: np.ndarray, total: int) -> DataFrame:
    """(nid, shared): prefix tokens that do not stand out and that another set has in its prefix.

    This is what any one set can have in common with it at most, without the frequent tokens.
    """
    table, parts = docs.sparkSession.sparkContext.broadcast(levels), total // (15 * PART_TOKENS) + 1
    kind = np.dtype([("token", "<u8"), ("nid", "<i8")])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = []
            for text in text_bytes(batch["text"]):
                tokens = token_set(text, n)
                if len(tokens):
                    prefix, level, _ = _ordered(tokens, table.value, percent)
                    rows = np.empty(int((level == 0).sum()), kind)
                    rows["token"], rows["nid"] = prefix[level == 0], _nid(tokens)
                    found.append(rows)
            if found and sum(map(len, found)):
                rows = np.concatenate(found)
                yield _dealt(rows["token"], rows, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in _each_part(batches, kind):
            rows = rows[np.lexsort((rows["nid"], rows["token"]))]
            same = rows["token"][1:] == rows["token"][:-1]
            rows = rows[np.concatenate([[True], ~same | (rows["nid"][1:] != rows["nid"][:-1])])]
            same = rows["token"][1:] == rows["token"][:-1]
            met = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            nids, counts = np.unique(rows["nid"][met], return_counts=True)
            yield {"nid": pa.array(nids, pa.int64()), "shared": pa.array(counts, pa.int64())}

    dealt = _rows(docs, ["text"], split, "part long, data binary").repartition(parts, "part").sortWithinPartitions("part")
    return _rows(dealt, ["part", "data"], meet, "nid long, shared long").groupBy("nid").agg(F.sum("shared").alias("shared"))


def _asks(docs: DataFrame, n: int, percent: int, levels: np.ndarray, passing: np.ndarray, total: int) -> DataFrame:
    """(nid, group): sets and other groups with a smaller home, whose prefix tokens they share enough of.

    The token-group matrix has a row (token, group) for each prefix token of a group's members; only rows of ``docs`` that
    pass the filter take part. Tokens that do not stand out are dealt by value, so a list of one of them is bounded by
    the level; frequent ones are dealt by text, and only their distinct (token, group) rows are joined.
    """
    spark = docs.sparkSession
    table, parts = spark.sparkContext.broadcast(levels), total // (5 * PART_TOKENS) + 1
    bits = spark.sparkContext.broadcast(passing)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found = []
            for text in text_bytes(batch["text"].take(pa.array(_passing(batch, bits.value)))):
                tokens = token_set(text, n)
                if len(tokens):
                    prefix, level, home = _ordered(tokens, table.value, percent)
                    rows = np.empty(len(prefix), _record)
                    rows["token"], rows["hot"], rows["home"], rows["n"] = prefix, level > 0, home, len(tokens)
                    rows["nid"] = _nid(tokens)
                    found.append(rows)
            if found:
                rows = np.concatenate(found)
                yield _dealt(np.where(rows["hot"], rows["nid"].view("<u8"), rows["token"]), rows, parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for rows in _each_part(batches, _record):
            yield from _met(rows)

    dealt = _rows(docs, ["row_a", "text"], split, "part long, data binary").repartition(
        parts, "part").sortWithinPartitions("part")
    found = stored(_rows(dealt, ["part", "data"], meet, "token long, nid long, home long, n int, matches long"))
    hot = stored(found.where("token is not null").select("token", "nid", "home", "n").distinct())
    weights = hot.groupBy("token").agg(F.count(F.lit(1)).alias("weight"), F.min("home").alias("x"), F.max("home").alias("y"))
    matrix = stored(hot.select("token", F.col("home").alias("group")).distinct().join(
        weights.where("x <> y").select("token", "weight"), "token"))
    of_hot = attach(hot, matrix, ["token"], "weight").where("group < home").select(
        "nid", "group", "n", F.lit(1).cast("long").alias("matches"))
    asks = found.where("token is null").select("nid", F.col("home").alias("group"), "n", "matches").unionByName(of_hot)
    # A set of n can be linked with none that is smaller than what it needs.
    least = F.ceil(F.col("n") * percent / 100)
    return asks.groupBy("nid", "group", "n").agg(F.sum("matches").alias("matches")).where(
        F.col("matches") >= 1 + F.floor(least / 20)).select("nid", "group").distinct()


def _met(rows: np.ndarray) -> Iterator[dict]:
    """Of a part: rows of frequent tokens as they are, and how often sets and groups meet in the others."""
    hot, rows = rows[rows["hot"]], rows[~rows["hot"]]
    if len(hot):
        yield {"token": pa.array(hot["token"].view("<i8")), "nid": pa.array(hot["nid"]), "home": pa.array(hot["home"]),
               "n": pa.array(hot["n"]), "matches": pa.nulls(len(hot), pa.int64())}
    if not len(rows):
        return
    order = np.lexsort((rows["nid"], rows["home"], rows["token"]))
    token, home, nids, sizes = (rows[c][order] for c in ("token", "home", "nid", "n"))
    del rows, order
    new_token = np.concatenate([[True], token[1:] != token[:-1]])
    new_cell = new_token | np.concatenate([[True], home[1:] != home[:-1]])
    new_row = new_cell | np.concatenate([[True], nids[1:] != nids[:-1]])
    # Cells (token, group) of the matrix; a row asks the cells of its token before its own.
    cell = np.cumsum(new_cell) - 1
    first_cell = cell[new_token][np.cumsum(new_token) - 1]
    groups = home[new_cell]
    asked = np.where(new_row, cell - first_cell, 0)
    del token, home, new_token, new_cell, new_row, cell
    # Stretches of rows that ask ``ASKED`` cells or little more; their counts are merged, so only one of them is held.
    ends = np.searchsorted(np.cumsum(asked), np.arange(ASKED, asked.sum() + ASKED, ASKED)) + 1
    held = tuple(np.empty(0, t) for t in ("i8", "i8", "i4", "i8"))
    for start, end in zip(np.concatenate([[0], ends]), ends):
        many, base = asked[start:end], first_cell[start:end]
        at = np.repeat(base - (np.cumsum(many) - many), many) + np.arange(many.sum())
        more = np.repeat(nids[start:end], many), groups[at], np.repeat(sizes[start:end], many), np.ones(len(at), "i8")
        nid, group, n, matches = (np.concatenate(both) for both in zip(held, more))
        order = np.lexsort((group, nid))
        nid, group, n, matches = nid[order], group[order], n[order], matches[order]
        first = np.flatnonzero(np.concatenate([[True], (nid[1:] != nid[:-1]) | (group[1:] != group[:-1])])[:len(nid)])
        held = nid[first], group[first], n[first], np.add.reduceat(matches, first) if len(first) else matches
    nid, group, n, matches = held
    yield {"token": pa.nulls(len(nid), pa.int64()), "nid": pa.array(nid), "home": pa.array(group), "n": pa.array(n),
           "matches": pa.array(matches)}


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of two bits for each ``row_a``, of a fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            for at in _places(batch["row_a"].to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield _pieces(bits)

    pieces = _rows(keys, ["row_a"], run, "piece int, data binary")
    return _table(_merged(pieces, "u1", np.bitwise_or, lambda v: v), 1 << FILTER_BITS - 3, "u1")


def _places(keys: np.ndarray) -> list[np.ndarray]:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [(mixed >> np.uint64(64 - FILTER_BITS)).astype(np.int64),
            ((mixed >> np.uint64(6)) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]


def _passing(batch: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    """The rows of a batch that pass a filter."""
    places = _places(batch["row_a"].to_numpy(zero_copy_only=False))
    return np.flatnonzero(np.logical_and(*[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 for at in places]))


def _sets(docs: DataFrame, n: int, wanted: np.ndarray) -> DataFrame:
    """(nid, node, tokens): sets of the rows that pass the filter, each node once."""
    bits = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen: set[bytes] = set()
        for batch in batches:
            passing = _passing(batch, bits.value)
            for start in range(0, len(passing), 256):
                nodes, sets = [], []
                for text in text_bytes(batch["text"].take(pa.array(passing[start:start + 256]))):
                    tokens = token_set(text, n)
                    node = xxhash.xxh3_128_digest(tokens.tobytes())
                    if len(tokens) and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        sets.append(tokens.tobytes())
                nids = [int.from_bytes(x[:8], "little", signed=True) for x in nodes]
                yield {"nid": pa.array(nids, pa.int64()), "node": pa.array(nodes, pa.binary()),
                       "tokens": pa.array(sets, pa.binary())}

    return _rows(docs, ["row_a", "text"], run, "nid long, node binary, tokens binary").dropDuplicates(["nid", "node"])


class _Block:
    """Members of a block of a group, with the union of their tokens and who has each."""

    def __init__(self, members: list[tuple[bytes, int, np.ndarray]], percent: int) -> None:
        self.percent = percent
        self.nodes = [m[0] for m in members]
        self.copies = np.array([m[1] for m in members], np.int64)
        self.sets = [m[2] for m in members]
        self.sizes = np.array(list(map(len, self.sets)), np.int64)
        tokens, owners = np.concatenate(self.sets), np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owners[order].astype(np.int32)
        self.union, self.first, self.count = np.unique(tokens[order], return_index=True, return_counts=True)
        self.of = np.arange(len(members))
        self.links = np.zeros(len(members), np.int64)

    def linked(self, tokens: np.ndarray) -> np.ndarray:
        """Members that a set is linked with; nobody is looked at if the union holds too few of its tokens."""
        place = np.searchsorted(self.union, tokens)
        place[place == len(self.union)] = 0
        place = place[self.union[place] == tokens]
        if 100 * len(place) < self.percent * len(tokens):
            return np.empty(0, np.int64)
        counts = self.count[place]
        at = np.repeat(self.first[place] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * shared >= self.percent * (len(tokens) + self.sizes - shared))

    def join(self) -> None:
        """Link the members with each other."""
        for i, tokens in enumerate(self.sets if len(self.sets) > 1 else []):
            near = self.linked(tokens)
            self.links[i] += self.copies[near].sum() - self.copies[i]
            groups = np.unique(self.of[near])
            if len(groups) > 1:
                self.of[np.isin(self.of, groups)] = groups[0]

    def ask(self, node: bytes, copies: int, tokens: np.ndarray) -> Iterator[tuple[bytes, bytes, int]]:
        """(node, a member, links): one row for each component of members that the set is linked with."""
        near = self.linked(tokens)
        near = near[[self.nodes[i] != node for i in near]]
        if len(near):
            self.links[near] += copies
            total = int(self.copies[near].sum())
            for i, group in enumerate(np.unique(self.of[near])):
                yield node, self.nodes[group], 0 if i else total

    def result(self) -> Iterator[tuple[bytes, bytes, int]]:
        for i, node in enumerate(self.nodes):
            if self.links[i] or self.of[i] != i:
                yield node, self.nodes[self.of[i]], int(self.links[i])


def _linked(shipped: DataFrame, percent: int) -> DataFrame:
    """(node, other, links) of all blocks: every member and asking set at most once for each component it meets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, members, block, found = None, [], None, []

        def columns() -> dict:
            a, b, n = zip(*found) if found else ((), (), ())
            found.clear()
            return {"node": pa.array(a, pa.binary()), "other": pa.array(b, pa.binary()), "links": pa.array(n, pa.int64())}

        def close() -> None:
            nonlocal block, members
            if members:
                block, members = _Block(members, percent), []
                block.join()

        for batch in batches:
            for row in zip(*[batch[c] for c in ("group", "block", "is_member", "node", "n_docs", "tokens")]):
                group, number, is_member, node, copies, tokens = (v.as_py() for v in row)
                tokens = np.frombuffer(tokens, np.uint64)
                if (group, number) != now:
                    close()
                    found += block.result() if block else ()
                    now, block = (group, number), None
                if is_member:
                    members.append((node, copies, tokens))
                else:
                    close()
                    found += block.ask(node, copies, tokens) if block else ()
                if len(found) >= 10_000:
                    yield columns()
        close()
        found += block.result() if block else ()
        yield columns()

    dealt = shipped.repartition("group", "block").sortWithinPartitions("group", "block", F.desc("is_member"), "node")
    return _rows(dealt, ["group", "block", "is_member", "node", "n_docs", "tokens"], run,
                 "node binary, other binary, links long")


def similar_sets(docs: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Two documents are linked if 100 * shared n-grams >= ``percent`` * n-grams of both, on the sets of whole texts;
    fewer words than ``shingle`` are one n-gram. component_id is the smallest doc_id reachable by links, itself
    included, n_links the number of other documents linked. Documents without words (null, empty, blank)
    are linked with nothing. A null id is never the smallest unless all ids of a component are null; repeated
    rows are documents of their own with the same values. An empty table gives no rows; other columns are not read.

    Equal sets are one node. Nodes that share too few tokens of their prefixes with any others are left alone. A node's group is its home token; a group's members are linked inside one task, in blocks of a
    bounded number of tokens, where each emits one edge at most, and nodes with enough prefix tokens in common with
    another group are compared with its members only if the union of their tokens holds enough of the node's.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_a"))
    levels, total = token_levels(docs, shingle)
    seen = stored(_documents(docs, shingle, percent, levels))
    nodes = stored(seen.where("n > 0").groupBy("node", "nid", "home").agg(
        F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least"), F.min("row_a").alias("row_a"),
        F.first("n").alias("n"), F.first("hot").alias("hot")))
    # A set is linked with another only if it has enough prefix tokens in common with others.
    shared = _shared(docs, shingle, percent, levels, total)
    able = stored(nodes.join(shared, "nid", "left").where(
        F.col("hot") + F.coalesce("shared", F.lit(0)) >= 1 + F.floor(F.ceil(F.col("n") * percent / 100) / 20)))
    # The matrix is dealt by the tokens that take part, so that matches of a set and a group are mostly counted in one task.
    taking = able.agg(F.sum("n")).first()[0] or 0
    asks = stored(_asks(docs, shingle, percent, levels, _filter(able.select("row_a")), taking).join(
        able.select("nid"), "nid", "left_semi"))

    # Groups with company, or with a set that asks them.
    sizes = able.groupBy("home").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("tokens"))
    asking = asks.groupBy(F.col("group").alias("home")).agg(F.count(F.lit(1)).alias("asking"))
    live = stored(sizes.join(asking, "home", "left").where("members > 1 or asking > 0").select(
        "home", (F.col("members") + F.coalesce("asking", F.lit(0))).alias("weight"),
        F.ceil(F.col("tokens") / BLOCK_TOKENS).alias("blocks")))
    group = F.col("home").alias("group")
    members = attach(able, live, ["home"], "weight").withColumn("own", F.pmod(F.xxhash64("nid"), "blocks"))
    at_home = members.select("nid", group, F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("block"), "own", "n_docs").select(
        "nid", "group", "block", (F.col("block") == F.col("own")).alias("is_member"), "n_docs")
    named = asks.join(able.select("nid", "n_docs"), "nid").select("nid", F.col("group").alias("home"), "n_docs")
    elsewhere = attach(named, live, ["home"], "weight").select(
        "nid", group, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(False).alias("is_member"), "n_docs")
    places = stored(at_home.unionByName(elsewhere))

    wanted = able.join(places.select("nid").distinct(), "nid", "left_semi").select("row_a")
    sets = _sets(docs, shingle, _filter(wanted))
    found = stored(_linked(sets.join(places, "nid"), percent))
    roots = connected_components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = stored(nodes.select("node", "n_docs", "least").join(links, "node", "left").join(roots, "node", "left").select(
        "node", "n_docs", "least", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links")))
    smallest = placed.groupBy("root").agg(F.count(F.lit(1)).alias("weight"), F.min("least").alias("component_id"))
    facts = stored(attach(placed, stored(smallest), ["root"], "weight").select("node", "n_docs", "n_links", "component_id"))
    named = attach(seen.where("n > 0"), facts, ["node"], "n_docs").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return named.unionByName(seen.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"),
        F.lit(0).cast("long").alias("n_links")))


def smallest_ids(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(component_id): the smallest doc_id of each component of ``similar_sets``; texts without words are one component."""
    found = stored(similar_sets(docs, shingle, percent).select("doc_id", "n_shingles", "component_id"))
    blank = found.where("n_shingles = 0").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    return found.where("n_shingles > 0").select("component_id").distinct().unionByName(
        blank.where("n > 0").select("component_id"))
