"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curveloom.llm.common import attach, map_batches, stored

#: Neighbours a node keeps, and the nearest reverse neighbours it is joined with and searched by.
DEGREE, REVERSE, SEARCHED_REVERSE = 20, 20, 48
#: The first graph: exact neighbours within shards around pivots, in so many rounds of other pivots.
SHARD_NODES, SEED_ROUNDS, MOST_PIVOTS = 8192, 5, 4096
#: Most rounds of NN-descent; they end earlier when the graph no longer changes.
ROUNDS = 3
#: Nodes a search keeps, its hops, and nodes whose similarity is measured exactly in the end.
BEAM, HOPS, RERANKED = 128, 6, 32


def sound(vector: Column) -> Column:
    """Whether a vector has a direction: not null, all components finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision."""
    dot = lambda p, q: F.aggregate(
        F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return lengths.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _lists(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float32)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-12)


def _decoded(column: pa.Array, size: int) -> np.ndarray:
    """Rows of unit vectors from a column of 8-bit vectors."""
    joined = b"".join(column.to_pylist())
    return _units(np.frombuffer(joined, np.int8).reshape(-1, size)) if joined else np.empty((0, size), np.float32)


def _best(rows: np.ndarray, n_rows: int, ids: np.ndarray, sims: np.ndarray, most: int,
          extra: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The ``most`` nearest distinct ids of each row, nearest first: lengths, ids, sims (and extra)."""
    order = np.lexsort((-sims, ids, rows)) if extra is None else np.lexsort((-extra, -sims, ids, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])) if len(rows) else np.empty(0, bool)
    extra = None if extra is None else extra[order][new]
    rows, ids, sims = rows[new], ids[new], sims[new]
    order = np.lexsort((ids, -sims, rows))
    rows, ids, sims = rows[order], ids[order], sims[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    kept = np.arange(len(rows)) - first[rows] < most
    out = np.bincount(rows[kept], minlength=n_rows), ids[kept], sims[kept]
    return out if extra is None else (*out, extra[order][kept])


def _within_shards(nodes: DataFrame, size: int, degree: int, seed_rounds: int, shard_nodes: int) -> DataFrame:
    """(node, ids, sims): exact neighbours inside shards, for each round of pivots.

    Pivots are a bounded sample in hash order. A pivot with more nodes than a shard holds is dealt
    to several shards, so a shard is bounded.
    """
    n = nodes.count()
    wanted = min(MOST_PIVOTS, max(1, 2 * n // shard_nodes))
    share = min(1.0, 4 * wanted * seed_rounds / max(1, n))
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000)))).select(
        "vec").limit(wanted * seed_rounds).collect()
    pivots = _units(np.frombuffer(b"".join(bytes(r[0]) for r in drawn), np.int8).reshape(-1, size))
    sets = [p for p in (pivots[i::seed_rounds] for i in range(seed_rounds)) if len(p)]

    def nearest_pivot(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        vectors = _decoded(batch["vec"], size)
        found = [np.concatenate([(vectors[at:at + 1024] @ p.T).argmax(axis=1) for at in range(0, len(vectors), 1024)])
                 for p in sets]
        return {"node": batch["node"], "vec": batch["vec"],
                "pivots": _lists(np.full(len(vectors), len(sets)), np.stack(found, 1).ravel(), pa.int64())}

    dealt = stored(map_batches(nodes, ["node", "vec"], nearest_pivot, "node long, vec binary, pivots array<long>"))
    each = dealt.select("node", "vec", F.posexplode("pivots").alias("round", "pivot"))
    # At most MOST_PIVOTS rows a round.
    sizes = each.groupBy("round", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard_nodes).alias("parts"))
    sharded = each.join(F.broadcast(sizes), ["round", "pivot"]).withColumn(
        "part", F.pmod(F.xxhash64("node", "round"), F.col("parts")))

    def inside(shard: pa.Table) -> pa.Table:
        ids = shard["node"].to_numpy()
        vectors = _decoded(shard["vec"].combine_chunks(), size)
        rows, found, sims = [], [], []
        most = min(degree, len(ids) - 1)
        for at in range(0, len(ids) if most else 0, 512):
            block = vectors[at:at + 512] @ vectors.T
            here = np.arange(len(block))
            block[here, at + here] = -2
            top = np.argpartition(-block, most - 1, axis=1)[:, :most]
            rows.append(np.repeat(at + here, most))
            found.append(ids[top].ravel())
            sims.append(np.take_along_axis(block, top, 1).ravel())
        if not rows:
            lengths, near, sim = np.zeros(len(ids), np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        else:
            lengths, near, sim = _best(np.concatenate(rows), len(ids), np.concatenate(found), np.concatenate(sims), most)
        return pa.table({"node": shard["node"], "ids": _lists(lengths, near, pa.int64()),
                         "sims": _lists(lengths, sim, pa.float32())})

    return sharded.select("round", "pivot", "part", "node", "vec").groupBy("round", "pivot", "part").applyInArrow(
        inside, "node long, ids array<long>, sims array<float>")


def _merged(nodes: DataFrame, found: DataFrame, degree: int) -> DataFrame:
    """(node, vec, ids, sims): the nearest of all lists found for a node."""
    gathered = nodes.select("node", "vec", F.array().cast("array<long>").alias("ids"),
                            F.array().cast("array<float>").alias("sims")).unionByName(
        found.select("node", F.lit(None).cast("binary").alias("vec"), "ids", "sims")
    ).groupBy("node").agg(F.max("vec").alias("vec"), F.flatten(F.collect_list("ids")).alias("ids"),
                          F.flatten(F.collect_list("sims")).alias("sims"))

    def merge(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = batch["node"].to_numpy()
        lengths, ids = _flat(batch["ids"])
        sims = _flat(batch["sims"])[1]
        rows = np.repeat(np.arange(len(own)), lengths)
        other = ids != own[rows]
        lengths, ids, sims = _best(rows[other], len(own), ids[other], sims[other], degree)
        return {"node": batch["node"], "vec": batch["vec"], "ids": _lists(lengths, ids, pa.int64()),
                "sims": _lists(lengths, sims, pa.float32())}

    return map_batches(gathered, ["node", "vec", "ids", "sims"], merge,
                       "node long, vec binary, ids array<long>, sims array<float>")


def _around(graph: DataFrame, reverse: int) -> DataFrame:
    """(node, other): neighbours of a node and the nearest nodes it is a neighbour of."""
    forward = graph.select("node", F.explode(F.arrays_zip("ids", "sims")).alias("e")).select(
        "node", F.col("e.ids").alias("other"), F.col("e.sims").alias("sim"))
    nearest = Window.partitionBy("node").orderBy(F.col("sim").desc(), "other")
    backward = forward.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim").withColumn(
        "n", F.row_number().over(nearest)).where(F.col("n") <= reverse)
    return forward.select("node", "other").unionByName(backward.select("node", "other")).distinct()


def _descend(graph: DataFrame, size: int, degree: int, reverse: int) -> DataFrame:
    """One round: the nodes around a node are tried as neighbours of each other."""
    tried = _around(graph, reverse).join(
        graph.select(F.col("node").alias("other"), "vec",
                     F.when(F.size("ids") >= degree, F.array_min("sims")).otherwise(-2.0).cast("float").alias("worst")),
        "other",
    ).groupBy("node").agg(F.collect_list("other").alias("ids"), F.collect_list("vec").alias("vecs"),
                          F.collect_list("worst").alias("worst"))

    def local_join(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lengths, ids = _flat(batch["ids"])
        worst = _flat(batch["worst"])[1]
        vectors = _decoded(batch["vecs"].flatten(), size)
        first = np.cumsum(lengths) - lengths
        out_node, out_ids, out_sims, out_lengths = [], [], [], []
        for at in range(0, len(lengths), 1024):
            part = lengths[at:at + 1024]
            width = int(part.max(initial=0))
            if width < 2:
                continue
            place = first[at:at + 1024, None] + np.arange(width)[None, :]
            there = np.arange(width)[None, :] < part[:, None]
            place = np.where(there, place, 0)
            near = vectors[place]
            sims = near @ near.transpose(0, 2, 1)
            sims[~(there[:, :, None] & there[:, None, :])] = -3
            sims[:, np.arange(width), np.arange(width)] = -3
            sims[sims <= np.where(there, worst[place], 9)[:, :, None]] = -3
            most = min(degree // 2, width)
            top = np.argpartition(-sims, most - 1, axis=2)[:, :, :most]
            value = np.take_along_axis(sims, top, 2)
            other = np.take_along_axis(np.broadcast_to(ids[place][:, None, :], sims.shape), top, 2)
            good = value > -2
            some = good.any(axis=2)
            out_node.append(ids[place][some])
            out_lengths.append(good[some].sum(axis=1))
            out_ids.append(other[some][good[some]])
            out_sims.append(value[some][good[some]])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        counts = join(out_lengths, np.int64)
        return {"node": pa.array(join(out_node, np.int64)), "ids": _lists(counts, join(out_ids, np.int64), pa.int64()),
                "sims": _lists(counts, join(out_sims, np.float32), pa.float32())}

    better = map_batches(tried, ["ids", "vecs", "worst"], local_join, "node long, ids array<long>, sims array<float>")
    return _merged(graph, better.unionByName(graph.select("node", "ids", "sims")), degree)


def neighbour_graph(nodes: DataFrame, size: int, degree: int = DEGREE, reverse: int = REVERSE, rounds: int = ROUNDS,
                    seed_rounds: int = SEED_ROUNDS, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(node, vec, ids, sims): up to ``degree`` near neighbours of every node of ``nodes`` (node, vec).

    ``vec`` are ``size`` signed bytes. Each round is stored; rounds end when the sum of similarities
    no longer grows.
    """
    graph = stored(_merged(nodes, _within_shards(nodes, size, degree, seed_rounds, shard_nodes), degree))
    total = lambda g: g.select(F.explode("sims").alias("s")).agg(F.sum(F.col("s").cast("decimal(20,6)"))).first()[0]
    before = total(graph)
    for _ in range(rounds if before is not None else 0):
        graph = stored(_descend(graph, size, degree, reverse))
        after = total(graph)
        if after == before:
            break
        before = after
    return graph


def search_graph(graph: DataFrame, queries: DataFrame, size: int, beam: int = BEAM, hops: int = HOPS,
                 reverse: int = SEARCHED_REVERSE) -> DataFrame:
    """(node, ids, sims): nodes found near the queries (node), which are nodes of the graph.

    Greedy search: it starts at the query's own node, and each hop looks at all nodes around those
    of the ``beam`` nearest so far that were not looked around before.
    """
    around = stored(_around(graph, reverse).groupBy("node").agg(F.collect_list("other").alias("others")))
    vectors = graph.select(F.col("node").alias("id"), "vec")
    state = graph.join(queries.select("node").distinct(), "node").select(
        "node", "vec", F.array("node").alias("ids"), F.array(F.lit(1.0).cast("float")).alias("sims"),
        F.array(F.lit(0).cast("byte")).alias("done"))

    def step(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        own = _decoded(batch["vec"], size)
        n = len(own)
        lengths, ids = _flat(batch["ids"])
        sims = _flat(batch["sims"])[1]
        new_lengths, new_ids = _flat(batch["new_ids"])
        new_rows = np.repeat(np.arange(n), new_lengths)
        near = _decoded(batch["new_vecs"].flatten(), size)
        new_sims = np.empty(len(new_ids), np.float32)
        for at in range(0, len(new_ids), 1 << 16):
            new_sims[at:at + (1 << 16)] = np.einsum("ij,ij->i", near[at:at + (1 << 16)], own[new_rows[at:at + (1 << 16)]])
        rows = np.concatenate([np.repeat(np.arange(n), lengths), new_rows])
        done = np.concatenate([np.ones(len(ids), np.int8), np.zeros(len(new_ids), np.int8)])
        ids, sims = np.concatenate([ids, new_ids]), np.concatenate([sims, new_sims])
        # What the beam held was looked around in this hop; a node met again keeps that mark.
        order = np.lexsort((-done, ids, rows))
        rows, ids, sims, done = rows[order], ids[order], sims[order], done[order]
        fresh = np.append(True, (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])) if len(rows) else np.empty(0, bool)
        lengths, ids, sims, done = _best(rows[fresh], n, ids[fresh], sims[fresh], beam, done[fresh])
        return {"node": batch["node"], "vec": batch["vec"], "ids": _lists(lengths, ids, pa.int64()),
                "sims": _lists(lengths, sims, pa.float32()), "done": _lists(lengths, done, pa.int8())}

    for _ in range(hops):
        front = state.select("node", F.explode(F.arrays_zip("ids", "done")).alias("e")).where("e.done = 0").select(
            "node", F.col("e.ids").alias("at"))
        met = front.join(around.withColumnRenamed("node", "at"), "at").select(
            "node", F.explode("others").alias("id")).distinct()
        new = met.join(vectors, "id").groupBy("node").agg(
            F.collect_list("id").alias("new_ids"), F.collect_list("vec").alias("new_vecs"))
        joined = state.join(new, "node", "left").select(
            "node", "vec", "ids", "sims",
            F.coalesce("new_ids", F.array().cast("array<long>")).alias("new_ids"),
            F.coalesce("new_vecs", F.array().cast("array<binary>")).alias("new_vecs"))
        state = stored(map_batches(
            joined, ["node", "vec", "ids", "sims", "new_ids", "new_vecs"], step,
            "node long, vec binary, ids array<long>, sims array<float>, done array<byte>"))
    return state.select("node", "ids", "sims")


def nearest(table: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id",
            vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row.

    Nearness is the cosine of the original vectors in double precision, ties go to the smaller id.
    Vectors that are null, zero, or hold null or non-finite components, rows without an id, and
    vectors of another length than most take no part. Rows that repeat id and vector count once. The
    graph is over distinct vectors: a group of copies is one node, of which the ``k`` + 1 smallest
    ids can be answers, and no other. An empty table gives no rows.
    """
    vector = F.col(vector_column)
    rows = stored(table.where(sound(vector) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), vector.alias("vector"), F.size(vector).alias("size"),
        F.xxhash64(vector).alias("a"), F.xxhash64(F.lit(1), vector).alias("b"), is_query.alias("is_query")))
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 1
    rows = rows.where(F.col("size") == size)
    smallest = Window.partitionBy("a", "b").orderBy("id")
    members = stored(rows.select("a", "b", "id", "vector").withColumn("n", F.dense_rank().over(smallest)).where(
        F.col("n") <= k + 1).groupBy("a", "b").agg(
        F.min("id").alias("least"), F.array_sort(F.collect_set("id")).alias("members"), F.first("vector").alias("vector")))
    # A node is numbered by its vector; two vectors may share their least id where ids repeat.
    scale = F.lit(127) / F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double"))))
    named = members.select(F.xxhash64("a", "b").alias("node"), "a", "b", "members", "vector", F.transform(
        "vector", lambda x: F.round(x.cast("double") * scale).cast("byte")).alias("small"))

    def packed(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lengths, values = _flat(batch["small"])
        data = values.astype(np.int8).tobytes()
        return {"node": batch["node"], "vec": pa.array([data[i:i + size] for i in range(0, len(data), size)], pa.binary())}

    nodes = stored(map_batches(named, ["node", "small"], packed, "node long, vec binary"))
    graph = neighbour_graph(nodes, size)
    asked = stored(rows.where("is_query").select("a", "b", "id").distinct().select(
        F.xxhash64("a", "b").alias("node"), "id"))
    counts = asked.groupBy("node").agg(F.count(F.lit(1)).alias("n_queries"))
    found = search_graph(graph, counts, size)
    best = found.select("node", F.explode(F.slice(F.array_distinct(F.concat(F.array("node"), "ids")), 1, RERANKED + 1)).alias("near"))
    vectors = named.select("node", "vector", "members")
    scored = best.join(vectors.select("node", F.col("vector").alias("own")), "node").join(
        vectors.select(F.col("node").alias("near"), "vector", "members"), "near"
    ).select("node", cosine(F.col("own"), F.col("vector")).alias("score"), "members")
    by_score = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    answers = scored.select("node", "score", F.explode("members").alias("vec_id")).withColumn(
        "n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    facts = stored(answers.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("answers")).join(
        counts, "node"))
    met = attach(asked, facts, ["node"], "n_queries")
    others = F.slice(F.filter("answers", lambda x: x["vec_id"] != F.col("id")), 1, k)
    return met.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "answer")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("answer.vec_id").alias("vec_id"),
        F.col("answer.score").alias("score"))


def nearest_vectors(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``, among all rows."""
    return nearest(table, F.col("vec_id") % every == 0, k)
