"""SimHash links, nearest neighbours, token counts and packing: against brute force and exact round trips."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curveloom.llm import neighbours, packing, simhash, tokens
from curveloom.llm.components import connected_components

LOWER = {i: i + 32 for i in range(65, 91)}


def print_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(values, reach):
    unique = sorted(set(values))
    parent = list(range(len(unique)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(unique)):
        for j in range(i):
            if (unique[i] ^ unique[j]).bit_count() <= reach:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {v: root(i) for i, v in enumerate(unique)}


def test_fingerprints_and_components(corpus, corpus_rows, clashing):
    got = simhash.near_duplicates(clashing(corpus)).collect()
    prints = [(r[0], print_by_hand(r[1])) for r in corpus_rows]
    groups = groups_by_hand([p for _, p in prints], 2)
    least = defaultdict(list)
    for doc_id, value in prints:
        least[groups[value]].append(doc_id)
    smallest = {g: min((d for d in ids if d is not None), default=None) for g, ids in least.items()}
    wanted = sorted((str(d), v, str(smallest[groups[v]])) for d, v in prints)
    assert sorted((str(r["doc_id"]), r["fingerprint"] % 2**64, str(r["component_id"])) for r in got) == wanted
    assert simhash.near_duplicates(corpus.limit(0)).count() == 0


def test_one_of_each_group_stays(corpus, clashing):
    kept = simhash.keep_one(clashing(corpus))
    assert kept.columns == clashing(corpus).columns
    found = simhash.near_duplicates(corpus).where("doc_id is not null").collect()
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted({r["component_id"] for r in found if r["component_id"] is not None})


@pytest.mark.parametrize("reach", [0, 2, 3])
def test_links_over_many_shards(spark, monkeypatch, reach):
    """Clusters and chains in a tree of small shards, which are split further inside."""
    rng = random.Random(5)
    values = {0, 2**64 - 1}
    for _ in range(150):
        value = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 12])):
            values.add(value)
            value ^= 1 << rng.randrange(64) | (1 << rng.randrange(64))
    center = rng.getrandbits(64)
    values |= {center ^ (1 << i) for i in range(64)}
    monkeypatch.setattr(simhash, "LEAF", 20)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint long"), reach)
    roots = {r["node"] % 2**64: r["root"] for r in connected_components(edges).collect()}
    groups = groups_by_hand(values, reach)
    by_root, by_hand = defaultdict(set), defaultdict(set)
    for v in values:
        by_root[roots.get(v, ("alone", v))].add(v)
        by_hand[groups[v]].add(v)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_hand.values()))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1100)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def nearest_by_hand(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == 8
            and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % every == 0:
            a = np.array(v, float)
            scored = sorted((-(a @ np.array(w, float)) / (np.linalg.norm(a) * np.linalg.norm(np.array(w, float))), j)
                            for j, w in good if j != i)
            out[i] = scored[:k]
    return out


def vector_rows():
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(900)]
    same = rows[50][1]
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [1.0] * 7 + [None]), (2003, [float("nan")] * 8),
             (2004, [float("inf")] + [1.0] * 7), (2050, [1.0, 2.0]), (None, same), rows[10], rows[10], (2100, [])]
    return rows


def test_nearest_neighbours(spark, clashing):
    rows = vector_rows()
    table = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4))
    got = defaultdict(list)
    for r in neighbours.nearest_vectors(table, every=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    wanted = nearest_by_hand(rows, 50, 5)
    assert set(got) == set(wanted)
    hits = 0
    for i, best in wanted.items():
        found = sorted(got[i])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        hits += len({f[1] for f in found} & {j for _, j in best})
    assert hits >= 0.9 * 5 * len(wanted)
    assert [f[1] for f in sorted(got[1050])] == [j for _, j in wanted[1050]]


def test_graph_recall_with_many_shards(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 16))
    small = np.round(vectors / np.abs(vectors).max(axis=1, keepdims=True) * 127).astype(np.int8)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(small)], "node long, vec binary")
    graph = neighbours.neighbour_graph(nodes, 16, degree=10, shard_nodes=200, seed_rounds=2, rounds=4).collect()
    units = small / np.linalg.norm(small.astype(float), axis=1, keepdims=True)
    sims = units @ units.T
    np.fill_diagonal(sims, -2)
    hits = sum(len(set(r["ids"]) & set(np.argsort(-sims[r["node"]])[:10].tolist())) for r in graph)
    assert len(graph) == 1500 and hits >= 0.9 * 15000


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.nearest_vectors(spark.createDataFrame([], schema)).count() == 0
    assert neighbours.nearest_vectors(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    rows = neighbours.nearest_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (7, [2.0, 0.0]), (3, [0.0, 1.0])], schema)).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in rows) == [(1, 7, 1.0), (2, 3, 0.0)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")


def test_encoder_equals_the_tokenizer(tokenizer, corpus_rows):
    encoder = tokens.Encoder()
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "1", "'s", "!", "<|endoftext|>", " ", "\x1c", "日本", "🙂", "́", "<|", " the", "\u2003"]
    texts = [r[1] or "" for r in corpus_rows] + ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("block_ids", [3, 1000, 1 << 18])
def test_token_counts(corpus, corpus_rows, tokenizer, block_ids):
    tokenizer.encode_special_tokens = True
    wanted = sorted((str(r[0]), len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus_rows)
    tokenizer.encode_special_tokens = False
    rows = corpus if block_ids > 3 else corpus.where("doc_id is null or doc_id < 305")
    if block_ids == 3:
        wanted = [w for w in wanted if w[0] == "None" or int(w[0]) < 305]
    got = tokens.token_counts(rows, block_ids=block_ids).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == wanted


def test_scan_of_open_files_and_empty_blocks(spark):
    make = lambda *ids: bytearray(np.array(ids, "<u2").tobytes())
    blocks = [(0, 0, make(1, 2)), (0, 1, make(3)), (0, 2, make(9, 9, 4, 9, 5)), (0, 3, make()), (0, 4, make(6)), (1, 0, make(9)), (2, 0, None)]
    got = tokens.scan_separators(spark.createDataFrame(blocks, "file_id long, block_no long, ids binary"), 9).collect()
    assert sorted(tuple(r) for r in got) == [(0, 0, 3), (0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 0, 0)]
    assert tokens.scan_separators(spark.createDataFrame([], "file_id long, block_no long, ids binary"), 9).count() == 0


def check_packing(rows, documents, tokenizer, capacity):
    ids = defaultdict(list)
    for doc_id, text in documents:
        ids[doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        assert any(r["doc_tokens"] == len(d) and r["start"] + r["length"] <= len(d) and zlib.crc32(
            np.array(d[r["start"]:r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for d in ids[r["doc_id"]])
        pieces[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert dict(pieces) == {k: sum(map(len, v)) for k, v in ids.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return [sum(n for _, n in parts) for parts in sequences.values()]


@pytest.mark.parametrize("capacity, group_docs", [(2048, 4096), (64, 20)])
def test_packing(corpus, corpus_rows, tokenizer, clashing, capacity, group_docs):
    rows = packing.pack(clashing(corpus), capacity, group_docs=group_docs).collect()
    lengths = check_packing(rows, [(r[0], r[1]) for r in corpus_rows], tokenizer, capacity)
    assert len(lengths) <= 1.15 * sum(lengths) / capacity + 12
    again = packing.pack(corpus.repartition(2), capacity, group_docs=group_docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_packing_of_nothing(empty):
    assert packing.pack(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, capacity=0)


def test_least_slack_is_least():
    from itertools import product

    rng = random.Random(9)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 8))])
        room = rng.randint(0, 60)
        remaining = packing.Remaining(lengths)
        chosen = packing.least_slack(remaining, room)
        total = sum(a * n for a, n in chosen)
        best = max(s for s in (sum(x) for x in product(*[(0, int(v)) for v in lengths])) if s <= room)
        assert total == best
        for length, n in chosen:
            assert n <= remaining.count[length]
