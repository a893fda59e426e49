"""Near duplicates by similarity: planted copies, brute force over all pairs, and who stays of a group."""

import random

import pytest

import corpus_pipeline
from curveloom.llm import set_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def planted(rng, n, similarity_wanted):
    """A text and a copy with words changed, far apart, until the similarity is as wanted or just above it."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    copy = list(words)
    for at in range(7, n, 11):
        changed = copy[:at] + [f"x{at}"] + copy[at + 1:]
        if similarity(shingles(" ".join(words)), shingles(" ".join(changed))) < similarity_wanted:
            break
        copy = changed
    return " ".join(words), " ".join(copy)


def rows_of(texts):
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def test_planted_copies_go(spark):
    rng = random.Random(3)
    texts = []
    for wanted in (0.8, 0.85, 0.9, 0.95):
        for _ in range(25):
            texts += planted(rng, 400, wanted)
    close = [similarity(shingles(a), shingles(b)) for a, b in zip(texts[::2], texts[1::2])]
    assert min(close) >= 0.8 and sum(c < 0.84 for c in close) >= 25
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)
    kept = corpus_pipeline.without_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, len(texts), 2))


@pytest.mark.parametrize("block", [400, 1 << 20])
def test_components_against_all_pairs(spark, monkeypatch, block):
    """Chains, dense groups larger than a small band, and texts just too far apart."""
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", block)
    rng = random.Random(8)
    texts = [None, "", " \n", "one", "One ", "one two"]
    for size in (1, 1, 2, 5, 40, 40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150]))]
        for _ in range(size):
            texts.append(" ".join(words))
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    got = sorted(r[0] for r in set_join.smallest_ids(docs).collect())
    assert got == sorted(set(group)) and len(got) > 10
    assert set_join.smallest_ids(docs.limit(0)).count() == 0
