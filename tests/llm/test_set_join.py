"""The join of n-gram sets against brute force over all pairs: chains, dense groups, shared passages, awkward rows."""

import random
import re

import pytest

from curveloom.llm import set_join

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, n, percent):
    sets, group, links = [shingles(r[1], n) for r in rows], list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                links[i] += 1
                links[j] += 1
                if group[i] != group[j]:
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
    least = {}
    for g, r in zip(group, rows):
        least[g] = min((x for x in (least.get(g), r[0]) if x is not None), default=None)
    return [(r[0], len(s), least[g], k) for r, s, g, k in zip(rows, sets, group, links)]


def near_copies(rng):
    """Bases with chains of edits, families of copies around the limit, and one passage in many other texts."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n", "one", "One ", "one two", "a b c", "A  B\tc", "é É"]
    for size, n in ((1, 40), (2, 50), (2, 300), (6, 120), (40, 90), (40, 400), (25, 12)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(size):
            texts.append(" ".join(words))
            for _ in range(rng.choice([1, 1, max(1, n // 60)])):
                words[rng.randrange(n)] = f"w{rng.randrange(10**6)}"
    base = [f"b{i}" for i in range(150)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(150)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    for _ in range(60):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 30, 200]))]
        texts.append(" ".join(own[:10]) + " " + passage + " " + " ".join(own[10:]))
    common = [f"c{i}" for i in range(30)]
    texts += [" ".join(rng.choice(common) for _ in range(80)) for _ in range(20)]
    return texts + [texts[20]] * 7


@pytest.mark.parametrize("n, percent, block", [(4, 85, 1 << 20), (5, 80, 2000), (4, 85, 500), (1, 50, 300)])
def test_against_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(set_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(set_join, "PART_TOKENS", 700)
    rng = random.Random(block + n)
    texts = near_copies(rng)
    rng.shuffle(texts)
    rows = [(i if i % 17 else (None if i % 2 else 3), t, "en", "s", 1) for i, t in enumerate(texts)]
    got = set_join.similar_sets(spark.createDataFrame(rows, SCHEMA).repartition(5), n, percent).collect()
    wanted = brute_force(rows, n, percent)
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert sum(w[3] > 0 for w in wanted) > 50


def test_awkward_rows_and_empty_table(spark, corpus, corpus_rows, empty, clashing):
    assert set_join.similar_sets(empty).count() == 0
    docs = clashing(corpus)
    for name in ("row_a", "nid", "home", "n", "n_docs", "least", "weight", "root"):
        docs = docs.withColumn(name, docs["source"])
    got = set_join.similar_sets(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_force(corpus_rows, 4, 85), key=str)


def test_tokens_do_not_depend_on_sections(monkeypatch):
    text = (" ".join(f"Word{i} und  so\tweiter" for i in range(300)) + " " + "x" * 5000 + "\n" + "y " * 9 + "z" * 7000).encode()
    first = set_join.token_set(text, 4)
    monkeypatch.setattr(set_join, "SECTION", 1000)
    for name, base in (("_up", set_join._BASE), ("_down", pow(set_join._BASE, -1, 1 << 64))):
        monkeypatch.setattr(set_join, name, set_join._powers(base, 1000))
    assert (set_join.token_set(text.upper(), 4) == set_join.token_set(text.lower(), 4)).all()
    assert (set_join.token_set(text, 4) == first).all()
    assert len(first) == len(shingles(text.decode(), 4))


def test_hashes_of_many_words_differ():
    words = {bytes([a, b, c]) for a in range(33, 65) for b in range(33, 65) for c in range(33, 65)}
    words |= {bytes([a]) * n for a in range(33, 127) for n in range(1, 50)}
    assert len(set(set_join._word_hashes(b" ".join(words)).tolist())) == len(words)


def test_matrix_counts_do_not_depend_on_the_stretches(monkeypatch):
    import numpy as np

    from curveloom.llm import set_join

    rng = np.random.default_rng(1)
    rows = np.zeros(3000, set_join._record)
    rows["nid"] = np.arange(3000) % 200 + 1
    rows["home"], rows["n"] = 1000 + rows["nid"] // 3, rows["nid"] % 7 + 5
    rows["token"] = rows["nid"] // 20 * 50 + rng.integers(0, 50, 3000)
    expected = {}
    for token in np.unique(rows["token"]):
        held = {(int(r["nid"]), int(r["home"]), int(r["n"])) for r in rows[rows["token"] == token]}
        for nid, home, n in held:
            for group in {h for _, h, _ in held if h < home}:
                expected[nid, group, n] = expected.get((nid, group, n), 0) + 1
    for asked in (1, 7, 1 << 20):
        monkeypatch.setattr(set_join, "ASKED", asked)
        out = list(set_join._met(rows))[-1]
        got = dict(zip(zip(*(out[c].to_pylist() for c in ("nid", "home", "n"))), out["matches"].to_pylist()))
        assert got == expected and len(got) == len(out["nid"])
