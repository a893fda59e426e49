"""Alignment of tokenizers against brute force: whole texts, all pairs of tokens, counts over the corpus."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from curveloom.llm import alignment
from curveloom.llm.alignment import Alignment, Csr

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["a", "the", "  ", " ", "\n", "\n\n", "\t", "don't", "é", "日本", " ", "\x1c", "1", "23", "!", "<s>", "\x00", "word",
       "<|endoftext|>", "\r\n", "'s", "🙂", "straße", "<0x41>", "</s>", "unbelievable"]


def token_bytes(text):
    """(id, bytes) of the tokens by both; empty if the bytes are not a blank and the text."""
    shown = {chr(b): bytes([b]) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    shown |= {chr(256 + i): bytes([b]) for i, b in enumerate(b for b in range(256) if chr(b) not in shown)}
    if not text:
        return [], []
    a = [(i, b"".join(shown[c] for c in A.id_to_token(i))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
         for i in B.encode(text) for p in [B.id_to_piece(i)]]
    same = b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode()
    return (a, b) if same else ([], [])


def spans(tokens):
    at, out = 0, []
    for i, data in tokens:
        out.append((i, at, at + len(data)))
        at += len(data)
    return out


def brute_force(texts):
    docs, held = [], Counter()
    for text in texts:
        a, b = map(spans, token_bytes(text))
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        ends = sorted({e for *_, e in a} & {f for *_, f in b})
        groups, start = [], 0
        for end in ends:
            groups.append(([i for i, s, e in a if start < e <= end], [j for j, t, f in b if start < f <= end]))
            start = end
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        docs.append((a, b, links, groups, hashlib.sha256(shown.encode()).hexdigest() if a else ""))
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [{"n_a": len(a), "n_b": len(b), "n_groups": len(groups), "n_links": len(links),
             "n_best": sum(held[p] == best[p[0]] for p in links), "count_sum": sum(held[p] for p in links),
             "groups_sha256": shown, "n_shared": sum(len(x) * len(y) for x, y in groups)}
            for a, b, links, groups, shown in docs]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    found = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 25))) for _ in range(150)]
    found += ["".join(rng.choice(ODD) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    return found + [None, "", " ", "\n", "a▁b", "▁", "x" * 700, "the the the", found[3], found[3], found[160]]


@pytest.mark.parametrize("limit", [10**6, 10])
def test_against_brute_force(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(alignment, "SECTION", 60)
    monkeypatch.setattr(alignment, "REMEMBERED", 40)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 50)
    monkeypatch.setattr(alignment, "TEXTS", 7)
    rows = [(i if i % 9 else None, t, i, i, "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, n_a int, ids_a string").repartition(3)
    got = [r.asDict() for r in alignment.link_support(docs, limit).collect()]
    wanted = [{"doc_id": r[0]} | d for r, d in zip(rows, brute_force(texts))]
    order = lambda d: str(sorted(d.items(), key=str))
    assert sorted(got, key=order) == sorted(wanted, key=order)


def test_groups_and_links_are_real(spark, texts):
    docs = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None)], "doc_id long, text string")
    one, two = sorted(alignment.align_documents(docs, with_groups=True).collect(), key=lambda r: r["doc_id"])
    assert hashlib.sha256(one["groups"].encode()).hexdigest() == one["groups_sha256"]
    assert sum(one["times"]) == one["n_links"] and two["groups"] == "" and two["ids_a"] == []


def test_empty_table_and_awkward_rows(spark, corpus, corpus_rows, empty, clashing):
    assert alignment.link_support(empty).count() == 0
    rows = alignment.link_support(clashing(corpus)).collect()
    assert len(rows) == len(corpus_rows)
    assert sum(r["n_a"] == 0 for r in rows) == sum(not r[1] for r in corpus_rows)
    assert all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] for r in rows)


def test_products_against_dense_matrices():
    rng = np.random.default_rng(2)
    for _ in range(50):
        x, y = rng.random((rng.integers(1, 9), 7)) < 0.3, rng.random((7, rng.integers(1, 9))) < 0.3
        one, other = (Csr(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1]) for m in (x, y))
        product = np.zeros((len(x), y.shape[1]), int)
        rows, columns, values = one.times(other)
        product[rows, columns] = values
        assert (product == x.astype(int) @ y.astype(int)).all() and (values > 0).all()
        assert (one.product_terms(other) == product.sum(axis=1)).all()
        back = one.transposed().transposed()
        assert (back.indptr == one.indptr).all() and (back.indices == one.indices).all()


def test_blocks_of_one_alignment(monkeypatch):
    rng = np.random.default_rng(3)
    cuts = [np.diff(np.unique(np.append(rng.integers(0, 900, n), [0, 900]))) for n in (200, 260)]
    whole = Alignment.of(*cuts)
    pairs = {(a, b) for a, b in zip(whole.link_a.tolist(), whole.link_b.tolist())}
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 8)
    small = Alignment.of(*cuts)
    assert (small.link_a == whole.link_a).all() and (small.shared_bytes == whole.shared_bytes).all()
    shared = [p for a, b in small.shared_links() for p in zip(a.tolist(), b.tolist())]
    assert len(shared) == small.shared_counts().sum() == len(set(shared)) and pairs <= set(shared)
    assert all(whole.group_a[a] == whole.group_b[b] for a, b in shared)
