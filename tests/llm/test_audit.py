"""Filter audit against brute force on awkward rows, and on an empty table."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from curveloom.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def failing(rows):
    """(part, filters failed, doc_id) of each row, by the definitions."""
    out = []
    for doc_id, text, lang, *_ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc_id is not None and any(
                r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows),
        }
        out.append((lang or "", {f for f, bad in fails.items() if bad}, doc_id))
    return out


def brute_force(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    found, all_rows = [], failing(rows)
    for part in {p for p, _, _ in all_rows}:
        own = [(f, d) for p, f, d in all_rows if p == part]
        worth, lines = Counter(), []
        for order in permutations("ABCDE"):
            for step, name in enumerate(order, 1):
                before = set(order[:step - 1])
                gone = [d for f, d in own if name in f and not f & before]
                worth[name] += len(gone)
                lines.append((name, (part, "".join(order), step, sum(not f & (before | {name}) for f, _ in own), len(gone),
                              sum(name in f and bool(f & before) for f, _ in own), sum(f == {name} for f, _ in own),
                              sum(d in good for d in gone), sum(d in toxic for d in gone))))
        found += [(*line, worth[name]) for name, line in lines]
    return found


def test_against_brute_force(spark, corpus_rows, clashing):
    rows = list(corpus_rows)
    rows += [(600 + i, t, "xx", "s", 1) for i, t in enumerate(["A # b", "lower $ case", "Ab " * 250, "a" * 33 + "Q", "Å" * 40 + "A"])]
    rows += [(650, "same doc, two texts", "en", "s", 1), (650, "the other $ text", "de", "s", 1)] + [(651, None, None, "s", 1)] * 40
    labels = [(d, d % 2, int(d % 5 == 0)) for d, *_ in rows if d is not None and d % 3 == 0]
    labels += [(650, 1, 0), (650, None, 1), (651, 1, None), (None, 1, 1), (99999, 1, 1)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for name in ("part", "good", "toxic", "n_docs", "key_a", "own", "prefix", "quality"):
        docs = docs.withColumn(name, docs["source"])
    got = audit.audit_filters(docs.repartition(5), spark.createDataFrame(labels, LABELS))
    assert sorted(map(tuple, got.collect())) == sorted(brute_force(rows, labels))


def test_hot_ids_and_empty_tables(spark, empty, monkeypatch):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit_filters(empty, none).count() == 0
    rows = [(None, "x", None, "s", 1)] * 50 + [(i, "y", "en", "s", 1) for i in range(50)] + [(7, "Z %", "en", "s", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, audit.audit_filters(docs, none).collect())) == sorted(brute_force(rows, []))


def test_one_relation_a_filter_holds_failing_ids_only(spark, corpus, corpus_rows):
    found = audit.relations(corpus, spark.createDataFrame([], LABELS))
    wanted = defaultdict(int)
    for _, fails, _ in failing(corpus_rows):
        for name in fails:
            wanted[name] += 1
    assert {f: t.groupBy().sum("n_docs").first()[0] or 0 for f, t in found.failing.items()} == {
        f: wanted[f] for f in "ABCDE"}
