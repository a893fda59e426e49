"""The pipeline: every stage against brute force on its own input, and the registered queries."""

from collections import Counter

import corpus_pipeline
from curveloom.llm.common import stored
from curveloom.llm.registry import QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, corpus):
    docs = corpus
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
        seen.append((name, docs))
        if name != "packing":
            assert docs.columns == COLUMNS
    by_name = dict(seen)
    known = by_name["language_id"]
    assert {r["doc_id"] for r in known.collect()} >= set(range(150))
    assert known.where("doc_id in (300, 301, 302, 303)").count() == 0
    assert by_name["line_dedup"].count() == known.count()
    single = by_name["simhash_near_dedup"]
    # Of the copies 229 has kept the long lines, the others are alike without them, and so is 3.
    assert [r[0] for r in single.where("doc_id between 200 and 229").select("doc_id").collect()] == [229]
    assert single.select("doc_id").distinct().count() == single.count()
    mixed = by_name["source_mix"]
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 3
    pieces = by_name["packing"]
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_run_on_a_table(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_run_on_an_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_near_duplicates_are_those_of_the_fingerprints(spark):
    # Repeated words outweigh the ends in a fingerprint; as sets of shingles the texts share little.
    ends = [" ".join(f"{c}{i}" for i in range(20)) for c in "xy"]
    texts = ["a b c " * 100 + e for e in ends] + ends
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == [0, 2, 3]
