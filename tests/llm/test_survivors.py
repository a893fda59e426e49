"""Every component keeps exactly one row, whatever its ids are."""

import random

import corpus_pipeline
from curveloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_with_null_or_repeated_ids(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(12)]
    rows = [(None, t) for t in texts[:5]] + [(1, t) for t in texts[5:9]] + [(2, texts[9]), (None, texts[9])]
    rows += [(3, texts[5]), (0, texts[6]), (None, texts[0]), (1, texts[7]), (4, texts[10]), (4, texts[10]), (5, texts[11])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(4)
    wanted = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in texts}
    for kept in (simhash.keep_one(docs), corpus_pipeline.without_near_duplicates(spark, docs, "")):
        got = [(r["text"], r["doc_id"]) for r in kept.collect()]
        assert sorted(got, key=str) == sorted(wanted.items(), key=str)
