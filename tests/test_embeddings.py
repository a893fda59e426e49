"""Statistics over every element of the embeddings, not the 18 of a shape."""

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"


def test_all_elements_are_covered(spark):
    queries = entry_point.queries()
    assert [r["i"] for r in queries["embedding_mean"](spark, FOLDER).orderBy("i").collect()] == list(range(64))
    pairs = {(r["i"], r["j"]) for r in queries["embedding_covariance"](spark, FOLDER).collect()}
    assert pairs == {(i, j) for i in range(64) for j in range(i, 64)}
