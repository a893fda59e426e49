import hashlib

import pytest
from pyspark.sql import functions as F

from curveloom.operators import split
from curveloom.operators.ranking import rank_by_digest


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"e{i % 83}", i) for i in range(500)], "entity_id string, v int")


def _as_set(df):
    return sorted(map(tuple, df.collect()))


def test_rank_is_the_order_of_seeded_digests(rows):
    ids = sorted({f"e{i}" for i in range(83)}, key=lambda i: hashlib.md5(f"42|{i}||0".encode()).hexdigest())
    got = {r["entity_id"]: (r["position"], r["n_ids"]) for r in rank_by_digest(rows, "entity_id", 42).collect()}
    assert got == {e: (n, 83) for n, e in enumerate(ids, 1)}


def test_split_is_disjoint_complete_and_sized(rows):
    labels = split.entity_split(rows, "entity_id").collect()
    sizes = {}
    for r in labels:
        sizes[r["split"]] = sizes.get(r["split"], 0) + 1
    assert sizes == {"test": 17, "validation": 17, "train": 49}
    assert len({r["entity_id"] for r in labels}) == 83
    assert split.split_defects(split.entity_split(rows, "entity_id"), rows, "entity_id").isEmpty()


@pytest.mark.parametrize("n", [1, 3, 16])
def test_split_and_sample_do_not_depend_on_partitions(rows, n):
    moved = rows.repartition(n)
    assert _as_set(split.entity_split(moved, "entity_id")) == _as_set(split.entity_split(rows, "entity_id"))
    assert _as_set(split.sample_entities(moved, "entity_id", 9)) == _as_set(split.sample_entities(rows, "entity_id", 9))


def test_small_tables_fall_back_to_one_and_one(spark):
    tiny = spark.createDataFrame([("a",), ("b",), ("c",)], "entity_id string")
    counts = {r["split"]: r["count"] for r in split.entity_split(tiny, "entity_id", 0.45, 0.45).groupBy("split").count().collect()}
    assert counts == {"test": 1, "validation": 1, "train": 1}


def test_fixed_holdout(rows, spark):
    given = spark.createDataFrame([("e1",), ("e2",)], "entity_id string")
    labels = {r["entity_id"]: r["split"] for r in split.fixed_holdout_split(rows, "entity_id", given).collect()}
    assert {e for e, s in labels.items() if s == "test"} == {"e1", "e2"}
    assert sum(s == "validation" for s in labels.values()) == 16 and len(labels) == 83
    with pytest.raises(ValueError, match="nowhere"):
        split.fixed_holdout_split(
            rows, "entity_id", spark.createDataFrame([("nowhere",)], "entity_id string"), strict=True
        )


def test_argument_checks(rows, spark):
    with pytest.raises(ValueError):
        split.entity_split(rows, "entity_id", 0.6, 0.5)
    with pytest.raises(ValueError):
        split.entity_split(rows.where("entity_id in ('e1', 'e2')"), "entity_id", strict=True)


def test_samples_keep_all_rows_of_an_entity(rows):
    sampled = split.sample_entities(rows, "entity_id", 5)
    kept = {r[0] for r in sampled.select("entity_id").distinct().collect()}
    assert len(kept) == 5
    assert sampled.count() == rows.where(F.col("entity_id").isin(*kept)).count()
    assert split.sample_entities(rows, "entity_id", 1000).count() == 500
    assert split.report_sample(rows, "entity_id", None).count() == 500
    assert split.report_sample(rows, "entity_id", 0).count() == 0


def test_labels_of_rows_and_counts(rows):
    labels = split.entity_split(rows, "entity_id")
    labelled = split.label_rows(rows, labels, "entity_id")
    assert labelled.count() == 500
    counts = {r["split"]: r["n_rows"] for r in split.split_counts(rows, labels, "entity_id").collect()}
    assert counts == {r["split"]: r["count"] for r in labelled.groupBy("split").count().collect()}


def test_hot_entity_gets_its_label(spark):
    from curveloom.operators.skew import attach, find_hot_keys

    big = spark.range(600).select(F.when(F.col("id") < 500, "hot").otherwise(F.col("id").cast("string")).alias("entity_id"))
    labels = split.entity_split(big, "entity_id")
    hot = find_hot_keys(big, ["entity_id"], smallest=100)
    assert hot.any
    joined = attach(big, labels, hot)
    assert joined.count() == 600
    assert _as_set(joined) == _as_set(big.join(labels, "entity_id"))


def test_first_per_entity(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "e string, k int, v string")
    assert _as_set(split.first_per_entity(df, ["e"], ["k"])) == [("a", 1, "y"), ("b", 5, "z")]


def test_all_missing_entities_are_reported(spark):
    from curveloom.operators.quality import MissingEntities, require_catalogued

    rows = spark.createDataFrame([(f"e{i:03d}",) for i in range(60)], "entity_id string")
    with pytest.raises(MissingEntities, match="50 entities") as error:
        require_catalogued(rows, rows.where("entity_id < 'e010'"), "entity_id")
    assert error.value.table.count() == error.value.n == 50
