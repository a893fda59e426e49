import pandas as pd
import pytest

from curveloom.operators.ordered import (
    OrderedRows, following, last_known, next_known, number, previous,
)
from curveloom.operators.skew import find_hot_keys


def _expected(df: pd.DataFrame) -> pd.DataFrame:
    parts = []
    for _, g in df.sort_values(["curve", "t", "id"]).groupby("curve"):
        g = g.copy()
        g["n"] = range(1, len(g) + 1)
        g["before"], g["after"] = g["y"].shift(1), g["y"].shift(-1)
        g["seen"], g["coming"] = g["sparse"].ffill(), g["sparse"].bfill()
        parts.append(g)
    return pd.concat(parts).sort_values(["curve", "id"]).reset_index(drop=True)


@pytest.mark.parametrize("smallest", [10_000, 50])
def test_ordered_values_match_pandas(skewed, smallest):
    hot = find_hot_keys(skewed, ["curve"], smallest=smallest)
    assert hot.any == (smallest == 50)
    got = OrderedRows(skewed, ["curve"], ["t", "id"], hot).add(
        n=number(), before=previous("y"), after=following("y"),
        seen=last_known("sparse"), coming=next_known("sparse"),
    ).toPandas().sort_values(["curve", "id"]).reset_index(drop=True)
    expected = _expected(skewed.toPandas())
    pd.testing.assert_frame_equal(got[expected.columns], expected, check_dtype=False)


def test_hot_group_is_cut_into_blocks(skewed):
    hot = find_hot_keys(skewed, ["curve"], smallest=50)
    assert [r["curve"] for r in hot.table.collect()] == ["big"]
    ordered = OrderedRows(skewed, ["curve"], ["t", "id"], hot)
    blocks = ordered._with_blocks()
    sizes = blocks.where("curve = 'big'").groupBy("_block").count().toPandas()["count"]
    assert len(sizes) > 8 and sizes.max() < 300
    # Only hot rows are stored and cut; the others stay as they are.
    assert blocks.where("curve <> 'big'").isEmpty()
    assert {r["curve"] for r in ordered.cold.select("curve").distinct().collect()} == {"mid", "one"}


def test_no_hot_keys_without_large_groups(skewed):
    assert not find_hot_keys(skewed, ["curve", "id"], smallest=50).any
    assert not find_hot_keys(skewed.limit(0), ["curve"], smallest=1).any


def test_lineage_is_cut_in_the_shared_folder(spark, skewed):
    from curveloom.operators.skew import cut_lineage

    folder = spark.conf.get("spark.checkpoint.dir")
    assert folder and spark.sparkContext.getCheckpointDir().startswith(f"file:{folder}")
    kept = cut_lineage(skewed)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" in plan and kept.count() == 941


def test_a_hot_key_has_a_row_budget_whatever_the_total(spark, monkeypatch):
    from curveloom.operators import skew

    rows = spark.range(3000).selectExpr("id % 2 AS k")
    assert not skew.find_hot_keys(rows, ["k"], smallest=2000).any
    monkeypatch.setattr(skew, "TASK_ROWS", 1000)
    monkeypatch.setattr(skew, "HOT_KEYS_PER_PARTITION", 0.0001)
    found = skew.find_hot_keys(rows, ["k"], smallest=10)
    assert found.rows_per_block == 1000 and found.table.count() == 2
    monkeypatch.setattr(skew, "MOST_BROADCAST_KEYS", 1)
    many = skew.find_hot_keys(rows, ["k"], smallest=10)
    assert not many.few and many.table.count() == 2
