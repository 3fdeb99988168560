import random
from collections import Counter
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidepanel.operators import features as ft
from tidepanel.operators import regime as rg
from tidepanel.plans.checked_join import checked_join
from tidepanel.plans.permutation import permuted, unpermuted
from tidepanel.schemas import DataContractError


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"k int, d int, {name} string").repartition(3)


def test_counts_and_rows_of_a_clean_join(spark):
    left = frame(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")], "x")
    right = frame(spark, [(1, 2, "B"), (2, 1, "C"), (9, 9, "Z"), (None, 1, "N")], "y")
    joined, counts = checked_join(left, right, ["k", "d"])
    assert sorted(joined.collect(), key=str) == sorted(left.join(right, ["k", "d"], "left").collect(), key=str)
    assert counts == {"left": 4, "right": 4, "matched": 2}
    assert checked_join(left, right, ["k", "d"], how="inner")[0].count() == 2
    assert checked_join(left.limit(0), right.limit(0), ["k", "d"])[1] == {"left": 0, "right": 0, "matched": 0}


@pytest.mark.parametrize("validate, left_ok, right_ok", [("one_to_one", False, False), ("many_to_one", True, False), ("one_to_many", False, True)])
def test_repeated_keys_are_refused_on_the_side_that_must_be_unique(spark, validate, left_ok, right_ok):
    one, twice = [(1, 1, "a"), (2, 1, "b")], [(1, 1, "a"), (2, 1, "b"), (2, 1, "c")]
    unmatched = [(1, 1, "a"), (7, 7, "u"), (7, 7, "v")]
    for rows in (twice, unmatched):
        for ok, left, right in ((left_ok, rows, one), (right_ok, one, rows)):
            args = frame(spark, left, "x"), frame(spark, right, "y"), ["k", "d"], validate
            if ok:
                assert checked_join(*args)[0].count() >= 2
            else:
                with pytest.raises(DataContractError, match="repeated"):
                    checked_join(*args)


def test_checks_share_the_shuffle_of_the_join(spark, monkeypatch):
    plans = []
    monkeypatch.setattr("tidepanel.plans.checked_join.stage", lambda df, _: plans.append(df) or df)
    monkeypatch.setattr("pyspark.sql.Observation.get", {"n": 0, "most": 1})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, i, "a") for i in range(50)]
        checked_join(frame(spark, rows, "x"), frame(spark, rows, "y"), ["k", "d"])
        plan = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_audit_columns_are_restored_and_repeats_refused(spark):
    schema = "code string, trade_date date, label double, is_member boolean, x double"
    rows = [(c, date(2024, 1, 1) + timedelta(days=i), None if i % 2 else 0.5, i % 3 == 0, float(i)) for c in "ab" for i in range(6)]
    panel = spark.createDataFrame(rows, schema)
    filled = panel.fillna(0.0, ["label"]).withColumns({"is_member": F.lit(True), "f": F.col("x") + 1})
    back = ft.restore_audit_columns(filled, panel)
    assert sorted((r.code, r.trade_date, r.label, r.is_member, r.x) for r in back.collect()) == sorted(rows, key=lambda r: r[:2])
    for broken in ((filled.unionAll(filled.limit(1)), panel), (filled, panel.unionAll(panel.limit(1)))):
        with pytest.raises(DataContractError):
            ft.restore_audit_columns(*broken)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations_hold_every_place_once_and_can_be_undone(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), F.lit("key")).alias("p"))
    rows = rows.withColumn("back", unpermuted(F.col("p"), F.lit(n), F.lit("key"))).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 97:
        assert sum(r.p == r.id for r in rows) < n / 10
        other = spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit("other")).alias("p")).collect()
        assert [r.p for r in rows] != [r.p for r in other]


@pytest.mark.parametrize("sizes, share", [((10, 60, 30), 0.3), ((60, 10, 5), 0.2), ((1, 1, 0), 0.5), ((5, 0, 20), 0.9)])
def test_draws_take_every_date_before_any_repeats(spark, sizes, share):
    states = [s for s, n in zip(rg.STATES, sizes) for _ in range(n)]
    random.Random(1).shuffle(states)
    days = [(date(2024, 1, 1) + timedelta(days=i), s) for i, s in enumerate(states)]
    drawn, audit = rg.stratified_sample(spark.createDataFrame(days, "trade_date date, market_state string"), share, seed=3, epoch=1)
    found, told = drawn.collect(), audit.first()
    counts, targets = Counter(states), rg.draw_targets(Counter(states), share)
    assert sorted(r.draw for r in found) == list(range(1, len(days) + 1))
    assert dict(days) == dict(days) | {r.trade_date: r.market_state for r in found}
    for s in rg.STATES:
        times = Counter(r.trade_date for r in found if r.market_state == s)
        assert sum(times.values()) == targets[s] == told[f"{s}_draws"]
        assert len(times) == min(targets[s], counts[s])
    assert told.sampled_dates == [r.trade_date for r in sorted(found, key=lambda r: r.draw)]
