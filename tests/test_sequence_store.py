import random
from datetime import date, timedelta

import pytest

from tidepanel.operators import sequences as sq
from tidepanel.operators.sequence_store import read_store, store_sequences
from tidepanel.schemas import DataContractError

SCHEMA = "code string, trade_date date, label double, is_member boolean, is_tradable boolean, x double, y double, block string"


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(4)
    rows = []
    for code, n in {"a": 1, "b": 4, "c": 5, "d": 23, "e": 24, "f": 25, "g": 211}.items():
        days = sorted(rng.sample(range(400), n))
        rows += [
            (code, date(2024, 1, 1) + timedelta(days=d), rng.choice([None, 0.1, float("nan"), float("inf"), 0.2]), rng.random() < 0.8, rng.random() < 0.9,
             rng.choice([None, float(d)]), rng.random(), "clash")
            for d in days
        ]
    return spark.createDataFrame(rows, SCHEMA).drop("block").repartition(4)


def rows(df):
    return sorted(((r.code, r.trade_date, [tuple(x) for x in r.seq]) for r in df.collect()), key=str)


@pytest.mark.parametrize("length, block", [(5, None), (5, 5), (1, 1), (1, 7), (24, 24), (3, 100)])
def test_blocks_give_the_same_windows(spark, panel, tmp_path, length, block):
    made = store_sequences(panel, ["x", "y"], length, block)
    made.write(str(tmp_path))
    store = read_store(spark, str(tmp_path), length)
    day = panel.agg({"trade_date": "max"}).first()[0]
    assert rows(store.expand()) == rows(sq.sliding_windows(panel, ["x", "y"], length).where("seq is not null"))
    assert rows(store.sliding_sequences()) == rows(sq.sliding_sequences(panel, ["x", "y"], length))
    assert rows(store.all_labelled_sequences(2)) == rows(sq.all_labelled_sequences(panel, ["x", "y"], length, 2))
    assert rows(store.inference_sequences(day)) == rows(sq.inference_sequences(panel, ["x", "y"], length, day))


def test_store_takes_less_than_twice_the_panel(spark, tmp_path):
    def size(path):
        return sum(p.stat().st_size for p in path.rglob("*.parquet"))

    days = spark.range(4 * 2000).selectExpr(
        "string(id % 4) AS code", "date_add(date'2000-01-01', int(id div 4)) AS trade_date", "rand(1) AS label", *[f"rand({i + 2}) AS f{i}" for i in range(8)]
    )
    features = [f"f{i}" for i in range(8)]
    days.write.parquet(str(tmp_path / "panel"))
    store_sequences(days, features, 60).write(str(tmp_path / "store"))
    assert size(tmp_path / "store") < 2 * size(tmp_path / "panel")


def test_one_shuffle_lays_a_panel_out(panel):
    for df in (store_sequences(panel, ["x"], 3).blocks, store_sequences(panel, ["x"], 3).ends):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(code") == 1 and plan.count("hashpartitioning") == 1


def test_refusals_and_empty_panel(spark, panel):
    with pytest.raises(DataContractError):
        store_sequences(panel, ["x"], 3, 2)
    with pytest.raises(DataContractError):
        store_sequences(panel, ["x"], 3).inference_sequences(date(1999, 1, 1))
    empty = store_sequences(panel.limit(0), ["x"], 3)
    assert empty.blocks.collect() == [] and empty.expand().collect() == []
