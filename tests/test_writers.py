import random
from pathlib import Path

import pytest

from tidepanel.schemas import DataContractError
from tidepanel.sources import writers as wr

SCHEMA = "trade_date int, stock_id string, weight double"


def test_files_follow_each_other_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(d, f"{i:04d}", rng.choice([0.2, None])) for d in range(40) for i in range(50)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = str(tmp_path / "out")
        wr.write_ordered(spark.createDataFrame(rows, SCHEMA).repartition(5), path, ["trade_date", "stock_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = spark.read.json(f"{path}.manifest").orderBy("part").collect()
    assert len(manifest) > 1 and sum(m.rows for m in manifest) == len(rows)
    lines = []
    for m in manifest:
        text = (Path(path) / m.file).read_text().splitlines()
        assert text[0] == "trade_date,stock_id,weight" and len(text) == m.rows + 1
        lines += text[1:]
    assert [tuple(x.split(",")[:2]) for x in lines] == [(str(d), s) for d, s, _ in sorted(rows, key=lambda r: r[:2])]
    back = wr.read_ordered(spark, path, SCHEMA)
    assert sorted(tuple(r[c] for c in ("trade_date", "stock_id", "weight")) for r in back.collect()) == sorted(rows)
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        wr.write_ordered(back.drop("part"), path, ["trade_date"])


def test_a_changed_file_is_refused(spark, tmp_path):
    path = str(tmp_path / "out")
    wr.write_result(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5)], SCHEMA), path)
    (Path(path) / "part-99999-extra.csv").write_text("trade_date,stock_id,weight\n1,c,0.1\n")
    with pytest.raises(DataContractError, match="manifest"):
        wr.read_ordered(spark, path, SCHEMA)


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "out")
    wr.write_result(spark.createDataFrame([], SCHEMA), path)
    wr.write_result(spark.createDataFrame([], SCHEMA), path, overwrite=True)
    assert wr.read_ordered(spark, path, SCHEMA).collect() == []
