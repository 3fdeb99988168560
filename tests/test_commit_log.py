import time

import pytest

from tidepanel.schemas import DataContractError
from tidepanel.streaming import upsert
from tidepanel.streaming.commit_log import CommitLog, Manifest

SCHEMA, KEYS = "code string, x long", ("code",)


def rows(df):
    return sorted((r.code, r.x) for r in df.collect())


@pytest.fixture
def target(tmp_path):
    return str(tmp_path / "t")


def batch(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_an_empty_target_reads_as_empty(spark, target):
    with pytest.raises(DataContractError, match="no table"):
        upsert.read_target(spark, target, KEYS)
    upsert.create_target(spark, target, batch(spark).schema)
    upsert.create_target(spark, target, batch(spark).schema)
    found = upsert.read_target(spark, target, KEYS)
    assert found.collect() == [] and found.schema == batch(spark).schema
    assert upsert.fold(spark, target, KEYS).folders == ()


def test_a_reader_from_before_a_fold_finishes_after_it(spark, target):
    merge = upsert.merge_batch(target, KEYS, fold_every=100)
    for i in range(4):
        merge(batch(spark, ("a", i), (f"k{i}", i)), i)
    before = upsert.read_target(spark, target, KEYS)
    want = rows(upsert.read_target(spark, target, KEYS))
    upsert.fold(spark, target, KEYS)
    merge(batch(spark, ("a", 99)), 4)
    assert upsert.expire(spark, target, 3600) == []
    assert rows(before) == want and ("a", 3) in want
    assert ("a", 99) in rows(upsert.read_target(spark, target, KEYS))
    assert rows(upsert.read_target(spark, target, KEYS, upto=1)) == [("a", 1), ("k0", 0), ("k1", 1)]


def test_retried_batches_count_once(spark, target):
    merge = upsert.merge_batch(target, KEYS, fold_every=2)
    for i, x in ((0, 1), (0, 1), (1, 2), (1, 2), (0, 1), (2, 3)):
        merge(batch(spark, ("a", x)), i)
    log = CommitLog(spark, target)
    assert rows(upsert.read_target(spark, target, KEYS)) == [("a", 3)]
    assert [log.read(n).batch for n in log.numbers()] == [-1, 0, 1, 1, 2]


def test_rows_of_a_lost_attempt_are_never_read(spark, target, tmp_path):
    merge = upsert.merge_batch(target, KEYS)
    merge(batch(spark, ("a", 1)), 0)
    batch(spark, ("a", 7)).write.parquet(f"{target}/delta/lost")
    assert rows(upsert.read_target(spark, target, KEYS)) == [("a", 1)]
    merge(batch(spark, ("b", 2)), 1)
    assert rows(upsert.read_target(spark, target, KEYS)) == [("a", 1), ("b", 2)]


def test_expiry_by_age_keeps_what_the_newest_manifest_names(spark, target):
    merge = upsert.merge_batch(target, KEYS, fold_every=100)
    for i in range(3):
        merge(batch(spark, ("a", i)), i)
    upsert.fold(spark, target, KEYS)
    batch(spark, ("z", 0)).write.parquet(f"{target}/delta/lost")
    log = CommitLog(spark, target)
    assert log.expire(60, now=time.time()) == []
    gone = log.expire(60, now=time.time() + 3600)
    assert len([g for g in gone if g.startswith("delta/")]) == 4 and len(log.numbers()) == 1
    assert rows(upsert.read_target(spark, target, KEYS)) == [("a", 2)]
    with pytest.raises(DataContractError, match="expired"):
        upsert.read_target(spark, target, KEYS, upto=0)
    assert log.expire(60, now=time.time() + 3600) == []


def test_two_writers_cannot_commit_the_same_manifest(spark, target):
    upsert.create_target(spark, target, batch(spark).schema)
    one, two = CommitLog(spark, target), CommitLog(spark, target)
    before = one.last()
    one.commit(before, batch=0)
    with pytest.raises(DataContractError, match="another writer"):
        two.commit(before, batch=5)
    assert two.last().batch == 0 and Manifest().folders == ()
