import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidepanel.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic string"


def test_block_max_search_is_exact():
    rng = np.random.default_rng(2)
    n, m = 700, 60
    rows = []
    for i in range(n):
        own = np.sort(rng.choice(m, rng.integers(0, 8), replace=False))
        rows.append((i, int(rng.random() < 0.4), own.tolist(), rng.integers(1, 4, len(own)).tolist()))
    table = pd.DataFrame(rows, columns=["doc_id", "toxic", "terms", "counts"])
    index = t.build(table, {}, rng.random(m) + 0.5, 10, 0.4)
    dense = np.zeros((len(index.docs), m))
    by_id = table.set_index("doc_id")
    for i, doc in enumerate(index.docs):
        at, c = np.array(by_id.loc[doc, "terms"]), np.array(by_id.loc[doc, "counts"])
        dense[i, at] = index.weights(at, c)
    for _ in range(200):
        at = np.sort(rng.choice(m, rng.integers(1, 9), replace=False))
        weight = index.weights(at, rng.integers(1, 4, len(at)))
        sims = np.round(dense[:, at] @ weight, 12)
        want = np.lexsort((np.arange(len(sims)), -sims))[:10]
        docs, got = index.nearest(at, weight)
        keep = sims[want] > 0
        assert docs.tolist() == want[keep].tolist()
        assert np.allclose(got, sims[want][keep])


def test_isotonic_rises_and_keeps_means():
    x = np.arange(50.0)
    y = (np.sin(x) + x / 25 > 1).astype(float)
    xs, ys = t.isotonic(x, y)
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys.min() and ys.max() < 1


def test_held_out_accuracy_on_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", F.lit("clash").alias("toxic"))
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    index = t.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = labels.where("doc_id % 4 = 0").select("doc_id", F.col("toxic").alias("label"))
    rows = t.score(docs, index).join(held, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in rows)
    hit = [(r.score >= 0.5, r.label == 1) for r in rows]
    assert np.mean([a == b for a, b in hit]) > 0.95
    assert sum(a and b for a, b in hit) / sum(b for _, b in hit) > 0.75
    assert all(len(r.evidence) for r in rows if r.score >= 0.5)


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame([(None, None, ""), (1, "", ""), (2, "a b", ""), (2, "a b", "")], SCHEMA)
    index = t.fit(docs, spark.createDataFrame([(None, 1), (2, None), (2, 1)], "doc_id long, toxic int"))
    assert [r.score for r in t.score(docs, index).collect()] == [0.0] * 4
    assert t.score(spark.createDataFrame([], SCHEMA), index).collect() == []
