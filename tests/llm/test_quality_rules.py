import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidepanel.llm import quality_rules as q

SCHEMA = "doc_id long, text string, n_words string"


def brute(text):
    text = text or ""
    parts = text.encode().split()
    windows = [tuple(parts[i : i + 5]) for i in range(len(parts) - 4)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return (len(parts), sum(len(x.decode()) for x in parts), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))


def texts():
    rng = random.Random(2)
    out = ["", None, "\n", "\n\na\n\na\na", "a b c d e a b c d e", "x" * 3000, "é# *\t|<>&%$", " a\n a\na \n"]
    for _ in range(200):
        out.append("".join(rng.choice(["ab", "c", "é", " ", " ", "\n", "#"]) for _ in range(rng.randint(0, 60))))
    return out


def test_counts_equal_brute_force(spark):
    rows = texts()
    forest = q.fit(np.zeros((1, len(q.FEATURES))), np.ones(1), list(q.FEATURES.values()), trees=0)
    got = q.judge(spark.createDataFrame([(i, t, "") for i, t in enumerate(rows)], SCHEMA).repartition(3), forest).collect()
    assert len(got) == len(rows)
    for r in got:
        n, *_, repeat = want = brute(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert r.kept == (not r.base_failed)


def test_trees_learn_and_keep_constraints():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.random(4000) < 0.7).astype(float)
    forest = q.fit(x[:3000], y[:3000], [-1, 0, 0])
    p = forest.score(x[3000:])
    assert ((p >= 0.5) == y[3000:]).mean() > 0.9
    probe = np.repeat(rng.random((50, 3)), 60, axis=0)
    probe[:, 0] = np.tile(np.linspace(0, 1, 60), 50)
    assert (np.diff(forest.score(probe).reshape(50, 60), axis=1) <= 1e-12).all()
    free = q.fit(x[:3000], y[:3000], [0, 0, 0])
    assert (np.diff(free.score(probe).reshape(50, 60), axis=1) > 1e-12).any()


def test_held_out_accuracy_on_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("n_chars", "n_words")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    forest = q.train(docs, labels.where("doc_id % 3 <> 0"))
    held_out = labels.where("doc_id % 3 = 0").select("doc_id", F.col("quality").alias("label"))
    rows = q.judge(docs, forest).join(held_out, "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == r.label for r in rows]) > 0.9


def test_no_labels_and_empty_table(spark):
    labels = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(None, " ".join(map(str, range(20))), "")], SCHEMA)
    forest = q.train(docs, labels)
    assert [r.kept for r in q.judge(docs, forest).collect()] == [True]
    assert q.judge(spark.createDataFrame([], SCHEMA), forest).collect() == []
