import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import fill_middle

SCHEMA = "doc_id long, text string, output string, form string, n string"


def expected(doc_id, text):
    """The contract over Python strings, text by text."""
    text = text or ""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_boundary_set_agrees_with_a_sorted_list():
    rng = np.random.default_rng(5)
    sets = [
        np.arange(200_000),  # runs
        np.flatnonzero(rng.random(300_000) < 0.5),  # bitmaps
        np.flatnonzero(rng.random(300_000) < 0.01),  # arrays
        np.concatenate((np.arange(70_000), 70_000 + 3 * np.arange(90_000), [5_000_000])),  # all, and missing chunks
        np.array([0]),
        np.array([65_535, 65_536, 131_071]),
    ]
    kinds = set()
    for offsets in sets:
        found = fill_middle.BoundarySet(offsets)
        kinds |= {type(c).__name__ for c in found.containers}
        ordinals = rng.integers(0, len(offsets), 3000)
        assert len(found) == len(offsets)
        assert (found.select(ordinals) == offsets[ordinals]).all()
        asked = rng.integers(0, offsets[-1] + 200_000, 3000)
        assert (found.rank(asked) == np.searchsorted(offsets, asked)).all()
    assert kinds == {"_Array", "_Bitmap", "_Runs"}


def test_same_as_cutting_strings_and_exact_round_trip(spark):
    rng = random.Random(8)
    letters = "ab <>PSM\n\té世😀"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += [None, "", "<P>", "x<M>", "<S", ">", "<", "<P", "😀", "P><S", "é" * 70_000, "a" * 300_000, "aé世😀" * 50_000]
    rows = [(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)]
    rows += [(7, texts[7], None, None, None), (7, "another text of this id", "", "", ""), (None, "no id", "", "", ""), (-3, "below zero", "", "", "")]
    made = fill_middle.transform(spark.createDataFrame(rows, SCHEMA).repartition(3), stretch=4000)
    found = made.withColumn("restored", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((d, *expected(d, t), t or "") for d, t, *_ in rows), key=str)
    assert sorted((tuple(r) for r in found), key=str) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("changed, spm, form", [(0, 50, "plain"), (100, 0, "psm"), (100, 100, "spm")])
def test_shares(spark, changed, spm, form):
    rows = spark.createDataFrame([(i, "some text") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fill_middle.transform(rows, changed=changed, spm=spm).collect()} == {form}


def test_empty_table(spark):
    assert fill_middle.transform(spark.createDataFrame([], SCHEMA)).collect() == []
