import random

from tidepanel.llm import decontamination as d

SCHEMA = "doc_id long, text string, item_id string"


def least_distance(pattern, text):
    """Edit distance of the pattern to the closest part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, c in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (p != c))
    return min(row)


def test_bit_parallel_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        best, end = d.closest(d._masks(p), len(p), t, len(p))
        want = least_distance(p, t)
        assert best == want if want < len(p) + 1 and t else best >= want
        if end > 0:
            assert min(least_distance(p, t[:end]), len(p)) == min(want, len(p))


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + rng.randint(0, 1)] = [rng.choice("xyz")] * rng.randint(0, 1)
    return "".join(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(12)] + [(50, ""), (51, None), (None, "x y"), (52, "?!")]
    rows = []
    for i in range(150):
        text = " ".join(word() for _ in range(rng.randint(0, 30)))
        if i % 2:
            item = rng.choice(items[:12])[1]
            text += " " + edited(rng, item.upper().replace(" ", rng.choice([", ", "\n", " - "])), int(len(item) * rng.choice([0, 0.05, 0.08, 0.15])))
            text += " " + " ".join(word() for _ in range(rng.randint(0, 30)))
        rows.append((i, text, "clash"))
    rows += [(900, None, ""), (901, "", ""), (None, items[0][1], "")]
    found = d.judge(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string"), block_items=5)
    got = {(r.doc_id, h.item_id): h for r in found.collect() for h in r.hits}
    want = {}
    for doc, text, _ in rows:
        for item, pattern in items:
            if item is not None and (p := d.normalise(pattern)):
                distance = least_distance(p, d.normalise(text))
                if distance <= int(len(p) * 0.08):
                    want[doc, item] = distance
    assert {k: h.distance for k, h in got.items()} == want
    for (doc, item), h in got.items():
        part = d.normalise(next(t for i, t, _ in rows if i == doc))[h.start : h.end]
        assert least_distance(d.normalise(dict(items)[item]), part) == h.distance


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert d.judge(docs, items).collect() == []
    assert d.judge(spark.createDataFrame([(1, "a", "")], SCHEMA), items).collect()[0].hits == []


def test_calls_of_one_session_keep_their_own_items(spark, monkeypatch):
    # Addresses of dead objects come again; here all objects have the same.
    monkeypatch.setattr(d, "id", lambda _: 7, raising=False)
    docs = spark.createDataFrame([(1, "one two three four five six", ""), (2, "seven eight nine tan eleven", "")], SCHEMA).coalesce(1)
    tables = [spark.createDataFrame([x], "item_id long, text string") for x in [(10, "two three four five"), (20, "eight nine ten eleven")]]
    for items, rate, want in [(tables[0], 0.08, [(1, 10)]), (tables[1], 0.08, [(2, 20)]), (tables[1], 0.0, []), (tables[0], 0.0, [(1, 10)])]:
        assert [(r.doc_id, h.item_id) for r in d.judge(docs, items, rate=rate).collect() for h in r.hits] == want
