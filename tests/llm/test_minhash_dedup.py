import random

from tidepanel.llm.graph import components
from tidepanel.llm.minhash_dedup import near_duplicates

SCHEMA = "doc_id long, text string, kept string"


def sets(rows):
    out = {}
    for i, text in rows:
        parts = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        out[i] = {tuple(parts[j : j + 5]) for j in range(len(parts) - 4)} or ({tuple(parts)} if parts else set())
    return out


def brute(rows):
    s = sets(rows)
    label = {i: i for i in s}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(s)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 85 * len(s[a] | s[b]):
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return {i: (len(s[i]), root(i), root(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def text(rng, n):
    return [f"w{rng.randint(0, 3000)}" for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randint(0, 10**6)}"
    return out


def test_equals_brute_force(spark):
    rng = random.Random(11)
    rows, passage = [], text(rng, 40)
    for n, copies, edits in ((300, 30, 8), (80, 40, 2), (40, 30, 1), (8, 20, 1), (200, 90, 3), (600, 6, 20)):
        base = text(rng, n)
        rows += [" ".join(edited(rng, base, rng.randint(0, edits))) for _ in range(copies)]
    chain = text(rng, 200)  # a chain: only neighbours are similar enough
    for _ in range(25):
        chain = edited(rng, chain, 3)
        rows.append(" ".join(chain))
    for _ in range(120):  # a passage that many share, in else different texts
        rows.append(" ".join(text(rng, rng.randint(5, 60)) + passage + text(rng, 20)))
    rows += ["A b  C", "a B c", "a b c d e", "a b c d e f", "", None, " \n", "one", "one", "One"] + ["same text here again " * 30] * 40
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    assert result(near_duplicates(df)) == brute(rows)


def test_long_list_of_strays_is_compared_in_blocks(spark):
    # Two clusters of one family, too far apart for a link, and stragglers between them.
    rng = random.Random(7)
    base = text(rng, 150)
    other = edited(rng, base, 6)
    rows = [edited(rng, base, 1) for _ in range(60)] + [edited(rng, other, 1) for _ in range(50)] + [edited(rng, base, 5) for _ in range(30)]
    rows = list(enumerate(" ".join(x) for x in rows))
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA)
    assert result(near_duplicates(df)) == brute(rows)


def test_null_and_repeated_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(None, t, ""), (5, t, ""), (5, t, ""), (2, t, ""), (None, None, "")], SCHEMA)
    got = sorted(near_duplicates(df).collect(), key=str)
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in got if r.doc_id) == [(2, 2, True), (5, 2, False), (5, 2, False)]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}}


def test_texts_of_a_repeated_id_link_their_components(spark):
    rng = random.Random(11)
    a, b = text(rng, 80), text(rng, 80)
    near = " ".join([*b[:-1], "other"])
    a, b = " ".join(a), " ".join(b)
    rows = [(2, a, ""), (5, a, ""), (5, b, ""), (5, "", ""), (3, near, ""), (7, " ".join(text(rng, 80)), ""), (None, a, ""), (7, "", "")]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (2, 2, True), (3, 2, False), (5, 2, False), (5, 2, False), (5, 2, False), (7, 7, True), (7, 7, True),
    ]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
