import random

from tidepanel.llm.substring_dedup import remove_repeats

SCHEMA = "doc_id long, text string, n_words string"


def brute(rows, n):
    """Windows judged one by one, in order of id."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        parts = (text or "").encode().split()
        gone = set()
        for i in range(len(parts) - n + 1):
            window = tuple(parts[i : i + n])
            if window in seen:
                gone.update(range(i, i + n))
            seen.add(window)
        out[doc] = (len(parts), len(gone), b" ".join(x for i, x in enumerate(parts) if i not in gone).decode())
    return out


def result(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    shared = [[rng.choice("abcdef") for _ in range(30)] for _ in range(3)]
    rows = []
    for i in range(300):
        body = [rng.choice(["x", "y", "z", "é", "word"]) + str(rng.randint(0, 60)) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(body))
            body[at:at] = rng.choice(shared)[: rng.randint(18, 30)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(body)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "the same " * 500), (904, "the same " * 40), (905, "a b " * 19)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(5)
    for extra in (0, 8):
        assert result(remove_repeats(df, window=20, check_bytes=extra, group_bytes=3000)) == brute(rows, 20)


def test_intervals_are_maximal(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, text, ""), (2, "start " + text + " end", "")], SCHEMA)
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in remove_repeats(df, window=20).collect()}
    assert got == {1: [], 2: [(1, 51)]}


def test_repeated_rows_ids_and_nulls(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(1, text, ""), (1, text, ""), (2, text + " x", ""), (2, text, ""), (None, text, ""), (None, None, "")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    # Both rows of document 1 are the first occurrence; all others repeat it.
    assert got == [(False, 1, 25, 0), (False, 1, 25, 0), (False, 2, 25, 25), (False, 2, 26, 25), (True, 0, 0, 0), (True, 0, 25, 25)]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
