import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np

from tidepanel.llm import pitman_yor as py

SCHEMA = "doc_id long, text string, score string"


def brute_base(rows):
    """Token counts and add-one scores, from plain Python counters."""
    def tokens(text):
        return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split() + [None]

    train = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    out = {}
    for i, t in rows:
        own = tokens(t)
        out[i] = (len(own), sum(train[x] > 0 for x in own), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in own))
    return out


def corpus(n=250):
    rng = random.Random(8)
    words = [f"Wo{i}" for i in range(40)] + [f"r{i}é" for i in range(400)]
    rows = []
    for i in range(n):
        text, at = [], 0
        for _ in range(rng.randint(0, 60)):
            at = (at * 3 + rng.choice([1, 1, 1, 2])) % 40 if rng.random() < 0.8 else rng.randrange(len(words))
            text.append(words[at])
            at %= 40
        rows.append((i, rng.choice([" ", "\n"]).join(text)))
    return rows + [(900, None), (901, ""), (902, "the the " * 300)]


def test_base_equals_brute_force_and_model_beats_it(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA).repartition(4)
    for size in (py.GROUP, 500):  # in few groups, and in many with frequent words dealt by pair
        got = py.score(df, group_bytes=size).collect()
        want = brute_base(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
            assert abs(r.base_score - want[r.doc_id][3]) < 1e-6
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)  # log scores are negative
        assert all(r.score < 0 for r in got)


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(5)
    customers = rng.integers(1, 9, 50)
    tables = np.minimum(customers, rng.integers(1, 4, 50))
    t = py.Totals(500, 50, 0.7, 1.0, 0.6, 2.0, np.zeros(1), np.zeros(1), float(customers.sum()), float(tables.sum()))
    assert abs(t.root(customers, tables).sum() + t.root(np.zeros(1), np.zeros(1))[0] - 1) < 1e-12
    # texts of one word, an unknown one and the empty text are disjoint events
    train = [(i, t, "") for i, t in corpus(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    known = sorted({x.lower() for _, t, _ in train for x in (t or "").split()})
    ids = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = [(i, x, "") for i, x in zip(ids, [*known, "unknown", ""])]
    got = {r.doc_id: r.score for r in py.score(spark.createDataFrame(train + probes, SCHEMA)).collect()}
    assert 0 < sum(10 ** got[i] for i, _, _ in probes) < 1


def test_moves_keep_customers_and_reach_the_right_distribution():
    rng = np.random.default_rng(3)
    d, weight, n = 0.6, 0.9, 40_000
    slots = np.full(n, 3)
    sizes = np.tile([3, 0, 0], n).astype(np.int64)
    py.reseat(sizes, slots, np.full(n, weight), d, 40, rng)
    table = np.sort(sizes.reshape(n, 3), axis=1)
    assert (table.sum(axis=1) == 3).all()
    # seatings of three customers: weight**tables times the rising factorials of 1 - d
    odds = {(0, 0, 3): weight * (1 - d) * (2 - d), (0, 1, 2): 3 * weight**2 * (1 - d), (1, 1, 1): weight**3}
    total = sum(odds.values())
    for seating, x in odds.items():
        assert abs((table == seating).all(axis=1).mean() - x / total) < 0.01


def test_nulls_repeats_and_empty_table(spark):
    rows = [(None, "a b", ""), (1, "a b", ""), (1, "a b", ""), (1, "a c", ""), (3, None, "")]
    got = py.score(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 3), (1, 3), (1, 3), (1, 3), (3, 1)]
    assert len({round(r.score, 9) for r in got if r.doc_id == 1}) == 2
    assert py.score(spark.createDataFrame([], SCHEMA)).collect() == []


def exact_odds(n, weight, d):
    """Odds of the number of tables of n customers, by the recursion over customers."""
    row = np.zeros(1)
    for m in range(1, n):
        joins = row + np.log(m - d * np.arange(1, m + 1))
        row = np.concatenate((joins[:1], np.logaddexp(joins[1:], row[:-1]), row[-1:]))
    odds = row + np.arange(1, n + 1) * math.log(weight)
    odds = np.exp(odds - odds.max())
    return odds / odds.sum()


def test_small_cells_are_drawn_by_the_odds():
    for n, d, weight in ((2, 0.3, 0.7), (50, 0.6, 9.0), (900, 0.8, 0.4)):
        want = exact_odds(n, weight, d)
        got = np.bincount(py.draw(np.full(20_000, n), np.full(20_000, weight), d, np.random.default_rng(n)), minlength=n + 1)[1:] / 20_000
        assert np.abs(got - want).max() < 0.02


def test_odds_of_tables_of_large_cells_equal_the_recursion():
    for n in (700, 3000):
        for d in (0.1, 0.5, 0.8, 0.95):
            for weight in (1e-6, 0.05, 2.0, 60.0, 5000.0):
                want = exact_odds(n, weight, d)
                k, odds = py.table_odds(n, weight, d)
                got = np.zeros(n)
                got[k - 1] = odds / odds.sum()
                assert np.abs(got - want).max() < 1e-8, (n, d, weight, np.abs(got - want).max())


def test_a_round_seats_large_cells_and_words_as_a_whole():
    n, d, m = 3000, 0.7, 200
    ones = np.ones(m, np.int64)
    words = np.arange(1, m + 1, dtype=np.uint64)
    totals = py.Totals(m * n, m, d, 60.0, 0.5, 1.0, np.zeros(py.CONTEXTS), np.zeros(py.CONTEXTS), float(m), float(m))
    row = dict(
        part=0, names=words.tobytes(), singles=py.w.narrow(4000 * ones), totals=py.w.narrow((n + 4000) * ones), words=words.tobytes(),
        cells=py.w.narrow(ones), contexts=np.zeros(m, np.uint16).tobytes(), counts=py.w.narrow(n * ones),
    )
    (after,) = py._round(iter([py.pa.RecordBatch.from_pylist([row])]), totals, 0, True)
    tables, roots = np.frombuffer(next(py._rows_of(after)).samples, np.int32).reshape(2, m)
    cell = exact_odds(n, 60.0 * totals.root(4001 * np.ones(1), np.ones(1))[0], d)
    word = exact_odds(4000 + int(np.median(tables)), (1.0 + 0.5 * m) / (m + 1), 0.5)
    for got, odds in ((tables, cell), (roots, word)):
        k = np.arange(1, len(odds) + 1)
        mean = odds @ k
        assert abs(got.mean() - mean) < 5 * math.sqrt((odds @ k**2 - mean**2) / m)


def test_scores_keep_their_digits(spark):
    rows = [(i, t, "") for i, t in corpus(60)]
    got = [r.score for r in py.score(spark.createDataFrame(rows, SCHEMA)).collect() if r.n_tokens == 1]
    assert len(got) > 1 and all(float(np.float32(x)) != x for x in got)


def packed_group(n_docs, rng, cells):
    """Packed pairs of one group over a few stretches, and its sampled state."""
    words = np.sort(rng.integers(0, 1 << 63, 20_000).astype(np.uint64) * np.uint64(2))
    entries = []
    for s in range(4):
        w_, c_, d_ = rng.choice(words, cells), rng.integers(0, 9, cells).astype(np.uint16), rng.integers(0, n_docs, cells)
        w_, c_, d_, n_ = py._collapsed(w_, c_, d_)
        ids, keys = np.arange(n_docs) * 4 + s, np.zeros(n_docs, np.uint32)
        learnt = np.arange(n_docs) % 3 > 0
        entries.append((0, *py._by_word(w_), c_.tobytes(), py.w.narrow(n_), py.w.narrow(d_), *py._packed_ids(ids, keys), learnt.tobytes()))
    names = np.unique(words)
    some = np.unique(rng.choice(names, 5000))
    tables = np.ones((2, len(some)), np.int32)
    state = [(0, some.tobytes(), np.ones(len(some), np.uint16).tobytes(), tables.tobytes(), names.tobytes(), np.ones((2, len(names)), np.int32).tobytes())]
    return [py.pa.Table.from_batches([py._table(rows, schema)]) for rows, schema in ((entries, py.ENTRIES), (state, py.DEALT))]


class Hot:
    value = (np.zeros(0, np.uint64), np.zeros(0), np.zeros((2, 2, 0)))


def test_a_group_is_scored_by_ranges_of_words(monkeypatch):
    totals = [py.Totals(9000, 900, 0.7, 1.0, 0.6, 2.0, np.full(py.CONTEXTS, 90.0), np.full(py.CONTEXTS, 9.0), 900.0, 500.0)] * 2
    entries, state = packed_group(300, np.random.default_rng(1), 20_000)
    want = py._scored(entries, state, totals, 3, Hot).to_pylist()
    monkeypatch.setattr(py, "SCORED_AT_ONCE", 500)
    got = py._scored(entries, state, totals, 3, Hot).to_pylist()
    assert len(want) == 3
    for a, b in zip(want, got):
        assert [a[c] for c in ("bucket", "ids", "keys", "rows", "n_tokens", "n_known")] == [b[c] for c in ("bucket", "ids", "keys", "rows", "n_tokens", "n_known")]
        for c in ("base", "score"):
            assert np.allclose(np.frombuffer(a[c]), np.frombuffer(b[c]), rtol=1e-12)


def test_memory_of_a_group_is_bounded(monkeypatch):
    totals = [py.Totals(9000, 900, 0.7, 1.0, 0.6, 2.0, np.full(py.CONTEXTS, 90.0), np.full(py.CONTEXTS, 9.0), 900.0, 500.0)] * 2
    entries, state = packed_group(3000, np.random.default_rng(2), 400_000)
    peaks = []
    for at_once in (py.SCORED_AT_ONCE, 1 << 40):
        monkeypatch.setattr(py, "SCORED_AT_ONCE", at_once)
        tracemalloc.start()
        py._scored(entries, state, totals, 3, Hot)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert 3 * peaks[0] < peaks[1], peaks


def held_out_ids():
    return (i for i in range(10_000, 90_000) if zlib.crc32(str(i).encode()) % 7 == 2)


def test_words_of_equal_remainders_are_contexts_of_their_own(spark):
    seen, pair = {}, None
    for i in range(3000):
        text = np.frombuffer(f"word{i}".encode(), np.uint8)
        at = int(py.w.slice_hashes(text, np.array([0]), np.array([len(text)]))[0] % np.uint64(py.CONTEXTS))
        if at in seen:
            pair = seen[at], f"word{i}"
            break
        seen[at] = f"word{i}"
    x, y = pair
    learnt = [i for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, f"{x} p" if i % 2 else f"{y} q", "") for i in learnt]
    a, b = (i for i, _ in zip(held_out_ids(), range(2)))
    rows += [(a, f"{x} p", ""), (b, f"{x} q", "")]
    got = {r.doc_id: r.score for r in py.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[a] > got[b] + 1, (got[a], got[b])


def test_scores_equal_brute_force_where_no_draw_is_free(spark):
    """A text of words that stand once: every cell, context and word has one table."""
    words = [f"u{i}" for i in range(400)]
    rng = random.Random(2)
    probes = [" ".join(rng.choice(words + ["new", "other"]) if rng.random() < 0.5 else words[rng.randrange(399) + 1] for _ in range(rng.randint(0, 8))) for _ in range(40)]
    probes += [" ".join(words[i : i + 5]) for i in range(0, 390, 13)] + [" ".join(words[-3:]), words[0]]
    held = dict(zip(held_out_ids(), probes))
    rows = [(4, " ".join(words), "")] + [(i, t, "") for i, t in held.items()]
    assert zlib.crc32(b"4") % 7 != 2
    v, d = 401, 0.95  # with the end of the text
    after = {None: words[0]} | dict(zip(words, [*words[1:], "end"]))
    unknown = (1 + d * v) / (v + 1) / (1 + v)

    def log_p(context, word):
        parent = unknown + (1 - d) / (1 + v) * (word in words or word == "end")
        if context not in after:
            return math.log10(parent)
        return math.log10(((1 - d) * (after[context] == word) + (1 + d) * parent) / 2)

    for size in (py.GROUP, 500, 20):  # in the last, all words are frequent
        got = {r.doc_id: r.score for r in py.score(spark.createDataFrame(rows, SCHEMA).repartition(3), group_bytes=size).collect()}
        for i, t in held.items():
            chain = [None, *t.split(), "end"]
            assert abs(got[i] - sum(map(log_p, chain, chain[1:]))) < 1e-9, (size, t)
