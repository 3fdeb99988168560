import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, h string, n string, score string"


def pieces_of(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [p for p in (re.findall(r"[^\x20\x09]+", x) for x in re.split(r"[.,;:!?\x0a-\x0d]", lower)) if p]


def expected(rows, longest, least, covered, best):
    """The contract, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for lang, found in f.items():
        frequent = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= covered * a and inside(q) for q, b in frequent.items()):
                continue
            cuts = [(1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p))]
            score, k, l, r = min(cuts)
            left = sum(q[1:] == p for q in frequent)
            right = sum(q[:-1] == p for q in frequent)
            scored.append((-score, -a, " ".join(p).encode(), (" ".join(p), a, l, r, n[lang], score, k, left, right)))
        out |= {(lang, i + 1): x[3] for i, x in enumerate(sorted(scored)[:best])}
    return out


def result(df):
    names = ["phrase", "a", "l", "r", "n", "score", "k", "left_extensions", "right_extensions"]
    return {(r["lang"], r["rank"]): tuple(r[x] for x in names) for r in df.collect()}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "Ünï", "世", "x#", "-", "é\x0bq", "A.", "c,", "d\n", "e!f", "\t", "  ", "g\x85h", "..", "z"]
    return [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize(
    "longest, least, covered, best, size, broadcast",
    [(5, 4, 100, 2000, 1 << 24, 1 << 20), (5, 4, 100, 2000, 300, 0), (3, 2, 60, 7, 500, 1 << 20), (2, 3, 100, 50, 1 << 24, 0)],
)
def test_same_as_counting_every_phrase(spark, longest, least, covered, best, size, broadcast):
    rows = texts(1, 300) + [("New York, new york! new York city", "en")] * 9 + [(None, "en"), ("", None), (" . ", "fr")]
    rows += [("one long piece " * 3000, "es"), ("ab. cd; " * 4000, "es")]
    df = spark.createDataFrame([(i, t, lang, "clash", "clash", "clash", "clash") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    found = c.collocations(df, longest=longest, least=least, covered=covered, best=best, shard_bytes=size, broadcast_grams=broadcast)
    assert result(found) == expected(rows, longest, least, covered, best)


def test_index_extends_in_both_directions():
    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(0, 5, 400), [0])).astype(np.int32)
    text[:5] = range(5)
    index = c.FMIndex(text[c._suffix_order(text, 4) - 1], np.arange(1, 5, dtype=np.uint64))
    level, names = index.single(), {i: (i,) for i in range(5)}
    for length in range(2, 5):
        longer = index.extend(level)
        names = {i: (int(index.first[s]), *names[int(longer.suffix[i])]) for i, s in enumerate(longer.starts)}
        around = np.concatenate((text, text))
        want = Counter(tuple(around[i : i + length].tolist()) for i in range(len(text)))
        assert {names[i]: int(n) for i, n in enumerate(longer.counts())} == want
        assert [names[i] for i in range(len(names))] == sorted(want)
        assert all((0 not in names[i]) == bool(longer.open[i]) for i in names)
        level = longer


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, [10**13 + 9, 10**13 + 8], [10**13 + 11, 2 * 10**13]), (100, 10**14, [101, 100], [100, 100])]
    df = spark.createDataFrame(rows, "f long, n long, heads array<long>, tails array<long>")
    for row, (f, n, heads, tails) in zip(df.select(F.expr(c.LOWEST).alias("x")).collect(), rows):
        want = min((1000 * f * n // (heads[k - 1] * tails[2 - k]), k) for k in (1, 2))
        assert (row.x.score, row.x.k) == want


@pytest.mark.parametrize("rows", [[], [(1, None, "en", "", "", "", "")], [(1, "word", None, "", "", "", "")]])
def test_tables_without_phrases(spark, rows):
    assert c.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_long_texts_are_cut_between_pieces():
    data = np.frombuffer(b"aa bb.cc dd.ee ff gg hh ii.jj", np.uint8)
    mapped = c._LETTERS[data]
    cut = c._cut(mapped, np.array([0, 4, len(data)]), 6)
    assert set(cut) >= {0, 4, len(data)} and all(x in (0, 4, len(data)) or data[x - 1] == ord(".") for x in cut)
