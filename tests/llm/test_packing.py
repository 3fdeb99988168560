import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidepanel.llm import packing

SCHEMA = "doc_id long, text string, piece string, length string, sequence_id string, task string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.TOKENIZER)


def best_fit_decreasing(counts):
    """Sequences that plain best-fit decreasing opens, piece by piece."""
    capacity, rooms = len(counts) - 1, []
    for length in range(capacity, 0, -1):
        for _ in range(int(counts[length])):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits)[1]] -= length
            else:
                rooms.append(capacity - length)
    return len(rooms)


def covered(plan, capacity):
    out = np.zeros(capacity + 1, np.int64)
    for made, times in plan.configurations:
        assert times > 0 and sum(a * b for a, b in made.items()) <= capacity
        for length, copies in made.items():
            out[length] += copies * times
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=24, max_size=24))
def test_plan_holds_every_piece(counts):
    counts = np.array([0, *counts])
    made = packing.plan(counts, 24)
    assert (covered(made, 24) == counts).all()
    assert made.bound <= made.sequences <= best_fit_decreasing(counts) * 1.05 + 2


def test_plan_of_many_pieces_is_near_the_bound_and_takes_no_longer():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.exponential(90, 30_000).astype(int) + 1, 256)
    counts = np.bincount(lengths, minlength=257)
    one, thousand = packing.plan(counts, 256), packing.plan(counts * 1000, 256)
    assert one.sequences <= 1.001 * one.bound + 1
    assert thousand.sequences <= 1.001 * thousand.bound + 1
    assert (covered(thousand, 256) == counts * 1000).all()


@pytest.mark.parametrize("fixed", [{}, {24: 5}, {13: 7}, {1: 3}, {13: 100, 11: 100}, {8: 30, 9: 1}])
def test_plan_of_few_lengths(fixed):
    counts = np.zeros(25, np.int64)
    for length, n in fixed.items():
        counts[length] = n
    made = packing.plan(counts, 24)
    assert (covered(made, 24) == counts).all()
    assert made.sequences == made.bound or fixed == {8: 30, 9: 1} and made.sequences == made.bound + 1


def test_knapsack_against_all_subsets():
    rng = random.Random(4)
    for _ in range(60):
        items = [(rng.randint(1, 9), rng.randint(0, 3), rng.random()) for _ in range(4)]
        room, best = rng.randint(1, 20), 0.0
        for a in range(4**4):
            take = [a // 4**i % 4 for i in range(4)]
            if all(t <= m for t, (_, m, _) in zip(take, items)) and sum(t * s for t, (s, _, _) in zip(take, items)) <= room:
                best = max(best, sum(t * p for t, (_, _, p) in zip(take, items)))
        sizes, most, prices = (np.array(x) for x in zip(*items))
        copies, value = packing._knapsack(sizes, most, prices, room)
        assert value == pytest.approx(best) == pytest.approx(float((copies * prices).sum()))
        assert (copies <= most).all() and (copies * sizes).sum() <= room


@pytest.mark.parametrize("broadcast_rows", [0, packing.BROADCAST_ROWS])
def test_pieces_ids_and_places(spark, library, broadcast_rows):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "Ünï", "x1", "don't", "\n\n", "世界", "<|endoftext|>", "  "]) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    texts += [None, "", "a b " * 20_000, " " * 400_000 + "x", "same text"] + ["same text"] * 100
    rows = [(None if i % 50 == 9 else i // 2, t, "clash", "clash", "clash", "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    packed = packing.pack(df, capacity=64, keep_ids=True, broadcast_rows=broadcast_rows)
    found = packed.collect()
    by_doc, by_sequence, counts = {}, {}, np.zeros(65, np.int64)
    for r in found:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        assert r.length == 64 or r.piece == 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.piece, r.ids))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        counts[r.length] += 1
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    want = {}
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        cut = len(ids) % 64 or 64
        starts = [0, *range(cut, len(ids), 64)]
        want.setdefault(doc_id, []).extend((s, p, ids[s : (cut if s == 0 else s + 64)]) for p, s in enumerate(starts))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(by_sequence) <= best_fit_decreasing(counts)
    joined = {r.sequence_id: (r.ids, r.starts) for r in packing.sequences(packed).collect()}
    assert sum(len(ids) for ids, _ in joined.values()) == int((counts * np.arange(65)).sum())
    assert all(len(ids) <= 64 and starts[0] == 0 for ids, starts in joined.values())


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
