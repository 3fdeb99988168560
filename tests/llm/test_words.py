import re

import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import words as w


def texts():
    rng = np.random.default_rng(0)
    letters = list("ab é\n\t\x0b\x1c ")
    out = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(300)]
    return out + ["", None, " ", "x", "long" * 50, "a b " * 60]


@pytest.mark.parametrize("segment", [w.SEGMENT, 64])
def test_words_and_hashes(monkeypatch, segment):
    monkeypatch.setattr(w, "SEGMENT", segment)
    w._powers.cache_clear()
    rows = texts()
    data, offs = w.texts_of(pa.array(rows))
    starts, ends, first = w.bounds(data, offs)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in rows]
    got = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert got == [x for ws in want for x in ws]
    assert np.diff(first).tolist() == [len(ws) for ws in want]
    hashes = w.slice_hashes(data, starts, ends)
    by_word = {}
    for word, h in zip(got, hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    windows, n = {}, 3
    ok = w.inside(first, n)
    values = w.window_hashes(hashes, n)
    assert len(ok) == len(values)
    place = 0
    for ws in want:
        for i in range(len(ws)):
            fits = i + n <= len(ws)
            if place + i < len(ok):
                assert ok[place + i] == fits
            if fits:
                assert windows.setdefault(tuple(ws[i : i + n]), values[place + i]) == values[place + i]
        place += len(ws)
    assert len(set(windows.values())) == len(windows)
    w._powers.cache_clear()


def test_packing():
    for top in (3, 300, 70_000, 1 << 40):
        values = np.array([0, top, 1])
        assert w.widen(w.narrow(values), 3).tolist() == values.tolist()
    assert w.widen(w.narrow(np.zeros(0, int)), 0).tolist() == []
    assert w.runs(np.array([5, 9]), np.array([2, 3])).tolist() == [5, 6, 9, 10, 11]


def test_chunks_cover_all_rows_and_bound_them():
    offs = np.array([0, 4, 4, 9, 30, 31, 32])
    parts = list(w.chunks(offs, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(offs[b] - offs[a] <= 10 or b == a + 1 for a, b in parts)
