"""Quality rules: gradient-boosted trees over statistics of documents.

Statistics of whole texts are computed for many texts at once. Trees are fitted
in numpy on a bounded sample of labelled documents, by histograms of the features,
with monotonic constraints: a split of a constrained feature must order its two
values that way, and the values of all nodes below stay between. The trees are
flattened into node arrays and score whole batches, one level of a tree at a time.

A null text has no words and fails the base rule. Null or repeated ids keep their
rows; columns other than id and text are not read. Rows whose label is null are
not used; without any labelled row every document that passes the base is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words as w

STRETCH = 1 << 20
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = {
    # name: direction in which quality may move as it grows (0: either)
    "log_words": 0, "word_length": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "distinct_share": 0, "upper_share": 0, "digit_share": 0, "stop_share": 0, "words_per_line": 0, "same_as_before_share": -1,
}
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(ord("A"), ord("Z") + 1))
_DIGIT = np.isin(np.arange(256), np.arange(ord("0"), ord("9") + 1))
_STOP = np.isin(np.arange(256), list(b".!?"))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def statistics(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS (whole numbers) and FEATURES of each text."""
    n = len(offs) - 1
    starts, ends, first = w.bounds(data, offs)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    salt = w.mix(np.arange(1, n + 1, dtype=np.uint64))
    hashes = w.slice_hashes(data, starts, ends)
    lead = ((data & 0xC0) != 0x80) & ~w.SPACE[data]
    chars, symbols = _per_row(lead, offs), _per_row(_SYMBOL[data], offs)

    # lines: up to each \n and to the end of the text
    newlines = np.flatnonzero(data == 0x0A)
    line_doc = np.concatenate((np.searchsorted(offs, newlines, side="right") - 1, np.arange(n)))
    line_end = np.concatenate((newlines, offs[1:]))
    order = np.lexsort((line_end, line_doc))
    line_doc, line_end = line_doc[order], line_end[order]
    begin = np.empty(len(line_end), np.int64)
    new = np.concatenate(([True], line_doc[1:] != line_doc[:-1]))
    begin[0] = 0
    begin[1:] = line_end[:-1] + 1
    begin[new] = offs[line_doc[new]]
    full = np.searchsorted(starts, begin) < np.searchsorted(starts, line_end)
    l_doc, l_hash = line_doc[full], w.slice_hashes(data, begin[full], line_end[full])
    lines = np.bincount(l_doc, minlength=n)
    _, at = np.unique(l_hash ^ salt[l_doc], return_index=True)
    dup_lines = lines - np.bincount(l_doc[at], minlength=n)

    # words in 5-word windows that stand twice or more in the text
    ok = np.flatnonzero(w.inside(first, 5))
    value = w.window_hashes(hashes, 5)[ok] ^ salt[doc[ok]] if len(ok) else np.zeros(0, np.uint64)
    o = np.argsort(value, kind="stable")
    same = value[o[1:]] == value[o[:-1]]
    twice = np.zeros(len(o), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(len(starts) + 6, np.int32)
    np.add.at(change, ok[o[twice]], 1)
    np.add.at(change, ok[o[twice]] + 5, -1)
    repeats = _per_row(np.cumsum(change)[: len(starts)] > 0, first)

    _, at = np.unique(hashes ^ salt[doc], return_index=True)
    distinct = np.bincount(doc[at], minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    stop = _STOP[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    some, some_chars = np.maximum(words, 1), np.maximum(chars, 1)
    features = np.column_stack(
        [
            np.log1p(words), chars / some, symbols / some, dup_lines / np.maximum(lines, 1), repeats / some, distinct / some,
            _per_row(_UPPER[data], offs) / some_chars, _per_row(_DIGIT[data], offs) / some_chars, _per_row(stop, first) / some,
            words / np.maximum(lines, 1), _per_row(again, first) / some,
        ]
    )
    return np.column_stack([words, chars, symbols, dup_lines, repeats]), features


@dataclass(frozen=True)
class Forest:
    """All trees in flat node arrays; leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 20) -> Forest:
    """Logistic gradient boosting on histograms, Newton steps in the leaves."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)])
    p0 = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, base)
    f, t, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((f, 0), (t, np.inf), (left, len(f) - 1), (right, 0), (value, 0.0)):
            a.append(v)
        left[-1] = right[-1] = len(f) - 1
        return len(f) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> None:
        def weight(gs, hs):
            return np.clip(-gs / (hs + ridge), lo, hi)

        gs, hs = g[rows].sum(), h[rows].sum()
        own = float(weight(gs, hs))
        margin[rows] += rate * own if level == 0 else 0
        value[at] = rate * own
        if level == 0:
            return
        loss = lambda w_, a, b: a * w_ + 0.5 * (b + ridge) * w_ * w_
        best = (-1e-9, None)
        for j in range(k):
            m = len(edges[j]) + 1
            if m == 1:
                continue
            b = binned[rows, j]
            gl, hl = np.cumsum(np.bincount(b, g[rows], m))[:-1], np.cumsum(np.bincount(b, h[rows], m))[:-1]
            cl = np.cumsum(np.bincount(b, minlength=m))[:-1]
            wl, wr = weight(gl, hl), weight(gs - gl, hs - hl)
            gain = loss(wl, gl, hl) + loss(wr, gs - gl, hs - hl) - loss(own, gs, hs)
            gain[(cl < least) | (len(rows) - cl < least)] = 0
            if signs[j]:
                gain[signs[j] * (wr - wl) < 0] = 0
            i = int(np.argmin(gain))
            if gain[i] < best[0]:
                best = (gain[i], (j, i, float(wl[i]), float(wr[i])))
        if best[1] is None:
            margin[rows] += rate * own
            return
        j, i, wl, wr = best[1]
        go = binned[rows, j] <= i
        f[at], t[at], left[at], right[at] = j, float(edges[j][i]), node(), node()
        middle = (wl + wr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}[signs[j]]
        grow(left[at], rows[go], g, h, *bounds[0], level - 1)
        grow(right[at], rows[~go], g, h, *bounds[1], level - 1)

    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node())
        grow(roots[-1], np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, depth)
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64, np.int64)
    return Forest(*[np.array(a, d) for a, d in zip((f, t, left, right, value, roots), kinds)], depth, base)


def _measured(batches: Iterator[pa.RecordBatch], forest: Forest | None):
    for batch in batches:
        data_all, offs_all = w.texts_of(batch.column(1))
        for lo, hi in w.chunks(offs_all, STRETCH):
            counts, x = statistics(data_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo])
            out = [batch.column(0).slice(lo, hi - lo), *[pa.array(counts[:, i].astype(np.int64)) for i in range(len(COUNTS))]]
            names = ["doc_id", *COUNTS]
            if forest is None:
                out += [pa.array(x[:, i]) for i in range(x.shape[1])]
                names += FEATURES
            else:
                out.append(pa.array(forest.score(x)))
                names.append("quality")
            yield pa.RecordBatch.from_arrays(out, names)


def _stats(docs: DataFrame, id_col: str, text_col: str, forest: Forest | None) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    cols = [f"doc_id {kind}", *[f"{c} long" for c in COUNTS]]
    cols += [f"{c} double" for c in FEATURES] if forest is None else ["quality double"]
    return docs.select(id_col, text_col).mapInArrow(lambda b: _measured(b, forest), ", ".join(cols))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, **options) -> Forest:
    """Fit on at most ``sample_rows`` labelled documents, drawn by a hash of their id.

    The bound keeps the driver's table small; statistics come from whole texts."""
    drawn = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_semi")
    table = _stats(chosen, "doc_id", "text", None).join(F.broadcast(drawn), "doc_id").toPandas().sort_values("doc_id")
    if not len(table):
        return fit(np.zeros((1, len(FEATURES))), np.ones(1), list(FEATURES.values()), trees=0)
    return fit(table[list(FEATURES)].to_numpy(), table["quality"].to_numpy(float), list(FEATURES.values()), **options)


def judge(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, quality (probability of label 1) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return _stats(docs, id_col, text_col, forest).select(
        "doc_id", *COUNTS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= threshold)).alias("kept")
    )
