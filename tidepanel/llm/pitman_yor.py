"""Language-model scores under a hierarchical Pitman-Yor model.

Tokens are lower-cased words and an end of text. A restaurant for each context
serves the tokens that follow it; all share one parent restaurant over words, whose
base is uniform over the V known words and one unknown. A context is the word
before, by its 64-bit hash as words are, or the start of a text; each has a restaurant
of its own, however many there are.

Seating. A cell is a pair of context and word. One customer sits at one table. With
T, the restaurant's tables, and P, the parent's probability, of the round before (as
is usual for distributed Gibbs sampling), seatings of a cell have the odds x**tables
times the rising factorials of 1 - d, x being (theta + d T) P(word). Only how many
tables there are matters, and every round draws it exactly for each cell of any size,
by generalised Stirling numbers. A table sends a customer to the parent, where the same
holds for words. After the first rounds every round is a sample; the predictive
probabilities of the samples are averaged token by token.

On Spark: texts are counted in stretches; a stretch ships each pair once to the
group of its word, so a word or pair that is frequent is collapsed before the
shuffle. Groups keep the cells of two and more customers. Customers and tables of
contexts are summed in groups of contexts, as many as of words: a round sends them the
tables of its cells by context and gets back the sums of those contexts. For scores,
the pairs of each document go to the groups of their words; those of words with more
than a share of all tokens (at most 8 a group, their counts are broadcast) go to the
group of their context, or are dealt by pair where that is such a word as well. Groups
of contexts tell each what it asks for: contexts of pairs learnt there and of pairs held
out. Groups return sums by document; they score their pairs by ranges of word hashes, so that a task holds little
besides the packed pairs of its group. Each round is written to the shared folder.

Documents of which ``held_out`` is true are scored and not learnt from. A null text
is the end alone. A null id is never held out and learnt from. Rows equal in id and
text give equal rows; rows that share an id only are documents of their own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidepanel.llm import words as w
from tidepanel.llm.common import group_count, release, spread, written

#: Contexts that numbers of two bytes tell apart; a group with more takes wider ones.
CONTEXTS = 1 << 16
STRETCH = 4 << 20
GROUP = 16 << 20
#: Cells of at most so many customers are drawn by a table, larger ones by an integral
#: at so many points.
EXACT = 1 << 11
POINTS = 200
#: Customers of the cells that are drawn at once.
DRAWN = 1 << 19
#: Pairs of documents that are scored at once.
SCORED_AT_ONCE = 1 << 18
END, START = np.uint64(0x8E1D5A7C3B9F6042), np.uint64(0x1F83D9ABFB41BD6B)
NO_ID = np.iinfo(np.int64).max
PAIRS = "part long, words binary, cells binary, contexts binary, counts binary"
ENTRIES = f"{PAIRS}, docs binary, ids binary, keys binary, learnt binary"
LEARNT, DOCUMENTS = f"{PAIRS}, befores binary", f"{ENTRIES}, befores binary"
STATE = "part long, words binary, singles binary, cells binary, contexts binary, counts binary, tables binary, sizes binary, samples binary"


def fold_of(ids: np.ndarray, folds: int) -> np.ndarray:
    """crc32 of the decimal id modulo ``folds``; -1 for a null id."""
    return np.array([-1 if i == NO_ID else zlib.crc32(str(i).encode()) % folds for i in ids.tolist()], np.int64)


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token, context and row of all tokens of texts laid end to end."""
    data = w.LOWER[data]
    starts, ends, first = w.bounds(data, offs)
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n + 1)
    tokens = np.full(len(rows), END, np.uint64)
    at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
    tokens[at] = w.slice_hashes(data, starts, ends)
    before = np.empty(len(rows), np.uint64)
    before[1:] = tokens[:-1]
    before[np.concatenate(([0], np.cumsum(n + 1)[:-1])).astype(np.int64)] = START
    return tokens, before, rows.astype(np.int32)


def _numbered(contexts: np.ndarray) -> tuple[bytes, bytes]:
    """Contexts by number, and the distinct ones in order."""
    befores, number = np.unique(contexts, return_inverse=True)
    return w.narrow(number), befores.tobytes()


def _contexts_of(row, n: int) -> np.ndarray:
    return np.frombuffer(row.befores, np.uint64)[w.widen(row.contexts, n)] if n else np.zeros(0, np.uint64)


def _collapsed(*columns: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct rows of the columns, sorted by them, and how often each stands."""
    order = np.lexsort(columns[::-1])
    sorted_ = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in sorted_:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    times = np.ones(len(order), np.int64) if counts is None else counts[order]
    return (*[c[at] for c in sorted_], np.add.reduceat(times, at) if len(at) else times)


def _parts(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    for block in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        if len(block):
            yield int(part[block[0]]), block


def _by_word(words: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct words of a sorted column and how often each stands."""
    at = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    return words[at].tobytes(), w.narrow(np.diff(np.append(at, len(words))))


def _words_of(row) -> np.ndarray:
    words = np.frombuffer(row.words, np.uint64)
    return np.repeat(words, w.widen(row.cells, len(words)))


def _stretches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        data, offs = w.texts_of(batch.column(1))
        for lo, hi in w.chunks(offs, STRETCH):
            yield ids[lo:hi], data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n in ("part", "owner") else pa.binary()) for n, c in zip(names, zip(*rows))], names)


def _pairs(batches: Iterator[pa.RecordBatch], parts: int, folds: int, held: int):
    """Distinct pairs of the learnt documents of a stretch, by the group of the word."""
    for ids, data, offs in _stretches(batches):
        tokens, contexts, rows = _tokens(data, offs)
        keep = (fold_of(ids, folds) != held)[rows]
        words, contexts, counts = _collapsed(tokens[keep], contexts[keep])
        if len(words):
            part = (words % np.uint64(parts)).astype(np.int64)
            rows = []
            for p, i in _parts(part):
                numbers, befores = _numbered(contexts[i])
                rows.append((p, *_by_word(words[i]), numbers, w.narrow(counts[i]), befores))
            yield _table(rows, LEARNT)


@dataclass
class Cells:
    """Cells of a group with two and more customers, and the single ones by word."""

    word: np.ndarray
    context: np.ndarray
    count: np.ndarray
    words: np.ndarray
    singles: np.ndarray


def _counted(group: pa.Table) -> tuple[Cells, np.ndarray, np.ndarray, np.ndarray]:
    rows = [r for batch in group.to_batches() for r in _rows_of(batch)]
    words = [_words_of(r) for r in rows]
    contexts = np.concatenate([_contexts_of(r, len(x)) for r, x in zip(rows, words)])
    counts = np.concatenate([w.widen(r.counts, len(x)) for r, x in zip(rows, words)])
    words = np.concatenate(words)
    del rows
    words, contexts, counts = _collapsed(words, contexts, counts=counts)
    names, place = np.unique(words, return_inverse=True)
    single = counts == 1
    singles = np.bincount(place[single], minlength=len(names))
    many = ~single
    return Cells(words[many], contexts[many], counts[many], names, singles), np.bincount(place, counts, len(names)).astype(np.int64), contexts, counts


def _row(schema: str, **values) -> pa.RecordBatch:
    """A batch of one row; a dict of arrays is a list of structs."""
    columns = []
    for name in (x.split()[0] for x in re.sub(r"<[^ ]*>", "", schema).split(", ")):
        v = values[name]
        if isinstance(v, dict):
            inner = pa.StructArray.from_arrays([pa.array(x) for x in v.values()], list(v))
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
        else:
            columns.append(pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()))
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in re.sub(r"<[^ ]*>", "", schema).split(", ")])


def _rows_of(batch: pa.RecordBatch) -> Iterator[SimpleNamespace]:
    """Rows one after the other, so that only one is held besides the batch."""
    for i in range(len(batch)):
        yield SimpleNamespace(**{n: batch.column(n)[i].as_py() for n in batch.schema.names})


def _summed(table: pa.Table) -> pa.Table:
    """One row a group: cells, totals, and sums by context."""
    part = table.column("part")[0].as_py()
    cells, totals, contexts, counts = _counted(table)
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    known, place = np.unique(contexts, return_inverse=True)
    customers = np.bincount(place, counts, len(known)).astype(np.int64)
    alone = np.bincount(place[counts == 1], minlength=len(known))
    by_word, sizes = _by_word(cells.word) if len(cells.word) else (b"", b"")
    numbers, befores = _numbered(cells.context)
    row = _row(
        SUMMED, part=part, n_tokens=int(totals.sum()), n_words=len(cells.words),
        pairs1=n1, pairs2=n2, words1=int((totals == 1).sum()), words2=int((totals == 2).sum()),
        names=cells.words.tobytes(), singles=w.narrow(cells.singles), totals=w.narrow(totals),
        words=by_word, cells=sizes, contexts=numbers, counts=w.narrow(cells.count), befores=befores,
        sums=w.narrow(np.zeros(len(befores) // 8, np.int64)), known=known.tobytes(), customers=w.narrow(customers), alone=w.narrow(alone),
    )
    return pa.Table.from_batches([row])


SUMMED = (
    "part long, n_tokens long, n_words long, pairs1 long, pairs2 long, words1 long, words2 long, names binary, singles binary, totals binary, "
    "words binary, cells binary, contexts binary, counts binary, befores binary, sums binary, known binary, customers binary, alone binary"
)
#: From a group of words (``owner``) to one of contexts, and back; ``tables`` answer the names in their order.
ASKED = "part long, owner long, names binary, customers binary, tables binary"
#: Sums of a group of contexts (``owner`` -1), ``seats``: the tables of each sample.
CONTEXT = "part long, owner long, names binary, customers binary, singles binary, tables binary, seats binary"


def _asked(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Contexts of a group of words with its sums, to the groups of the contexts."""
    for batch in batches:
        for row in _rows_of(batch):
            names = np.frombuffer(row.names, np.uint64)
            sums = [w.widen(x, len(names)) for x in (row.customers, row.tables)]
            rows = [(g, int(row.part), names[i].tobytes(), *(w.narrow(x[i]) for x in sums)) for g, i in _parts((names % np.uint64(parts)).astype(np.int64))]
            if rows:
                yield _table(rows, ASKED)


def _own_contexts(told: pa.Table) -> pa.Table:
    """The sums of a group of contexts, over all groups of words."""
    rows = _views_of(told)
    names = [np.frombuffer(r.names, np.uint64) for r in rows]
    sums = [np.concatenate([w.widen(x, len(n)) for x, n in zip(blobs, names)]) for blobs in ([r.customers for r in rows], [r.tables for r in rows])]
    names, place = np.unique(np.concatenate(names), return_inverse=True)
    customers, singles = (np.bincount(place, x, len(names)).astype(np.int64) for x in sums)
    # before the first round every cell has one table
    first = w.narrow(np.maximum(singles, 1))
    return _table_of([(int(rows[0].part), -1, names.tobytes(), w.narrow(customers), w.narrow(singles), first, b"")], CONTEXT)


def _table_of(rows: list[tuple], schema: str) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64() if n in ("part", "owner") else pa.binary() for n in names]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)


def _answered(contexts: pa.Table, asks: pa.Table, number: int, keep: bool) -> pa.Table:
    """Tables by context after a round (before the first for ``number`` 0), and answers."""
    out = []
    for row in _views_of(contexts):
        names = np.frombuffer(row.names, np.uint64)
        tables, asked = w.widen(row.tables if not number else row.singles, len(names)).copy(), []
        for r in _views_of(asks):
            wanted = np.frombuffer(r.names, np.uint64)
            asked.append((r.owner, np.searchsorted(names, wanted)))
            if number:
                tables[asked[-1][1]] += w.widen(r.tables, len(wanted))
        seats = bytes(row.seats) + (tables.tobytes() if keep else b"")
        out.append((row.part, -1, bytes(row.names), bytes(row.customers), bytes(row.singles), w.narrow(tables), seats))
        out += [(row.part, owner, b"", b"", b"", w.narrow(tables[at]), b"") for owner, at in asked]
    return _table_of(out, CONTEXT)


@dataclass(frozen=True)
class Totals:
    """What all groups know of each other; ``customers`` and ``tables`` are those of the
    contexts of one group, by their numbers there."""

    n_tokens: int
    n_words: int
    discount: float
    strength: float
    root_discount: float
    root_strength: float
    customers: np.ndarray
    tables: np.ndarray
    root_customers: float
    root_tables: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Parent's probability of words with so many customers and tables there."""
        d, s = self.root_discount, self.root_strength
        return (customers - d * tables + (s + d * self.root_tables) / (self.n_words + 1)) / (s + self.root_customers)


@lru_cache(maxsize=2)
def _seatings(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: the sum, over all seatings of c
    customers at k tables, of the products of (1 - d)(2 - d)...(n - 1 - d) over tables
    of n. Row c (up to ``EXACT``) starts at c (c - 1) / 2."""
    out = np.zeros(EXACT * (EXACT + 1) // 2)
    row, k = np.zeros(1), np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        joins = row + np.log(n - discount * k[:n])
        row = np.concatenate((joins[:1], np.logaddexp(joins[1:], row[:-1]), row[-1:]))
        out[n * (n + 1) // 2 :][: n + 1] = row
    return out


def draw(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Exact draws of the number of tables of cells of at most ``EXACT`` customers.

    Seatings have the odds weight**tables times the rising factorials of 1 - d."""
    logs, out, ends = _seatings(discount), np.empty(len(count), np.int64), np.cumsum(count)
    cuts = np.searchsorted(ends, np.arange(DRAWN, int(count.sum()), DRAWN))
    for lo, hi in zip([0, *cuts], [*cuts, len(count)]):
        c = count[lo:hi]
        if not len(c):
            continue
        first = np.cumsum(c) - c
        odds = logs[w.runs(c * (c - 1) // 2, c)] + w.runs(np.ones_like(c), c) * np.repeat(np.log(weight[lo:hi]), c)
        odds -= np.repeat(np.maximum.reduceat(odds, first), c)
        sums = np.concatenate(([0.0], np.cumsum(np.exp(odds))))
        at = sums[first] + rng.random(len(c)) * (sums[first + c] - sums[first])
        out[lo:hi] = np.clip(np.searchsorted(sums, at, side="right") - first, 1, c)
    return out


def table_odds(count: int, weight: float, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tables of a cell of more than ``EXACT`` customers, and their odds, exact
    but for rounding.

    S(c, k) is c! / (d**k k!) times the coefficient of x**c in (1 - (1 - x)**d)**k. It
    is an integral along any contour between x = 0 and the cut at 1 - x = z <= 0, here
    through the saddle point, on the circle of x or, near the cut, the parabola
    z0 (1 + iu)**2, by the trapezoidal rule, which converges geometrically. The number of tables is a sum of independent indicators, so odds
    farther than 10 roots of the mean and 40 from it are below rounding."""
    lo, hi = -690.0, -1e-12
    for _ in range(60):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if math.log(weight) + (discount - 1) * t + math.log(-math.expm1(t)) > math.log(count + 1) else (lo, t)
    mean = weight / discount * -math.expm1(discount * lo)
    reach = 10 * math.sqrt(mean) + 40
    k = np.arange(max(1, int(mean - reach)), min(count, int(mean + reach)) + 1)
    x0, z0 = -math.expm1(lo), max(math.exp(lo), 1 / count)
    circle = x0 < 0.5

    def terms(u):
        if circle:
            return np.log(1 - (1 - x0 * np.exp(1j * u)) ** discount), -count * (math.log(x0) + 1j * u)
        z = z0 * (1 + 1j * u) ** 2
        return np.log(1 - z**discount), -(count + 1) * np.log(1 - z) + np.log(1 + 1j * u)

    def height(u, tables):
        a, b = terms(u)
        return (tables * a + b).real

    far = 0.01
    while any(height(far, x) > height(0.0, x) - 45 for x in (int(k[0]), int(k[-1]))) and not (circle and far >= math.pi):
        far = min(1.5 * far, math.pi) if circle else 1.5 * far
    a, b = terms((np.arange(POINTS) + 0.5) * far / POINTS)
    top = k * terms(0.0)[0].real
    b -= b.real.max()
    sums = np.concatenate([np.exp(k[i : i + 1024, None] * a + b - top[i : i + 1024, None]).real.sum(axis=1) for i in range(0, len(k), 1024)])
    logs = top + k * math.log(weight / discount) - np.cumsum(np.log(k)) + np.log(np.maximum(sums, 1e-300))
    return k, np.exp(logs - logs.max())


def reseat(sizes: np.ndarray, slots: np.ndarray, weight: np.ndarray, discount: float, moves: int, rng: np.random.Generator) -> None:
    """``moves`` Gibbs moves in every cell, in place. ``sizes``: customers of all
    tables, cell after cell, ``slots[i]`` places for cell i (0: no table there);
    ``weight``: that of a new table in each cell. A customer who would open a table
    where no place is left stays. Tests hold the draws against these moves."""
    first = np.cumsum(slots) - slots
    for _ in range(moves):
        sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        base = sums[first]
        people = sums[first + slots] - base
        at = np.searchsorted(sums, base + (rng.random(len(slots)) * people).astype(np.int64), side="right") - 1
        sizes[at] -= 1
        tables = np.add.reduceat((sizes > 0).astype(np.int64), first)
        new = rng.random(len(slots)) * (weight + people - 1 - discount * tables) < weight
        # an old table: drawn by its customers, taken with 1 - d / n
        todo = np.flatnonzero(~new)
        sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        target = at.copy()
        while len(todo):
            b = sums[first[todo]]
            pick = np.searchsorted(sums, b + (rng.random(len(todo)) * (people[todo] - 1)).astype(np.int64), side="right") - 1
            ok = rng.random(len(todo)) * sizes[pick] < sizes[pick] - discount
            target[todo[ok]] = pick[ok]
            todo = todo[~ok]
        opens = np.flatnonzero(new & (sizes[at] > 0))  # an emptied place is taken again as it is
        if len(opens):
            free = np.where(sizes == 0, np.arange(len(sizes)), len(sizes))
            place = np.minimum.reduceat(free, first)[opens]
            target[opens] = np.where(place < len(sizes), place, at[opens])
        np.add.at(sizes, target, 1)


def _seated(count: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Exact draws of the number of tables of all cells."""
    tables = np.ones(len(count), np.int64)
    few = np.flatnonzero((count > 1) & (count <= EXACT))
    if len(few):
        tables[few] = draw(count[few], weight[few], discount, rng)
    for i in np.flatnonzero(count > EXACT).tolist():
        k, odds = table_odds(int(count[i]), float(weight[i]), discount)
        sums = np.cumsum(odds)
        tables[i] = k[min(np.searchsorted(sums, rng.random() * sums[-1], side="right"), len(k) - 1)]
    return tables


def _round(batches: Iterator[pa.RecordBatch], totals: Totals, number: int, keep: bool) -> Iterator[pa.RecordBatch]:
    """One round of all groups: reseat cells, then words in the parent."""
    for batch in batches:
        for row in _rows_of(batch):
            rng = np.random.default_rng([int(row.part), number])
            names = np.frombuffer(row.names, np.uint64)
            singles = w.widen(row.singles, len(names))
            words = _words_of(row) if len(row.words) else np.zeros(0, np.uint64)
            place = np.searchsorted(names, words)
            context = w.widen(row.contexts, len(words))
            count = w.widen(row.counts, len(words))
            befores = getattr(row, "befores", b"")
            state = np.split(np.frombuffer(row.state, np.int32), [len(words)]) if number else None
            tables = np.ones(len(words), np.int64) if state is None else state[0]
            parent = singles + np.bincount(place, tables, len(names)).astype(np.int64)
            root_tables = np.ones(len(names), np.int64) if state is None else state[1]
            p = totals.root(parent, root_tables)
            weight = (totals.strength + totals.discount * totals.tables[context]) * p[place]
            tables = _seated(count, weight, totals.discount, rng)
            parent = singles + np.bincount(place, tables, len(names)).astype(np.int64)
            root_weight = np.full(len(names), (totals.root_strength + totals.root_discount * totals.root_tables) / (totals.n_words + 1))
            root_tables = _seated(parent, root_weight, totals.root_discount, rng)
            samples = row.samples if number else b""
            if keep:
                samples = samples + tables.astype(np.int32).tobytes() + root_tables.astype(np.int32).tobytes()
            by_context = np.bincount(context, tables, len(befores) // 8).astype(np.int64)
            # One group at a time, so that a task holds the seating of one.
            yield _row(
                ROUND, **{k: getattr(row, k) for k in ("part", "names", "singles", "totals", "words", "cells", "contexts", "counts")},
                state=tables.astype(np.int32).tobytes() + root_tables.astype(np.int32).tobytes(), samples=samples,
                root_customers=int(parent.sum()), root_tables=int(root_tables.sum()),
                befores=befores, sums=w.narrow(by_context),
            )


ROUND = (
    "part long, names binary, singles binary, totals binary, words binary, cells binary, contexts binary, counts binary, state binary, samples binary, "
    "root_customers long, root_tables long, befores binary, sums binary"
)


def _round_of(state: pa.Table, answers: pa.Table, totals: Totals, number: int, keep: bool, parts: int) -> pa.Table:
    """_round() of one group with the tables of its contexts."""
    befores = np.frombuffer(state.column("befores")[0].as_py(), np.uint64)
    tables, group = np.zeros(len(befores)), befores % np.uint64(parts)
    for r in _views_of(answers):
        at = np.flatnonzero(group == np.uint64(r.group))
        tables[at] = w.widen(r.tables, len(at))
    return pa.Table.from_batches(_round(state.to_batches(), replace(totals, tables=tables), number, keep))


def _entries(batches: Iterator[pa.RecordBatch], parts: int, folds: int, held: int, hot):
    """Distinct pairs of every document, by the group that knows about the pair."""
    frequent = hot.value[0]
    for ids, data, offs in _stretches(batches):
        tokens, contexts, rows = _tokens(data, offs)
        words, contexts, rows, counts = _collapsed(tokens, contexts, rows)
        keys = np.zeros(len(ids), np.uint32)
        full = np.flatnonzero(np.diff(offs))
        keys[full] = w.slice_hashes(data, offs[full], offs[full + 1]).astype(np.uint32)
        by_id = np.lexsort((keys, ids))
        rank = np.empty(len(ids), np.int32)
        rank[by_id] = np.arange(len(ids))
        learnt = fold_of(ids, folds) != held
        part = _group_of(words, contexts, frequent, parts)
        out = []
        for p, i in _parts(part):
            docs, place = np.unique(rank[rows[i]], return_inverse=True)
            docs = by_id[docs]
            numbers, befores = _numbered(contexts[i])
            out.append((p, *_by_word(words[i]), numbers, w.narrow(counts[i]), w.narrow(place), *_packed_ids(ids[docs], keys[docs]), learnt[docs].tobytes(), befores))
        yield _table(out, DOCUMENTS)


def _asked_by_held_out(batches: Iterator[pa.RecordBatch], parts: int, folds: int, held: int, hot):
    """Contexts of the pairs of documents held out, by the group that scores them."""
    frequent = hot.value[0]
    for ids, data, offs in _stretches(batches):
        tokens, contexts, rows = _tokens(data, offs)
        keep = (fold_of(ids, folds) == held)[rows]
        words, contexts, _ = _collapsed(tokens[keep], contexts[keep])
        part = _group_of(words, contexts, frequent, parts)
        contexts, owner, _ = _collapsed(contexts, part)
        to = (contexts % np.uint64(parts)).astype(np.int64) * parts + owner
        rows = [(x // parts, x % parts, contexts[i].tobytes(), b"", b"") for x, i in _parts(to)]
        if rows:
            yield _table(rows, ASKED)


def _packed_ids(ids: np.ndarray, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Rising ids as the first and the steps; a hash of each text tells equal ids apart."""
    values = ids.view(np.uint64)
    steps = np.diff(values)
    return values[:1].tobytes() + (w.narrow(steps.view(np.int64)) if (steps < 1 << 62).all() else steps.tobytes()), keys.tobytes()


def _ids_of(row) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row.keys, np.uint32)
    first, steps = np.frombuffer(row.ids[:8], np.uint64), w.widen(row.ids[8:], len(keys) - 1)
    return np.cumsum(np.concatenate((first, steps.view(np.uint64))), dtype=np.uint64).view(np.int64), keys


def _group_of(words: np.ndarray, contexts: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    part = words % np.uint64(parts)
    if len(frequent):
        often = np.isin(words, frequent)
        part[often] = contexts[often] % np.uint64(parts)
        both = often & (np.isin(contexts, frequent) | (contexts == START))
        part[both] = _cell_keys(words[both], contexts[both]) % np.uint64(parts)
    return part.astype(np.int64)


def _dealt_state(batches: Iterator[pa.RecordBatch], parts: int, hot, n_samples: int) -> Iterator[pa.RecordBatch]:
    """The sampled tables of cells and words, sent to the groups that need them."""
    frequent = hot.value[0]
    for batch in batches:
        for row in _rows_of(batch):
            names = np.frombuffer(row.names, np.uint64)
            words = _words_of(row) if len(row.words) else np.zeros(0, np.uint64)
            contexts = _contexts_of(row, len(words))
            samples = np.frombuffer(row.samples, np.int32).reshape(n_samples, -1)
            part = _group_of(words, contexts, frequent, parts)
            rows = []
            for p, i in _parts(part):
                rows.append((p, words[i].tobytes(), contexts[i].tobytes(), np.ascontiguousarray(samples[:, i]).tobytes(), b"", b"", b"", b"", b""))
            rows.append((int(row.part), b"", b"", b"", names.tobytes(), np.ascontiguousarray(samples[:, len(words) :]).tobytes(), b"", b"", b""))
            yield _table(rows, SENT)


def _told(contexts: pa.Table, asks: pa.Table, n_samples: int) -> pa.Table:
    """Customers and sampled tables of contexts: all to the group of words of the same
    number (for frequent words), and to every other group those it asks for."""
    out, none = [], (b"",) * 5
    for row in _views_of(contexts):
        names = np.frombuffer(row.names, np.uint64)
        customers = w.widen(row.customers, len(names))
        seats = np.frombuffer(row.seats, np.int64).reshape(n_samples, -1)
        wanted: dict[int, list[np.ndarray]] = {}
        for r in _views_of(asks):
            wanted.setdefault(r.owner, []).append(np.frombuffer(r.names, np.uint64))
        at = {owner: np.flatnonzero(np.isin(names, np.concatenate(x))) for owner, x in wanted.items()}
        at[row.part] = np.arange(len(names))
        out += [(owner, *none, names[i].tobytes(), w.narrow(customers[i]), w.narrow(seats[:, i].ravel())) for owner, i in at.items() if len(i)]
    return _table_of(out, SENT)


def _hot_contexts(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, n_samples: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows_of(batch):
            names = np.frombuffer(row.names, np.uint64)
            i = np.flatnonzero(np.isin(names, frequent) | (names == START))
            seats = np.frombuffer(row.seats, np.int64).reshape(n_samples, -1)[:, i]
            if len(i):
                yield _table([(int(row.part), *(b"",) * 5, names[i].tobytes(), w.narrow(w.widen(row.customers, len(names))[i]), w.narrow(seats.ravel()))], SENT)


def _near(sampled: list[SimpleNamespace], totals: list[Totals]) -> tuple[np.ndarray, list[Totals]]:
    """Contexts that a group knows, and the totals with their sums; one more, the last,
    is that of the unknown ones, which nobody has learnt from."""
    rows = [r for r in sampled if len(r.befores)]
    names = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.befores, np.uint64) for r in rows]])
    customers = np.concatenate([np.zeros(0, np.int64), *[w.widen(r.customers, len(r.befores) // 8) for r in rows]])
    seats = np.concatenate([np.zeros((len(totals), 0)), *[w.widen(r.seats, len(totals) * (len(r.befores) // 8)).reshape(len(totals), -1) for r in rows]], axis=1)
    names, first = np.unique(names, return_index=True)
    grown = lambda x: np.append(x[first], 0).astype(np.float64)
    return names, [replace(t, customers=grown(customers), tables=grown(seats[k])) for k, t in enumerate(totals)]


def _number_in(known: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Numbers of contexts among the known ones, the last for others."""
    if not len(known):
        return np.zeros(len(contexts), np.int32)
    i = np.minimum(np.searchsorted(known, contexts), len(known) - 1)
    return np.where(known[i] == contexts, i, len(known)).astype(np.int32)


DEALT = "part long, words binary, contexts binary, tables binary, names binary, root_tables binary"
SENT = f"{DEALT}, befores binary, customers binary, seats binary"
SCORED = "bucket long, ids binary, keys binary, rows binary, n_tokens binary, n_known binary, base binary, score binary"


def _lookup(names: np.ndarray, values: np.ndarray, at: np.ndarray, missing: float) -> np.ndarray:
    """Values of the (sorted) names, ``missing`` for others."""
    if not len(names):
        return np.full((len(values), len(at)), missing)
    i = np.minimum(np.searchsorted(names, at), len(names) - 1)
    return np.where(names[i] == at, values[:, i], missing)


def _views_of(table: pa.Table) -> list[SimpleNamespace]:
    """Rows of a table, their blobs as views of its buffers."""
    return [
        SimpleNamespace(**{n: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for n, c in zip(batch.schema.names, batch.columns)})
        for batch in table.to_batches() for i in range(len(batch))
    ]


def _packed(blob, n: int) -> np.ndarray:
    """What narrow() packed, in the type it was packed in."""
    return np.frombuffer(blob, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(blob) // n] if n else np.uint8)


def _ranges(entries: list[SimpleNamespace]) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Ranges (both ends included) of word hashes with about ``SCORED_AT_ONCE`` pairs each."""
    sizes = np.zeros(4096)
    for r in entries:
        words = np.frombuffer(r.words, np.uint64)
        sizes += np.bincount((words >> np.uint64(52)).astype(np.int64), w.widen(r.cells, len(words)), 4096)
    number = (np.cumsum(sizes) - sizes) // SCORED_AT_ONCE
    first = np.concatenate(([0], np.flatnonzero(np.diff(number)) + 1))
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), 4096]):
        yield np.uint64(lo << 52), np.uint64((hi << 52) - 1)


def _between(words: np.ndarray, lo: np.uint64, hi: np.uint64) -> slice:
    """Where rising words of a range stand."""
    return slice(int(np.searchsorted(words, lo)), int(np.searchsorted(words, hi, side="right")))


def _pairs_between(entries: list[SimpleNamespace], lo: np.uint64, hi: np.uint64) -> tuple[np.ndarray, ...]:
    """Words, contexts, counts and documents of the pairs of a range."""
    out, offset = [], 0
    for r in entries:
        words = np.frombuffer(r.words, np.uint64)
        cells, at = w.widen(r.cells, len(words)), _between(words, lo, hi)
        n = int(cells.sum())
        a = int(cells[: at.start].sum())
        b = a + int(cells[at].sum())
        docs = _packed(r.docs, n)[a:b].astype(np.int32) + np.int32(offset)
        contexts = _packed(r.contexts, n)[a:b]
        if hasattr(r, "numbers"):
            contexts = r.numbers[contexts]
        out.append((np.repeat(words[at], cells[at]), contexts, _packed(r.counts, n)[a:b].astype(np.int32), docs))
        offset += len(r.keys) // 4
    return tuple(map(np.concatenate, zip(*out)))


def _scored(entries: pa.Table, state: pa.Table, totals: list[Totals], buckets: int, hot, common: pa.Table | None = None) -> pa.Table:
    """Sums by document over the tokens of one group. ``common``: sums of frequent
    contexts. Rows that name no contexts have them by their number in ``totals``."""
    names = [x.split()[0] for x in SCORED.split(", ")]
    kinds = [pa.int64() if x == "bucket" else pa.binary() for x in names]
    if not entries.num_rows:
        return pa.table([pa.array([], k) for k in kinds], names)
    rows, sampled = _views_of(entries), _views_of(state)
    if common is not None:
        known, totals = _near(sampled + _views_of(common), totals)
        for r in rows:
            r.numbers = _number_in(known, np.frombuffer(r.befores, np.uint64))
        for r in sampled:
            r.numbers = _number_in(known, np.frombuffer(r.contexts, np.uint64))
    ids, keys = map(np.concatenate, zip(*map(_ids_of, rows)))
    learnt = np.concatenate([np.frombuffer(r.learnt, bool) for r in rows])
    sums = [np.zeros(len(ids)) for _ in range(5)]
    for lo, hi in _ranges(rows):
        pairs = _pairs_between(rows, lo, hi)
        if len(pairs[0]):
            for total, part in zip(sums, _range_scored(*pairs, learnt, sampled, lo, hi, totals, hot)):
                total += part
    out = []
    by_id = np.lexsort((keys, ids))
    for b, i in _parts(spread(ids[by_id], buckets)):
        i = by_id[i]
        ints = [np.rint(x[i]).astype(np.int64) for x in sums[:3]]
        out.append((b, *_packed_ids(ids[i], keys[i]), *map(w.narrow, ints), sums[3][i].tobytes(), sums[4][i].tobytes()))
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _range_scored(
    words: np.ndarray, contexts: np.ndarray, counts: np.ndarray, docs: np.ndarray, learnt: np.ndarray,
    state: list[SimpleNamespace], lo: np.uint64, hi: np.uint64, totals: list[Totals], hot,
) -> Iterator[np.ndarray]:
    """Texts' ends, tokens, known ones, base and score by document, of the pairs of a range."""
    names_hot, counts_hot, roots_hot = hot.value
    n = len(totals)
    order = np.lexsort((contexts, words))
    words, contexts, counts, docs = words[order], contexts[order], counts[order], docs[order]
    del order
    own = counts * learnt[docs]
    new = np.concatenate(([True], (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])))
    at = np.flatnonzero(new)
    cell = np.cumsum(new) - 1
    c = np.add.reduceat(own, at).astype(np.float64)
    c_words, c_contexts = words[at], contexts[at].astype(np.int64)
    new_word = np.concatenate(([True], c_words[1:] != c_words[:-1]))
    w_at = np.flatnonzero(new_word)
    word_of = np.cumsum(new_word) - 1
    names = c_words[w_at]

    # tables of the cells, in each sample: as sampled, one where one customer sits
    tables = np.tile((c > 0).astype(np.float64), (n, 1))
    s_names, s_roots = np.zeros(0, np.uint64), np.zeros((n, 0))
    for r in state:
        if len(r.words):
            s_words = np.frombuffer(r.words, np.uint64)
            at = _between(s_words, lo, hi)
            if at.start < at.stop:
                numbers = r.numbers if hasattr(r, "numbers") else np.frombuffer(r.contexts, np.uint16)
                key = _cell_keys(s_words[at], numbers[at].astype(np.uint64))
                mine = _cell_keys(c_words, c_contexts.astype(np.uint64))
                o = np.argsort(key)
                i = np.minimum(np.searchsorted(key[o], mine), len(key) - 1)
                hit = key[o][i] == mine
                tables[:, hit] = np.frombuffer(r.tables, np.int32).reshape(n, -1)[:, at][:, o[i[hit]]]
        if len(r.names):
            s_names = np.frombuffer(r.names, np.uint64)
            at = _between(s_names, lo, hi)
            s_names, s_roots = s_names[at], np.frombuffer(r.root_tables, np.int32).reshape(n, -1)[:, at].astype(np.float64)
    totals_w = np.add.reduceat(c, w_at)
    customers = np.add.reduceat(tables, w_at, axis=1)
    roots = _lookup(s_names, s_roots, names, 0.0)
    often = np.isin(names, names_hot)
    if often.any():
        i = np.searchsorted(names_hot, names[often])
        totals_w[often] = counts_hot[i]
        customers[:, often], roots[:, often] = roots_hot[:, 0, i], roots_hot[:, 1, i]
    p = np.zeros(len(c))
    for k, t in enumerate(totals):
        parent = t.root(customers[k], np.where(totals_w > 0, roots[k], 0))[word_of]
        back = t.strength + t.discount * t.tables[c_contexts]
        p += (np.where(c > 0, c - t.discount * tables[k], 0) + back * parent) / (t.strength + t.customers[c_contexts])
    log_p = np.log10(p / n)
    base = np.log10((totals_w + 1) / (totals[0].n_tokens + totals[0].n_words + 1))[word_of]
    known = (totals_w > 0)[word_of]
    for x in (words == END, 1, known[cell], base[cell], log_p[cell]):
        yield np.bincount(docs, counts * x, len(learnt))


def _cell_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return w.mix(words ^ (contexts + np.uint64(1)) * w.END_MARK)


def _totalled(group: pd.DataFrame) -> pd.DataFrame:
    """Sums of all groups for the documents of a bucket."""
    parts = []
    for r in group.itertuples():
        ids, keys = _ids_of(r)
        n = len(ids)
        parts.append(
            pd.DataFrame(
                {
                    "id": ids, "key": keys, "rows": w.widen(r.rows, n), "n_tokens": w.widen(r.n_tokens, n),
                    "n_known": w.widen(r.n_known, n), "base_score": np.frombuffer(r.base, np.float64), "score": np.frombuffer(r.score, np.float64),
                }
            )
        )
    sums = pd.concat(parts).groupby(["id", "key"], sort=True).sum().reset_index()
    times = sums["rows"].to_numpy()
    for c in ("n_tokens", "n_known", "base_score", "score"):
        sums[c] = sums[c] // times if c.startswith("n_") else sums[c] / times
    sums = sums.loc[np.repeat(np.arange(len(sums)), times)]
    ids = sums["id"].to_numpy()
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), **{c: sums[c].to_numpy() for c in ("n_tokens", "n_known", "base_score", "score")}})
    out.loc[ids == NO_ID, "doc_id"] = pd.NA
    return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, burn_in: int = 2, samples: int = 2,
    strength: float = 1.0, group_bytes: int = GROUP,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``burn_in`` and ``samples``: rounds before and of sampling; ``strength``: theta.
    Discounts come from the counts of counts, n1 / (n1 + 2 n2)."""
    spark = docs.sparkSession
    parts = group_count(docs, text_col, group_bytes)
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counted = written(only.mapInArrow(lambda b: _pairs(b, parts, folds, held), LEARNT).groupBy("part").applyInArrow(_summed, SUMMED), "cells")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_tokens", "n_words", "pairs1", "pairs2", "words1", "words2")]
    t = counted.agg(*sums).first() or Row(n_tokens=0, n_words=0, pairs1=0, pairs2=0, words1=0, words2=0)
    d = [min(0.95, max(0.1, a / max(1, a + 2 * b))) for a, b in ((t.pairs1, t.pairs2), (t.words1, t.words2))]
    # before the first round every word has one table in the parent
    none = np.zeros(0)
    now = Totals(t.n_tokens, t.n_words, d[0], strength, d[1], strength, none, none, float(max(1, t.n_words)), float(max(1, t.n_words)))
    known = counted.select("part", F.col("known").alias("names"), "customers", F.col("alone").alias("tables"))
    told = written(known.mapInArrow(lambda b: _asked(b, parts), ASKED), "told")
    contexts = _exchanged(told.groupBy("part").applyInArrow(_own_contexts, CONTEXT), counted, parts, 0, False)
    state, kept = counted.drop("known", "customers", "alone"), []
    for i in range(burn_in + samples):
        keep = i >= burn_in
        before, state = state, written(_next(state, contexts, now, i, keep, parts), "round")
        root = state.agg(F.sum("root_customers").alias("c"), F.sum("root_tables").alias("t")).first()
        now = replace(now, root_customers=float(root.c or 0), root_tables=float(root.t or 0))
        earlier, contexts = contexts, _exchanged(contexts.where("owner < 0"), state, parts, i + 1, keep)
        release(counted if i == 0 else before, earlier)
        if keep:
            kept.append(now)
    sums = contexts.where("owner < 0")
    hot = spark.sparkContext.broadcast(_frequent(state, t.n_tokens, parts, samples))
    often = hot.value[0]
    common = sums.mapInArrow(lambda b: _hot_contexts(b, often, samples), SENT).toArrow()
    entries = only.mapInArrow(lambda b: _entries(b, parts, folds, held, hot), DOCUMENTS)
    dealt = state.select("part", "names", "words", "cells", "contexts", "befores", "samples").mapInArrow(lambda b: _dealt_state(b, parts, hot, samples), SENT)
    asks = told.unionByName(only.mapInArrow(lambda b: _asked_by_held_out(b, parts, folds, held, hot), ASKED)).select("part", "owner", "names")
    sent = sums.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(lambda a, b: _told(a, b, samples), SENT)
    dealt = dealt.unionByName(sent)
    shared = spark.sparkContext.broadcast((kept, common))
    scored = entries.groupBy("part").cogroup(dealt.groupBy("part")).applyInArrow(lambda a, b: _scored(a, b, shared.value[0], parts, hot, shared.value[1]), SCORED)
    out = scored.groupBy("bucket").applyInPandas(_totalled, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held
    return out.select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "n_tokens", "n_known", F.lit(t.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def _next(state: DataFrame, contexts: DataFrame, now: Totals, number: int, keep: bool, parts: int) -> DataFrame:
    answers = contexts.where("owner >= 0").select(F.col("owner").alias("part"), F.col("part").alias("group"), "tables")
    seated = state.groupBy("part").cogroup(answers.groupBy("part"))
    return seated.applyInArrow(lambda a, b: _round_of(a, b, now, number, keep, parts), ROUND)


def _exchanged(contexts: DataFrame, state: DataFrame, parts: int, number: int, keep: bool) -> DataFrame:
    """Sums by context after a round, and the answers to the groups of its cells."""
    asks = state.select("part", F.col("befores").alias("names"), F.col("sums").alias("customers"), F.col("sums").alias("tables"))
    asks = asks.mapInArrow(lambda b: _asked(b, parts), ASKED)
    return written(contexts.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(lambda a, b: _answered(a, b, number, keep), CONTEXT), "contexts")


def _hot_words(batches: Iterator[pa.RecordBatch], least: float, n_samples: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows_of(batch):
            names = np.frombuffer(row.names, np.uint64)
            totals, singles = w.widen(row.totals, len(names)), w.widen(row.singles, len(names))
            words = _words_of(row) if len(row.words) else np.zeros(0, np.uint64)
            samples = np.frombuffer(row.samples, np.int32).reshape(n_samples, -1)
            place = np.searchsorted(names, words)
            i = np.flatnonzero(totals >= least)
            if not len(i):
                continue
            customers = [(singles + np.bincount(place, s[: len(words)], len(names)))[i].astype(np.int64) for s in samples]
            roots = [s[len(words) :][i].astype(np.int64) for s in samples]
            lists = [pa.array(np.array(x).T.tolist(), pa.list_(pa.int64())) for x in (customers, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(names[i].view(np.int64)), pa.array(totals[i]), *lists], ["word", "total", "customers", "roots"])


def _frequent(state: DataFrame, n_tokens: int, parts: int, n_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with over 1 / (8 parts) of all tokens, so at most 8 a group: word,
    count, and customers and tables in the parent for each sample."""
    least = max(1.0, n_tokens / (8 * parts))
    rows = state.mapInArrow(lambda b: _hot_words(b, least, n_samples), "word long, total long, customers array<long>, roots array<long>").collect()
    words = np.array([r.word for r in rows], np.int64).view(np.uint64)
    order = np.argsort(words)
    values = np.array([[r.customers, r.roots] for r in rows], np.float64).reshape(len(rows), 2, n_samples)
    return words[order], np.array([r.total for r in rows], np.float64)[order], values.transpose(2, 1, 0)[:, :, order]
