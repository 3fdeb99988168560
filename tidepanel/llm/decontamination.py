"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: A-Z lower-cased, ASCII punctuation and white space turned
into single spaces. An item of n bytes may be met with up to k = n * ``rate``
edits. Cut into k + 1 pieces, at least one piece of it stands unchanged in any such
occurrence, so an Aho-Corasick automaton of all pieces finds every place to look
at; Myers' bit-parallel distance over a window of k bytes more on both sides
verifies it. All places are verified; nothing is capped.

The items are the stated query set: they are held in blocks of ``block_items``, and
a document passes all automata of the blocks in its task, each loaded from the
broadcast of that block. A document is judged by itself: no shuffle, no hot key.

Items that normalise to nothing match nothing; null items and ids of items are
skipped. A null or empty text has no hit. Documents keep all their columns; rows
that repeat are judged alike. ``hits`` must not be a column of the documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIT = "item_id:bigint,distance:int,start:int,end:int,n_pieces:int"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_pieces", pa.int32())]))
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)
)


def normalise(text: str | None) -> str:
    """One character a byte of the UTF-8 text, so that offsets count bytes."""
    return b" ".join((text or "").encode().translate(_PLAIN).split()).decode("latin-1")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Start and text of ``budget`` + 1 pieces of almost equal length."""
    n = min(budget + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def closest(masks: dict[str, int], m: int, window: str, budget: int) -> tuple[int, int]:
    """Least edit distance of a pattern of ``m`` characters to any part of the window
    and where the first such part ends (Myers 1999, one big integer a column)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, budget + 1, -1
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        hp, hn = down | (full & ~(d | up)), up & d
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        up, down = hn | (full & ~(d | hp)), hp & d
    return best, end


def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        out[c] |= 1 << i
    return dict(out)


class Matcher:
    """Automaton of the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            if text := normalise(text):
                budget = int(len(text) * rate)
                for at, piece in pieces(text, budget):
                    found[piece].append((len(self.items), at))
                self.items.append((item_id, text, budget, _masks(text), _masks(text[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """Best occurrence of each item within its budget: id, distance, start, end, pieces met."""
        if not self.items:
            return []
        places: dict[int, set[int]] = defaultdict(set)
        for last, (n, uses) in self.automaton.iter(text):
            for item, at in uses:
                places[item].add(last + 1 - n - at)  # where the item would start
        out = []
        for item, starts in places.items():
            item_id, pattern, budget, masks, back = self.items[item]
            best = None
            for lo, hi in self._windows(sorted(starts), budget, len(pattern), len(text)):
                distance, end = closest(masks, len(pattern), text[lo:hi], budget)
                if distance <= budget and (best is None or distance < best[0]):
                    # the shortest part that ends there and has this distance
                    _, length = closest(back, len(pattern), text[lo : lo + end][::-1], distance)
                    best = (distance, lo + end - length, lo + end)
            if best:
                out.append((item_id, *best, len(starts)))
        return sorted(out)

    @staticmethod
    def _windows(starts: list[int], budget: int, m: int, n: int) -> Iterator[tuple[int, int]]:
        lo, hi = None, None
        for s in starts:
            a, b = max(0, s - budget), min(n, s + m + budget)
            if lo is None or a > hi:
                if lo is not None:
                    yield lo, hi
                lo, hi = a, b
            else:
                hi = max(hi, b)
        if lo is not None:
            yield lo, hi


_built: dict[str, Matcher] = {}


def _matcher(block, rate: float) -> Matcher:
    """The automaton of a broadcast block, built once a worker."""
    if block.key not in _built:
        if len(_built) >= 4:
            _built.clear()
        _built[block.key] = Matcher(block.items.value, rate)
    return _built[block.key]


class _Block:
    def __init__(self, key: str, items):
        self.key, self.items = key, items


def _judged(batches: Iterator[pa.RecordBatch], blocks: list[_Block], column: int, rate: float):
    for batch in batches:
        hits = []
        for i in range(len(batch)):
            text = normalise(batch.column(column)[i].as_py())
            hits.append([h for block in blocks for h in _matcher(block, rate).hits(text)])
        names = ("item_id", "distance", "start", "end", "n_pieces")
        lists = pa.array([[dict(zip(names, h)) for h in x] for x in hits], _KIND)
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "hits"])


def judge(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = 0.08, block_items: int = 20_000) -> DataFrame:
    """The documents with ``hits``: item_id, distance, start, end (bytes of the
    normalised text) and how many places pieces pointed at, for each item met.

    ``items``: item_id, text. They go through the driver one block of
    ``block_items`` at a time."""
    spark = docs.sparkSession
    known = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    n_blocks = -(-known.count() // block_items)
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n_blocks))))
    # Workers outlive a call: no other call, of other items or another rate, has this key.
    blocks, call = [], uuid.uuid4().hex
    for b in range(n_blocks):
        rows = sorted((r.item_id, r.text) for r in dealt.where(F.col("block") == b).collect())
        blocks.append(_Block(f"{call}-{b}", spark.sparkContext.broadcast(rows)))
    column = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("hits", T.ArrayType(T._parse_datatype_string(f"struct<{HIT}>")))])
    return docs.mapInArrow(lambda x: _judged(x, blocks, column, rate), schema)
