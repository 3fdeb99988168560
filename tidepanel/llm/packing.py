"""Best-fit packing of token sequences by a configuration linear program.

A configuration says how many pieces of each length share one sequence. The program
asks for the fewest sequences that hold all pieces, and sees nothing but the histogram
of lengths: at most one count for each possible length, however many documents there
are. Multiplicative weights solve it: each length has a weight that shrinks as its
pieces are covered; a knapsack by dynamic programming finds the configuration of the
highest total price (weight times length), and so much of it is bought that no length
is covered by more than a small share of its pieces at once, and none beyond its count.

Rounding keeps the whole part of every configuration. What is left, about a sequence
for each, goes longest first to where it leaves the least room.

Spark does the work on documents: one pass tokenises, cuts and numbers the pieces of
each length within its task; counts of tasks and lengths become first numbers by a
running sum; a second pass over the written pieces turns the number of a piece into
sequence and offset by a table of the configurations. No text is shuffled, and a length
that a third of all pieces share is only ever counted.

A null text is an empty one: its only token is the end. Every row is a document of its
own, also where rows share an id or are equal; ids, null ones too, are carried as they
are. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import common

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Rows of (task, length) up to which their first numbers are broadcast (24 bytes each).
BROADCAST_ROWS = 500_000
#: Pricing looks at so many lengths of the highest price a token, half as many of the shortest,
#: and twice as many spread over all sizes, others in each step.
PRICED = 32


class Tokens:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file.

    Where ids follow the order of merges, as ranks do, ``tiktoken`` encodes with the
    same vocabulary and added tokens, several times as fast. Texts whose white space
    is too long for its pattern matcher, and other files, go to ``tokenizers``."""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.fast = self._ranked(told)

    @staticmethod
    def _ranked(told: dict) -> tiktoken.Encoding | None:
        split, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        if not plain or told.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            return None
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and not t["special"] for t in told["added_tokens"]):
            return None
        byte_of = _byte_letters()
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])) or len(merged) + 256 != len(ranks):
            return None
        return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # the pattern matcher ran out of stack
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    bytes of Latin-1 stand for themselves, the others follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def _cuts(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: all full but the first."""
    return [n % capacity] * (n % capacity > 0) + [capacity] * (n // capacity)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int, keep_ids: bool):
    encode, task = _tokens(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    closing = np.array([end], "<u4")

    def batch_of(rows: list[tuple], kept: list[np.ndarray], ids: pa.Array):
        cols = list(zip(*rows))
        at, kinds = ids.take(pa.array(cols[0], pa.int64())), [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [at, *(pa.array(c, k) for c, k in zip(cols[1:], kinds)), pa.array([task] * len(rows), pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "number", "task"]
        if keep_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        rows, kept, held = [], [], 0
        for r, text in enumerate(batch.column(1)):
            ids = np.concatenate((encode(text.as_py() or ""), closing))
            start = 0
            for piece, length in enumerate(_cuts(len(ids), capacity)):
                part = ids[start : start + length]
                rows.append((r, piece, start, length, zlib.crc32(part.tobytes()), int(seen[length])))
                if keep_ids:
                    kept.append(part)
                    held += length
                seen[length] += 1
                start += length
            if len(rows) >= 10_000 or held > 1 << 20:
                yield batch_of(rows, kept, batch.column(0))
                rows, kept, held = [], [], 0
        if rows:
            yield batch_of(rows, kept, batch.column(0))


def _knapsack(lengths: np.ndarray, most: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, float]:
    """How many of each length, at most ``most``, give the highest price within ``room``.

    Dynamic program over the room; copies of a length go in bundles of 1, 2, 4, ..."""
    best, bundles = np.zeros(room + 1), []
    for i, (length, limit, price) in enumerate(zip(lengths.tolist(), most.tolist(), prices.tolist())):
        copies, limit = 1, min(limit, room // length)
        while limit > 0:
            copies = min(copies, limit)
            size = copies * length
            with_it = best[:-size] + copies * price
            better = with_it > best[size:]
            bundles.append((i, copies, size, better))
            np.maximum(best[size:], with_it, out=best[size:])
            limit -= copies
            copies *= 2
    found, at = np.zeros(len(lengths), np.int64), room
    for i, copies, size, better in reversed(bundles):
        if at >= size and better[at - size]:
            found[i] += copies
            at -= size
    return found, float(best[room])


class Plan(NamedTuple):
    """Configurations (length -> copies, number of sequences) and a lower bound of sequences."""

    configurations: list[tuple[dict[int, int], int]]
    bound: int

    @property
    def sequences(self) -> int:
        return sum(m for *_, m in self.configurations)


def _program(lengths: np.ndarray, counts: np.ndarray, capacity: int, share: float, rate: float):
    """Configurations with fractional amounts, and what they leave uncovered: under
    an eighth of the tokens, or less than a sequence can be made of."""
    left, log_weight = counts.astype(float), lengths / (10 * capacity)  # short pieces fit anywhere later on
    bought: dict[bytes, list] = {}
    turn = 0
    enough = max(float((lengths * counts).sum()) / 8, capacity)
    while float((lengths * left).sum()) > enough:
        open_ = np.flatnonzero(left >= 0.5)
        if not len(open_):
            break
        density = np.exp(log_weight[open_] - log_weight[open_].max())
        if len(open_) > 4 * PRICED:
            step, turn = len(open_) // (2 * PRICED), turn + 1
            some = [np.argsort(-density, kind="stable")[:PRICED], np.arange(turn % step, len(open_), step), np.arange(PRICED // 2)]
            some = np.unique(np.concatenate(some))
            open_, density = open_[some], density[some]
        wanted = np.ceil(left[open_] - 1e-6).astype(np.int64)
        copies, _ = _knapsack(lengths[open_], wanted, density * lengths[open_], capacity)
        used = np.flatnonzero(copies)
        which, copies = open_[used], copies[used]
        order = np.argsort(-which)
        which, copies = which[order], copies[order]
        amount = min((np.maximum(share * counts[which], 0.5) / copies).min(), (left[which] / copies).min())
        key = which.tobytes() + copies.tobytes()
        bought.setdefault(key, [which, copies, 0.0])[2] += amount
        left[which] -= amount * copies
        log_weight[which] -= rate * amount * copies / counts[which]
    return list(bought.values())


def _best_fit(groups: dict[int, list], lengths: np.ndarray, left: np.ndarray, capacity: int) -> None:
    """Put what is left, longest first, where it leaves the least room, or into new sequences.

    ``groups``: for each room, pairs of a configuration (length -> copies) and its number of sequences."""
    rooms = sorted(groups)

    def add(room: int, made: dict[int, int], times: int) -> None:
        if room not in groups:
            insort(rooms, room)
        groups.setdefault(room, []).append((made, times))

    for length, n in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        while n:
            at = bisect_left(rooms, length)
            room, made, times = capacity, {}, n
            if at < len(rooms):
                room = rooms[at]
                made, times = groups[room].pop()
                if not groups[room]:
                    del groups[rooms.pop(at)]
            each = min(room // length, n)
            used = min(times, n // each)
            if made and times > used:
                add(room, made, times - used)
            add(room - each * length, made | {length: made.get(length, 0) + each}, used)
            n -= each * used


def plan(counts: np.ndarray, capacity: int, share: float = 0.5, rate: float = 0.1) -> Plan:
    """Sequences for ``counts[n]`` pieces of each length n, n from 1 to ``capacity``.

    ``share``: the largest part of a length's pieces that one step covers; ``rate``:
    how fast weights fall. Work depends on the number of lengths, not on counts."""
    counts = np.asarray(counts, np.int64)
    tokens = int((counts * np.arange(len(counts))).sum())
    bound = max(-(-tokens // capacity), int(counts[capacity // 2 + 1 :].sum()))
    groups: dict[int, list] = {}
    if counts[capacity]:
        groups[0] = [({capacity: 1}, int(counts[capacity]))]
    lengths = np.flatnonzero(counts[:capacity])
    left = counts[lengths]
    for which, copies, amount in _program(lengths, left.copy(), capacity, share, rate):
        if whole := int(amount + 1e-9):
            room = capacity - int((lengths[which] * copies).sum())
            groups.setdefault(room, []).append((dict(zip(lengths[which].tolist(), copies.tolist())), whole))
            left[which] -= whole * copies
    if (left < 0).any():
        raise AssertionError("the program covers more pieces than there are")
    _best_fit(groups, lengths, left, capacity)
    return Plan([(made, times) for room in sorted(groups) for made, times in groups[room]], bound)


def _places(planned: Plan) -> tuple[np.ndarray, ...]:
    """For runs of piece numbers of a length, sorted: key (length and first number),
    copies a sequence, first sequence, first offset."""
    rows, numbers, sequence = [], {}, 0
    for made, times in planned.configurations:
        offset = 0
        for length, c in made.items():
            rows.append((length, numbers.get(length, 0), c, sequence, offset))
            numbers[length] = numbers.get(length, 0) + c * times
            offset += c * length
        sequence += times
    rows.sort()
    length, first, c, seq, off = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
    return length << 44 | first, c, seq, off


def _placed(batches: Iterator[pa.RecordBatch], table: tuple[np.ndarray, ...]):
    keys, copies, sequences, offsets = table
    for batch in batches:
        n = batch.num_columns - 2
        length = batch.column("length").to_numpy()
        key = length << 44 | (batch.column("number").to_numpy() + batch.column("first").to_numpy())
        run = np.searchsorted(keys, key, side="right") - 1
        number = key - keys[run]
        sequence, offset = sequences[run] + number // copies[run], offsets[run] + number % copies[run] * length
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:n], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:n], "sequence_id", "offset"]
        )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end: int = 0,
    path: str = TOKENIZER,
    keep_ids: bool = False,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Pieces of all documents with their places in sequences of ``capacity`` tokens.

    A document is the ids of its text, then ``end``. One of more than ``capacity`` tokens
    is cut into full pieces but for the first, which takes what is over. Returns doc_id,
    ``piece`` (from 0), ``start`` (ids of the document before it), ``length``,
    ``ids_crc32`` (of little-endian 32-bit ids), with ``keep_ids`` also ``ids``, then
    ``sequence_id`` and ``offset``. Pieces of a sequence lie end to end from 0 on.
    ``path``: a file of the tokenizers library that every worker has."""
    if not 0 < capacity < 1 << 19:
        raise ValueError("capacity must be from 1 to 524,287")
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, number long, task long"
    schema += ", ids array<int>" if keep_ids else ""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pieces = common.written(rows.mapInArrow(lambda b: _pieces(b, path, capacity, end, keep_ids), schema), "pieces")
    per_task = common.written(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(_places(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if per_task.count() <= broadcast_rows:
        firsts = F.broadcast(firsts)
    kept = [c for c in pieces.columns if c not in ("number", "task")]
    found = pieces.join(firsts, ["task", "length"]).select(*kept, "number", "first")
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[:-2])
    return found.mapInArrow(lambda b: _placed(b, places.value), f"{out}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ``ids`` (those of its pieces end to end) and ``starts`` (offsets of the
    pieces), from pack() with ``keep_ids``. A group is one sequence."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.offset").alias("starts")
    )
