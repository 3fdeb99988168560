"""Fill-in-the-middle transformation: a text's prefix, middle and suffix in a new order.

Both cuts stand between code points. A Roaring-style set holds the byte offsets at
which code points of a stretch of texts start: chunks of 65,536 offsets are kept as
an array, a bitmap or runs, whichever is smallest, under cumulative cardinalities.
``rank`` counts the code points before a text, ``select`` turns an ordinal into a
byte offset: a search of the cumulative cardinalities finds the container, a local
select the place in it. Texts are cut as bytes and never turned into code points.

A null text is an empty one, and empty texts stay plain, as do texts that hold a
marker: then the output could not be told apart. Rows draw by their id alone, so
rows that share an id share the draws; a null id draws as an empty one. Rows keep
their id as it is; other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words as w
from tidepanel.llm.common import GROUP_BYTES

CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


class _Array:
    """Sorted offsets of a chunk."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)

    def rank(self, x: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, x.astype(np.uint16))


class _Bitmap:
    """One bit for each offset of a chunk, and the set bits before each word of 64."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(CHUNK, bool)
        bits[low] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        nth = np.cumsum(bits, axis=1, dtype=np.int64) > (k - self.before[word])[:, None]
        return word * 64 + nth.argmax(axis=1)

    def rank(self, x: np.ndarray) -> np.ndarray:
        below = (np.uint64(1) << (x & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[x >> 6] + np.bitwise_count(self.words[x >> 6] & below)


class _Runs:
    """Starts of runs of neighbouring offsets, and the offsets before each run."""

    def __init__(self, low: np.ndarray, first: np.ndarray):
        self.starts = low[first]
        self.before = np.append(first, len(low))

    def select(self, k: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, k, side="right") - 1
        return self.starts[run] + k - self.before[run]

    def rank(self, x: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.starts, x, side="right") - 1
        size = np.diff(self.before)[run]
        return np.where(run < 0, 0, self.before[run] + np.minimum(x - self.starts[run], size))


class BoundarySet:
    """A set of offsets with rank and select."""

    def __init__(self, offsets: np.ndarray):
        """``offsets``: sorted, each once."""
        chunk = offsets >> 16
        keys = np.unique(chunk)
        cuts = np.append(np.searchsorted(chunk, keys), len(offsets))
        self.keys, self.before = keys, cuts
        self.containers = [self._container(offsets[a:b] & (CHUNK - 1)) for a, b in zip(cuts, cuts[1:])]

    @staticmethod
    def _container(low: np.ndarray):
        first = np.flatnonzero(np.concatenate(([True], np.diff(low) != 1)))
        sizes = {"array": 2 * len(low), "bitmap": CHUNK // 8, "runs": 4 * len(first) + 2}
        kind = min(sizes, key=sizes.get)
        return _Runs(low, first) if kind == "runs" else _Array(low) if kind == "array" else _Bitmap(low)

    def __len__(self) -> int:
        return int(self.before[-1])

    def _by_container(self, values: np.ndarray, at: np.ndarray):
        """Container numbers that occur, with the places of their values."""
        order = np.argsort(at, kind="stable")
        for block in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if len(block):
                yield int(at[block[0]]), block

    def select(self, ordinals: np.ndarray) -> np.ndarray:
        """The offsets with so many smaller ones in the set."""
        out = np.empty(len(ordinals), np.int64)
        at = np.searchsorted(self.before, ordinals, side="right") - 1
        for c, block in self._by_container(ordinals, at):
            out[block] = self.keys[c] * CHUNK + self.containers[c].select(ordinals[block] - self.before[c])
        return out

    def rank(self, offsets: np.ndarray) -> np.ndarray:
        """How many offsets of the set are smaller."""
        at = np.searchsorted(self.keys, offsets >> 16)
        out = self.before[at].copy()
        here = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == offsets >> 16))
        for c, block in self._by_container(offsets[here], at[here]):
            out[here[block]] += self.containers[c].rank(offsets[here[block]] & (CHUNK - 1))
        return out


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold a marker."""
    out = np.zeros(len(offsets) - 1, bool)
    open_ = np.flatnonzero(data[:-2] == PREFIX[0]) if len(data) > 2 else np.zeros(0, np.int64)
    letters = [m[1] for m in (PREFIX, SUFFIX, MIDDLE)]
    open_ = open_[(data[open_ + 2] == PREFIX[2]) & np.isin(data[open_ + 1], letters)]
    row = np.searchsorted(offsets, open_, side="right") - 1
    out[row[open_ + 3 <= offsets[row + 1]]] = True
    return out


def _transformed(batches: Iterator[pa.RecordBatch], plain: int, spm: int, stretch: int):
    for batch in batches:
        data_all, offs_all = w.texts_of(batch.column(1))
        draws_all = [batch.column(i).to_numpy() for i in range(2, 6)]
        for lo, hi in w.chunks(offs_all, stretch):
            data, offs = data_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
            h = [x[lo:hi] for x in draws_all]
            places = BoundarySet(np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)))
            before = places.rank(offs)
            n = np.diff(before)
            cuts = np.sort([h[0] % (n + 1), h[1] % (n + 1)], axis=0)
            a, b = places.select(before[:-1] + cuts[0]), places.select(before[:-1] + cuts[1])
            whole = (n == 0) | _marked(data, offs) | (h[2] % 100 >= plain)
            form = np.where(whole, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
            raw, out = data.tobytes(), []
            for kind, s, x, y, e in zip(form, offs[:-1].tolist(), a.tolist(), b.tolist(), offs[1:].tolist()):
                if kind == "plain":
                    out.append(raw[s:e])
                elif kind == "psm":
                    out.append(b"".join((PREFIX, raw[s:x], SUFFIX, raw[y:e], MIDDLE, raw[x:y])))
                else:
                    out.append(b"".join((SUFFIX, raw[y:e], PREFIX, raw[s:x], MIDDLE, raw[x:y])))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(n, pa.int64()),
                    pa.array(form, pa.string()),
                    pa.array(cuts[0], pa.int64(), mask=whole),
                    pa.array(cuts[1] - cuts[0], pa.int64(), mask=whole),
                    pa.array(out, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed: int = 90, spm: int = 20, stretch: int = GROUP_BYTES // 2
) -> DataFrame:
    """doc_id, ``n`` (code points), ``form`` (plain, psm or spm), ``prefix_chars`` and
    ``middle_chars`` (null if plain) and ``output``, one row for each row.

    Draws are the first four 8-digit groups of the SHA-256 of ``seed:id``. The first
    two, modulo n + 1, are the cuts; ``changed`` per cent of the texts are cut, ``spm``
    per cent of these with the suffix first. ``stretch`` bounds a worker's memory only.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest.alias("digest"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select("doc_id", "text", *draws).mapInArrow(
        lambda batches: _transformed(batches, changed, spm, stretch),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string",
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made from."""

    def parts(first: bytes, second: bytes) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(body, second.decode(), 1)
        rest = F.substr(body, F.length(one) + F.lit(len(second) + 1))
        two = F.substring_index(rest, MIDDLE.decode(), 1)
        return one, two, F.substr(rest, F.length(two) + F.lit(len(MIDDLE) + 1))

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = parts(SUFFIX, PREFIX)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix_second, middle_last, suffix_first))
        .otherwise(output)
    )
