"""Substring dedup: Rabin-Karp hashes of every fixed-length window of words.

Every task hashes the windows of a few MB of texts at once and keeps the first
of equal windows, so a window that a third of all documents share is shipped
once a task. Windows are then dealt by their hash to groups whose number follows
the measured size of the texts; a group counts its hashes and names all
occurrences but the first. Those are dealt back by document, overlapping windows
merge into maximal intervals, and the words in them go. Nothing is capped.

Windows are compared by 64-bit hashes of 64-bit word hashes: over n distinct
windows about n*n/2**65 pairs collide (below 0.001 at 10**8 windows). Set
``check_bytes`` to ship more bits of a second hash where n is far larger.

Order: documents by id (a null id after all others), then by the text's hash, so
rows that share an id but not the text are documents of their own, while rows
equal in both are one document that stands twice: both get its result. A null
text has no words. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words as w
from tidepanel.llm.common import GROUP_BYTES, group_count, spread

LAST = np.iinfo(np.int64).max
PACKED = "part long, docs binary, keys binary, counts binary, hashes binary, checks binary, starts binary"
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string"


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each whole text, to tell texts of one id apart."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    out[full] = w.slice_hashes(data, offsets[full], offsets[full + 1])
    return out


def _pack(part: int, ids, keys, doc, start, hashes=None, checks=None) -> tuple:
    """One row of occurrences, sorted by document and start."""
    new = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    steps = np.diff(start, prepend=0)
    steps[new] = start[new]
    counts = np.diff(np.append(new, len(doc)))
    d = doc[new]
    none = b""
    return (
        part, ids[d].tobytes(), keys[d].tobytes(), w.narrow(counts),
        none if hashes is None else hashes.tobytes(), none if checks is None else checks.tobytes(), w.narrow(steps),
    )


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id, key and start of every occurrence of a packed row."""
    ids, keys = np.frombuffer(row.docs, np.int64), np.frombuffer(row.keys, np.uint64)
    counts = w.widen(row.counts, len(ids))
    steps = w.widen(row.starts, int(counts.sum()))
    sums = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return np.repeat(ids, counts), np.repeat(keys, counts), sums - np.repeat(sums[first] - steps[first], counts)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = [pa.int64()] + [pa.binary()] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)


def _windows_of(batches: Iterator[pa.RecordBatch], n: int, parts: int, buckets: int, check: int):
    """Occurrences of windows by hash (part 0 and up), and those that already
    have an earlier one in the same stretch by document (part below 0)."""
    for batch in batches:
        ids_all, texts = _ids(batch.column(0)), batch.column(1)
        order = np.argsort(ids_all, kind="stable")
        data_all, offs_all = w.texts_of(texts.take(pa.array(order)))
        ids_all = ids_all[order]
        for lo, hi in w.chunks(offs_all, GROUP_BYTES // 2):
            data, offs = data_all[offs_all[lo] : offs_all[hi]], offs_all[lo : hi + 1] - offs_all[lo]
            rows = list(_stretch(data, offs, ids_all[lo:hi], n, parts, buckets, check))
            if rows:
                yield _packed(rows)


def _stretch(data, offs, ids, n, parts, buckets, check):
    keys = _keys(data, offs)
    # Rows equal in id and text are one document: only the first ships windows.
    ranks = np.lexsort((keys, ids))
    same = (ids[ranks][1:] == ids[ranks][:-1]) & (keys[ranks][1:] == keys[ranks][:-1])
    again = np.zeros(len(ids), bool)
    again[ranks[1:][same]] = True
    place = np.empty(len(ids), np.int64)
    place[ranks] = np.arange(len(ids))
    starts, ends, first = w.bounds(data, offs)
    hashes = w.slice_hashes(data, starts, ends)
    windows = w.window_hashes(hashes, n)
    at = np.flatnonzero(w.inside(first, n))
    doc = np.repeat(np.arange(len(ids)), np.diff(first))[at]
    keep = ~again[doc]
    at, doc = at[keep], doc[keep]
    if not len(at):
        return
    value, start = windows[at], at - first[doc]
    extra = None
    if check:
        second = w.window_hashes(w.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), n)[at]
        extra = second.view(np.uint8).reshape(-1, 8)[:, :check]
    # place is not yet the order of ``at`` where texts of one id stand out of order
    if (np.diff(place[doc]) < 0).any():
        o = np.argsort(place[doc], kind="stable")
        at, doc, value, start = at[o], doc[o], value[o], start[o]
        extra = extra[o] if check else None
    o = np.argsort(value, kind="stable")
    later = np.zeros(len(o), bool)
    later[1:] = value[o[1:]] == value[o[:-1]]
    if check:
        later[1:] &= (extra[o[1:]] == extra[o[:-1]]).all(axis=1)
    firsts, rest = np.sort(o[~later]), np.sort(o[later])
    part = (value[firsts] % np.uint64(parts)).astype(np.int64)
    yield from _dealt(part, firsts, lambda p, i: _pack(p, ids, keys, doc[i], start[i], value[i], extra[i] if check else None))
    if len(rest):
        yield from _dealt(spread(ids, buckets)[doc[rest]], rest, lambda p, i: _pack(-1 - p, ids, keys, doc[i], start[i]))


def _dealt(part: np.ndarray, items: np.ndarray, pack):
    o = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[o])) + 1
    for block in np.split(o, cuts):
        if len(block):
            yield pack(int(part[block[0]]), items[block])


def _later(group: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """All occurrences of a group's hashes but the first of each."""
    names = [x.split()[0] for x in PACKED.split(", ")]
    if group["part"].iloc[0] < 0:
        return group[names]
    ids, keys, starts = map(np.concatenate, zip(*map(_unpack, group.itertuples())))
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hashes"]])
    o = np.argsort(hashes, kind="stable")
    same = hashes[o[1:]] == hashes[o[:-1]]
    twice = np.zeros(len(o), bool)
    twice[1:] |= same
    twice[:-1] |= same
    o = o[twice]
    sort = [starts[o], keys[o], ids[o], hashes[o]]
    checks = None
    if len(group["checks"].iloc[0]):
        raw = np.concatenate([np.frombuffer(x, np.uint8) for x in group["checks"]]).reshape(len(hashes), -1)
        checks = np.zeros((len(o), 8), np.uint8)
        checks[:, : raw.shape[1]] = raw[o]
        sort.insert(3, checks.view(np.uint64)[:, 0])
    s = np.lexsort(sort)
    o = o[s]
    later = np.zeros(len(o), bool)
    later[1:] = hashes[o[1:]] == hashes[o[:-1]]
    if checks is not None:
        seen = checks.view(np.uint64)[s, 0]
        later[1:] &= seen[1:] == seen[:-1]
    # Earlier means a smaller place: a document standing twice is not earlier than itself.
    head = np.maximum.accumulate(np.where(later, 0, np.arange(len(o))))
    f = o[head]
    o = o[later & ~((ids[o] == ids[f]) & (keys[o] == keys[f]) & (starts[o] == starts[f]))]
    if not len(o):
        return pd.DataFrame(columns=names)
    o = o[np.lexsort((starts[o], keys[o], ids[o]))]
    ids, keys, starts = ids[o], keys[o], starts[o]
    doc = np.cumsum(np.concatenate(([0], (np.diff(ids) != 0) | (np.diff(keys) != 0))))
    at = np.flatnonzero(np.concatenate(([True], np.diff(doc) > 0)))
    d_ids, d_keys = ids[at], keys[at]
    rows = _dealt(spread(d_ids, buckets)[doc], np.arange(len(doc)), lambda p, i: _pack(-1 - p, d_ids, d_keys, doc[i], starts[i]))
    return pd.DataFrame(list(rows), columns=names)


def _texts_of(batches: Iterator[pa.RecordBatch], buckets: int):
    """Whole texts of each bucket, compressed together for the way."""
    for batch in batches:
        ids, texts = _ids(batch.column(0)), batch.column(1).fill_null("")
        part = spread(ids, buckets)
        o = np.argsort(part, kind="stable")
        rows, pack = [], zstandard.ZstdCompressor(level=1)
        for block in np.split(o, np.flatnonzero(np.diff(part[o])) + 1):
            if not len(block):
                continue
            data, offs = w.texts_of(texts.take(pa.array(block)))
            rows.append((int(part[block[0]]), ids[block].tobytes(), offs.tobytes(), pack.compress(data.tobytes())))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 3)], ["bucket", "docs", "offsets", "texts"]
            )


def _cut(texts: pd.DataFrame, found: pd.DataFrame, n: int) -> pd.DataFrame:
    """Merge windows into maximal intervals and take their words out."""
    marks: dict[tuple, list[np.ndarray]] = {}
    for row in found.itertuples():
        ids, keys, starts = _unpack(row)
        cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(keys) != 0)) + 1
        at = np.concatenate(([0], cuts)).astype(int)
        for a, b in zip(at, np.append(at[1:], len(ids))):
            marks.setdefault((int(ids[a]), int(keys[a])), []).append(starts[a:b])
    unpack, out = zstandard.ZstdDecompressor(), []
    for row in texts.itertuples():
        data = np.frombuffer(unpack.decompress(row.texts), np.uint8) if row.texts else np.zeros(0, np.uint8)
        offs, ids = np.frombuffer(row.offsets, np.int64), np.frombuffer(row.docs, np.int64)
        for i, key in enumerate(_keys(data, offs)):
            parts = data[offs[i] : offs[i + 1]].tobytes().split()
            spans, gone = [], 0
            if found_here := marks.get((int(ids[i]), int(key))):
                s = np.sort(np.concatenate(found_here))
                new = np.concatenate(([True], s[1:] > s[:-1] + n))
                spans = list(zip(s[new].tolist(), (s[np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)] + n).tolist()))
                gone = sum(b - a for a, b in spans)
                kept, last = [], 0
                for a, b in spans:
                    kept += parts[last:a]
                    last = b
                total, parts = len(parts), kept + parts[last:]
            else:
                total = len(parts)
            doc = None if ids[i] == LAST else int(ids[i])
            out.append((doc, total, gone, [{"start": a, "end": b} for a, b in spans], b" ".join(parts).decode()))
    return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "removed", "kept_text"]).astype({"doc_id": "Int64"})


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, check_bytes: int = 0, group_bytes: int = GROUP_BYTES
) -> DataFrame:
    """Texts without the words of every window of ``window`` words that occurs earlier.

    Returns doc_id, n_words, n_removed, ``removed`` (maximal intervals of word
    numbers, end exclusive) and ``kept_text`` (kept words joined by one space).
    A text of fewer than ``window`` words, an empty and a null one lose nothing.
    ``check_bytes`` (0 to 8): bytes of a second hash that must agree as well.
    """
    parts = group_count(docs, text_col, group_bytes)
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spots = only.mapInArrow(lambda b: _windows_of(b, window, parts, parts, check_bytes), PACKED)
    later = spots.groupBy("part").applyInPandas(lambda g: _later(g, parts), PACKED)
    by_bucket = later.select((-1 - F.col("part")).alias("bucket"), "docs", "keys", "counts", "starts")
    texts = only.mapInArrow(lambda b: _texts_of(b, parts), "bucket long, docs binary, offsets binary, texts binary")
    return (
        texts.groupBy("bucket").cogroup(by_bucket.groupBy("bucket")).applyInPandas(lambda a, b: _cut(a, b, window), RESULT)
    )
