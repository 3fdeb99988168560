"""Byte-level BPE encoding and decoding.

Pre-tokens are found without regular expressions. Every code point gets a class
(letter, number, white space, other, and what a look ahead adds: an apostrophe
that a contraction follows, the last of a run of white space). A class is a
transition function on the states of a small automaton; composing functions is
associative, so the state before each code point comes from a scan of compositions
over a whole batch, in blocks. A boundary depends on that state and the class.

The slices feed a cached merge by ranks. Ids keep the code-point offset at which
each pre-token starts, and decoding turns ids back into bytes by a table.

A null text is an empty one: no ids, empty text. Rows keep their id as it is, null
or repeated; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import words as w

#: Ids decoded in one go.
DECODED_IDS = 1 << 17
#: Bytes up to which a list of neighbours is searched instead of a heap.
SHORT_PIECE = 64
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# The white space of Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Contractions of the pattern, by the letters behind the apostrophe.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")

L, N, O, S = 0, 1, 2, 3  # classes of code points by themselves
SHORT, LONG, INNER, PREFIX, ALONE = 4, 5, 6, 7, 8  # and by what follows
FRESH = 9  # added to a class at the start of a text
# States: what the code point before belongs to.
DONE, IN_L, IN_N, IN_O, SPACE, TWO_LEFT, ONE_LEFT, IN_S = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """State after a code point of a class, and whether a pre-token starts at it."""
    if kind >= FRESH:
        state, kind = DONE, kind - FRESH
        return _step(state, kind)[0], True
    if kind == L:
        if state in (TWO_LEFT, ONE_LEFT):
            return (ONE_LEFT if state == TWO_LEFT else DONE), False
        return IN_L, state not in (IN_L, SPACE)
    if kind == N:
        return IN_N, state not in (IN_N, SPACE)
    if kind == O or kind in (SHORT, LONG):
        if state in (IN_O, SPACE):
            return IN_O, False
        return {O: IN_O, SHORT: ONE_LEFT, LONG: TWO_LEFT}[kind], True
    if kind == INNER:
        return IN_S, state != IN_S
    return (SPACE if kind == PREFIX else DONE), True


@cache
def _automaton():
    """Function of each class, products of functions, their values, boundaries."""
    kinds = 2 * FRESH
    functions = [tuple(_step(s, k)[0] for s in range(8)) for k in range(kinds)]
    found: dict[tuple, int] = {}
    for f in functions:
        found.setdefault(f, len(found))
    todo = list(found)
    while todo:
        f = todo.pop()
        for g in functions:
            h = tuple(g[x] for x in f)
            if h not in found:
                found[h] = len(found)
                todo.append(h)
    elements = list(found)
    product = np.zeros((len(elements), len(elements)), np.uint8)
    for i, f in enumerate(elements):
        for j, g in enumerate(elements):
            h = tuple(g[x] for x in f)
            if h not in found:  # products of products are reached through classes
                raise AssertionError("the functions aren't closed under composition")
            product[i, j] = found[h]
    of_class = np.array([found[f] for f in functions], np.uint8)
    from_start = np.array([f[DONE] for f in elements], np.uint8)
    boundary = np.array([[_step(s, k)[1] for k in range(kinds)] for s in range(8)])
    return of_class, product, from_start, boundary


@cache
def _point_class() -> np.ndarray:
    """Class of every code point by itself."""
    from unicodedata import category

    out = np.full(0x110000, O, np.uint8)
    major = np.frombuffer("".join(category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
    out[major == ord("L")] = L
    out[major == ord("N")] = N
    out[WHITE_SPACE] = S
    return out


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the code points of texts laid end to end; ``first``: where a text starts."""
    own = _point_class()[points]
    out = own.copy()
    n = len(points)
    head = np.zeros(n + 2, bool)
    head[first] = True
    head[n:] = True
    after = np.concatenate((own[1:], [S]))
    space = own == S
    inner = head[1 : n + 1] | (after == S)
    out[space] = np.where(inner[space], INNER, np.where(points[space] == 0x20, PREFIX, ALONE))
    quote = np.flatnonzero((points == 0x27) & ~head[1 : n + 1])
    if len(quote):
        one = points[quote + 1]
        two = np.where(head[quote + 2], 0, points[np.minimum(quote + 2, n - 1)])
        out[quote[np.isin(one, [ord(x) for x in ONE_LETTER])]] = SHORT
        for a, b in TWO_LETTERS:
            out[quote[(one == ord(a)) & (two == ord(b))]] = LONG
    out[first] += FRESH
    return out


def _scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Products of all prefixes. Blocks are columns, scanned side by side; the
    products of whole blocks are scanned in the same way."""
    n = len(elements)
    width = max(1, int(n**0.5))
    if n < 64:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], elements[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint8)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    for i in range(1, width):
        grid[i] = product[grid[i - 1], grid[i]]
    before = _scan(np.ascontiguousarray(grid[-1, :-1]), product)
    grid[:, 1:] = product[before[None, :], grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def starts_of(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in texts laid end to end."""
    if not len(points):
        return np.zeros(0, np.int64)
    of_class, product, from_start, boundary = _automaton()
    kinds = classes(points, first)
    states = np.empty(len(points), np.uint8)
    states[0] = DONE
    states[1:] = from_start[_scan(of_class[kinds], product)[:-1]]
    return np.flatnonzero(boundary[states, kinds])


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids end to end, where each starts and how long it is."""
    ranks = _ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    sizes = np.array([len(x) for x in table])
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    get, none = ranks.get, len(ranks)
    cuts = list(range(len(piece) + 1))
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]  # rank of the parts at a cut and behind it
    while pairs and (lowest := min(pairs)) < none:
        i = pairs.index(lowest)
        del cuts[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = get(piece[cuts[i] : cuts[i + 2]], none)
        if i:
            pairs[i - 1] = get(piece[cuts[i - 1] : cuts[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the neighbours of the lowest rank, leftmost first, until none is left.

    Neighbours of short pieces stand in a list; those of longer ones wait in a heap,
    so very long pieces take n log n steps."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT_PIECE:
        return _merge_short(piece, ranks)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != stop:
            continue  # one of the two has been joined to another since
        end[i], end[j] = stop, -1
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Cache(dict):
    """Ids of each pre-token met; emptied when it holds ``most`` of them."""

    def __init__(self, ranks: dict[bytes, int], most: int):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: bytes) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = merge(piece, self.ranks)
        return ids


def _ids_of(data: np.ndarray, starts: np.ndarray, cache_: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces of ``data`` that begin at ``starts``, and how many each has.

    Equal pieces are found first; only distinct ones are looked up and merged."""
    ends = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    found = [cache_[piece] for piece in coded.dictionary.to_pylist()]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
    which = coded.indices.to_numpy()
    counts = sizes[which]
    return flat[w.runs((np.cumsum(sizes) - sizes)[which], counts)], counts


def _encoded(batches: Iterator[pa.RecordBatch], path: str, most: int, stretch: int):
    cache_ = _Cache(_ranks(path), most)
    for batch in batches:
        data_all, offs_all = w.texts_of(batch.column(1))
        for lo, hi in w.chunks(offs_all, stretch):
            data = data_all[offs_all[lo] : offs_all[hi]]
            offs = offs_all[lo : hi + 1] - offs_all[lo]
            heads = np.flatnonzero((data & 0xC0) != 0x80)  # byte at which each code point starts
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            docs = np.searchsorted(heads, offs)
            starts = starts_of(points, docs[:-1][docs[:-1] < docs[1:]])
            ids, sizes = _ids_of(data, heads[starts], cache_)
            tokens_before = np.concatenate(([0], np.cumsum(sizes)))
            cut = np.searchsorted(starts, docs)
            of_doc = np.diff(cut)
            offsets = starts - np.repeat(docs[:-1], of_doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(tokens_before[cut], pa.int32()), pa.array(ids)),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(offsets, pa.int32())),
                ],
                ["doc_id", "ids", "piece_offsets"],
            )


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, cache_pieces: int = 100_000, stretch: int = 1 << 21
) -> DataFrame:
    """doc_id, ``ids`` (token ids of the whole text) and ``piece_offsets`` (code
    point at which each pre-token starts). ``path``: a rank file that every worker
    has; ``cache_pieces`` and ``stretch`` bound a worker's memory only."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        lambda b: _encoded(b, path, cache_pieces, stretch), f"doc_id {kind}, ids array<int>, piece_offsets array<int>"
    )


def bytes_of(ids: np.ndarray, path: str = RANKS) -> np.ndarray:
    """The bytes that token ids stand for."""
    data, at, sizes = _pieces(path)
    return data[w.runs(at[ids], sizes[ids])]


def _decoded(batches: Iterator[pa.RecordBatch], path: str):
    sizes = _pieces(path)[2]
    for batch in batches:
        n = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for lo, hi in w.chunks(np.concatenate(([0], np.cumsum(n, dtype=np.int64))), DECODED_IDS):
            part = batch.slice(lo, hi - lo)
            flat = part.column("ids").flatten().to_numpy(zero_copy_only=False)
            cuts = np.concatenate(([0], np.cumsum(n[lo:hi], dtype=np.int64)))
            ends = np.concatenate(([0], np.cumsum(sizes[flat], dtype=np.int64)))[cuts]
            data = bytes_of(flat, path)
            out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], [*part.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str = RANKS) -> DataFrame:
    """Add ``decoded``: the bytes that ``ids`` stand for, which are the text's UTF-8."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lambda b: _decoded(b, path), schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
