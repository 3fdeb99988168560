"""Phrase collocations from an FM-index of word ids in every shard.

A shard is some MB of texts of one language that a task reads one after the other;
texts are never shuffled. Its words become numbers, its pieces are laid end to end
with a sentinel behind each, and suffixes are sorted by their first words up to the
depth asked for: the words before them are the Burrows-Wheeler transform, which with
the vocabulary's hashes is all that is stored.

Intervals of the index are extended in both directions, all of them at once. To the
left, the rows of each interval fall apart by the word before them and move, in their
order, to the rows that start with that word; to the right, the intervals of the next
depth lie inside. So every phrase of one more word knows its count in the shard, the
phrase without its first and the one without its last word.

Counts of a depth are summed over shards before the next one starts, and only phrases
whose two shorter ones are frequent everywhere are enumerated and shipped at all. A
shard ships a phrase once, however often it occurs. Frequent phrases return to the
shards by broadcast up to a measured number, and beyond it only to the shards that
hold them. What else is told of a frequent phrase comes from one of its shards.

A phrase travels as a 64-bit hash of its words and language: over n distinct phrases
about n * n / 2**65 pairs collide. Its text is put together from those of its two
shorter phrases, once frequent ones are known.

A null text has no words, a null language is ``und``. Repeated rows count as often as
they stand there. Only the two named columns are read. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import common
from tidepanel.llm import words as w

#: Bytes of text of a shard at about; a piece is never cut.
SHARD_BYTES = 4 << 20
#: Text that waits in a task for its shard to fill, in shards.
HELD_SHARDS = 4
#: Rows of a batch that goes back to Spark, and of those taken from one at a time.
BATCH_ROWS, ROWS = 1 << 15, 500
#: Frequent phrases of a depth up to this many go to all shards (8 bytes each).
BROADCAST_GRAMS = 2_000_000
#: Rows of a joined side up to which it is broadcast (about 100 bytes each).
BROADCAST_ROWS = 200_000

SPACE, BREAK = 0x20, 0x0A
_LETTERS = w.LOWER.copy()
_LETTERS[[0x20, 0x09]] = SPACE
_LETTERS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = BREAK

INDEX = "shard long, lang string, n_words long, words array<string>, hashes binary, bwt binary"
COUNTS = "shard long, h long, n long"
LINKS = "shard long, h long, pre long, suf long"
WORDS = "shard long, h long, lang string, word string"


def _suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a circular text, sorted by the ``depth`` or more symbols from there on."""
    ranks, known = text.astype(np.int64), 1
    while known < depth:
        key = ranks * (int(ranks.max()) + 1) + np.roll(ranks, -known)
        order = np.argsort(key, kind="stable")
        ranks = np.empty(len(text), np.int64)
        ranks[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        known *= 2
    return np.argsort(ranks, kind="stable")


def _index(data: np.ndarray, offsets: np.ndarray, lang: str, depth: int, shard: int) -> tuple | None:
    """Row of INDEX for texts laid end to end, letters as in _LETTERS."""
    starts, ends, first = w.bounds(data, offsets)
    if not len(starts):
        return None
    breaks = np.searchsorted(np.flatnonzero(data == BREAK), starts)
    new = np.diff(breaks, prepend=-1) != 0
    new[first[:-1][first[:-1] < len(starts)]] = True
    seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
    hashes, sample, ids = np.unique(w.mix(w.slice_hashes(data, starts, ends) ^ seed), return_index=True, return_inverse=True)
    place = np.arange(len(ids)) + np.cumsum(new) - 1  # a sentinel stands before each piece but the first
    text = np.zeros(place[-1] + 2, np.int32)
    text[place] = ids + 1
    bwt = text[_suffix_order(text, depth) - 1]
    words = [data[a:b].tobytes().decode() for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
    return shard, lang, len(ids), words, hashes.tobytes(), zstandard.ZstdCompressor(level=1).compress(bwt.tobytes())


def _cut(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """Offsets with more of them at ends of pieces, where texts are longer than ``size``."""
    if (np.diff(offsets) <= size).all():
        return offsets
    at = np.flatnonzero(data == BREAK) + 1
    marks = np.searchsorted(at, np.arange(size, len(data), size))
    return np.union1d(offsets, at[np.unique(marks[marks < len(at)])])


def _indexed(batches: Iterator[pa.RecordBatch], depth: int, size: int):
    held: dict[str, list[pa.Array]] = {}
    base, count, kinds = TaskContext.get().partitionId() << 32, 0, [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def flush(lang: str):
        nonlocal count
        data, offs = w.texts_of(pa.concat_arrays(held.pop(lang)))
        waiting.pop(lang)
        data = _LETTERS[data]
        offs = _cut(data, offs, size)
        for lo, hi in w.chunks(offs, size):
            row = _index(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], lang, depth, base + count)
            count += 1
            if row is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], [x.split()[0] for x in INDEX.split(", ")])
        pa.default_memory_pool().release_unused()

    waiting: dict[str, int] = {}
    for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
        codes = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
        numbers, texts = codes.indices.to_numpy(), batch.column(1).cast(pa.large_string()).fill_null("")
        for i, lang in enumerate(codes.dictionary.to_pylist()):
            part = texts.take(pa.array(np.flatnonzero(numbers == i)))
            held.setdefault(lang, []).append(part)
            waiting[lang] = waiting.get(lang, 0) + int(pc.sum(pc.binary_length(part)).as_py() or 0)
        # A language waits until it fills a shard, as long as all of them fit a few shards.
        everything = sum(waiting.values()) >= HELD_SHARDS * size
        for lang in [x for x, n in waiting.items() if everything or n >= size]:
            yield from flush(lang)
    for lang in list(waiting):
        yield from flush(lang)


class Level(NamedTuple):
    """Intervals of the phrases of one length, in the order of suffixes."""

    rows: np.ndarray  #: number of the interval that each row of the index is in
    starts: np.ndarray  #: first row of each interval
    hashes: np.ndarray  #: of each interval's phrase
    open: np.ndarray  #: whether to extend it: no sentinel inside, and frequent
    prefix: np.ndarray  #: interval, one word shorter, of the phrase without its last word
    suffix: np.ndarray  #: and without its first word

    def counts(self) -> np.ndarray:
        return np.diff(self.starts, append=len(self.rows))


class FMIndex:
    """Burrows-Wheeler transform over word numbers; number 0 is the end of a piece."""

    def __init__(self, bwt: np.ndarray, hashes: np.ndarray):
        sizes = np.bincount(bwt, minlength=len(hashes) + 1)
        self.first = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)  # first word of each row
        self.order = np.argsort(bwt, kind="stable").astype(np.int32)  # the row whose word before is that first word
        self.starts = np.cumsum(sizes) - sizes
        self.hashes = np.concatenate(([np.uint64(0)], hashes))

    def single(self) -> Level:
        none = np.zeros(len(self.starts), np.int32)
        return Level(self.first, self.starts, self.hashes, np.arange(len(self.starts)) > 0, none, none)

    def extend(self, level: Level) -> Level:
        """Phrases of one more word: each interval by the words before its rows."""
        behind = level.rows[self.order]
        new = np.empty(len(behind), bool)
        new[0] = True
        new[1:] = (behind[1:] != behind[:-1]) | (self.first[1:] != self.first[:-1])
        starts = np.flatnonzero(new)
        word, suffix, prefix = self.first[starts], behind[starts], level.rows[starts]
        hashes = w.mix(level.hashes[suffix] * w.END_MARK + self.hashes[word])
        open_ = (word != 0) & level.open[suffix] & level.open[prefix]
        return Level(np.cumsum(new, dtype=np.int32) - np.int32(1), starts, hashes, open_, prefix, suffix)


class Frequent(NamedTuple):
    """Hashes of frequent phrases, sorted, and for each the shard that tells more of it."""

    hashes: np.ndarray
    owners: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Frequent:
        hashes, owners = (table.column(c).to_numpy().astype(np.int64) for c in ("h", "shard"))
        order = np.argsort(hashes.view(np.uint64), kind="stable")
        return Frequent(hashes.view(np.uint64)[order], owners[order])

    def holds(self, values: np.ndarray, shard: int | None = None) -> np.ndarray:
        """Which values are among them, and owned by ``shard`` if one is given."""
        if not len(self.hashes):
            return np.zeros(len(values), bool)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        found = self.hashes[at] == values
        return found if shard is None else found & (self.owners[at] == shard)


def _unpacked(bwt: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bwt), np.int32)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Shards one at a time; only one is ever held as Python values."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _phrases(hashes: bytes, bwt: bytes, length: int, frequent: Frequent) -> tuple[Level, Level]:
    """Levels of ``length`` - 1 and ``length`` words; the first holds only ``frequent``."""
    index = FMIndex(_unpacked(bwt), np.frombuffer(hashes, np.uint64))
    level = index.single()
    for _ in range(length - 2):
        level = index.extend(level)
    level = level._replace(open=level.open & frequent.holds(level.hashes))
    return level, index.extend(level)


def _batches(names: str, *columns) -> Iterator[pa.RecordBatch]:
    """Equally long arrays as batches of some rows."""
    heads = [x.split()[0] for x in names.split(", ")]
    for lo in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + BATCH_ROWS]) for c in columns], heads)


def _counted(shard: int, _: Level, level: Level) -> Iterator[pa.RecordBatch]:
    """COUNTS of the phrases of a shard."""
    at = np.flatnonzero(level.open)
    return _batches(COUNTS, np.full(len(at), shard), level.hashes[at].view(np.int64), level.counts()[at].astype(np.int64))


def _linked(shard: int, below: Level, level: Level, among: Frequent | None = None) -> Iterator[pa.RecordBatch]:
    """LINKS of the phrases of a shard, of those in ``among`` that it owns if that is given."""
    at = np.flatnonzero(level.open if among is None else level.open & among.holds(level.hashes, shard))
    columns = [level.hashes[at], below.hashes[level.prefix[at]], below.hashes[level.suffix[at]]]
    return _batches(LINKS, np.full(len(at), shard), *(x.view(np.int64) for x in columns))


def _word_counts(batches: Iterator[pa.RecordBatch]):
    for row in _rows(batches):
        hashes = np.frombuffer(row["hashes"], np.int64)
        n = np.bincount(_unpacked(row["bwt"]), minlength=len(hashes) + 1)[1:]
        yield from _batches(COUNTS, np.full(len(n), row["shard"]), hashes, n)


def _spellings(frequent=None):
    """Words of every shard, those in ``frequent`` (broadcast) that it owns if that is given."""

    def emit(batches):
        for row in _rows(batches):
            hashes = np.frombuffer(row["hashes"], np.uint64)
            at = np.arange(len(hashes)) if frequent is None else np.flatnonzero(frequent.value.holds(hashes, row["shard"]))
            words = np.array(row["words"], object)[at]
            yield from _batches(WORDS, np.full(len(at), row["shard"]), hashes[at].view(np.int64), np.full(len(at), row["lang"], object), words)

    return emit


def _extending(length: int, frequent, give, among=None):
    """What ``give`` tells of every shard's phrases, extended from ``frequent`` ones."""

    def emit(batches):
        extra = () if among is None else (among.value,)
        for row in _rows(batches):
            yield from give(row["shard"], *_phrases(row["hashes"], row["bwt"], length, frequent.value), *extra)

    return emit


def _meeting(length: int, give, schema: str):
    """The same of one shard, extended from those rows of the other side that are its own."""

    def meet(shard, own):
        found = []
        if shard.num_rows and own.num_rows:
            row = shard.to_pylist()[0]
            found = list(give(row["shard"], *_phrases(row["hashes"], row["bwt"], length, Frequent.of(own))))
        names = [x.split()[0] for x in schema.split(", ")]
        return pa.Table.from_batches(found, pa.schema([(x, pa.int64()) for x in names]))

    return meet


class Counts(NamedTuple):
    """What count() found: words of each language, and frequent phrases by length.

    ``phrases[0]``: h, f, lang, phrase; the others: h, f, pre, suf, where pre and suf are
    h of the phrase without its last and without its first word."""

    totals: DataFrame
    phrases: list[DataFrame]


def count(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 5,
    least: int = 100,
    shard_bytes: int = SHARD_BYTES,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> Counts:
    """Phrases of up to ``longest`` words that occur ``least`` times or more in a language."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    index = common.written(rows.mapInArrow(lambda b: _indexed(b, longest, shard_bytes), INDEX), "fm-index")
    totals = common.written(index.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    blobs = index.select("shard", "hashes", "bwt")

    def frequent_of(phrases: DataFrame):
        """Their hashes and owners, broadcast; None where there are too many."""
        few = phrases.count() <= broadcast_grams
        return spark.sparkContext.broadcast(Frequent.of(phrases.select("h", "shard").toArrow())) if few else None

    def summed(grams: DataFrame, label: str) -> DataFrame:
        both = grams.groupBy("h").agg(F.sum("n").alias("f"), F.min("shard").alias("shard"))
        return common.written(both.where(F.col("f") >= least), label)

    grams = blobs.mapInArrow(_word_counts, COUNTS)
    known = summed(grams, "words")
    few = frequent_of(known)
    spellings = index.select("shard", "hashes", "lang", "words").mapInArrow(_spellings(few), WORDS)
    if few is None:
        spellings = spellings.join(known.select("h", "shard"), ["h", "shard"], "left_semi")
    named = spellings.select("h", "lang", F.col("word").alias("phrase"))
    found = [common.written(known.drop("shard").join(named, "h"), "phrases-1")]
    for length in range(2, longest + 1):
        before = few
        if before is None:  # each shard gets those of its own phrases that are frequent
            own = common.written(grams.select("shard", "h").join(known.select("h"), "h", "left_semi"), "own")
            pairs = blobs.groupBy("shard").cogroup(own.groupBy("shard"))
            grams = pairs.applyInArrow(_meeting(length, _counted, COUNTS), COUNTS)
        else:
            grams = blobs.mapInArrow(_extending(length, before, _counted), COUNTS)
        known = summed(grams, f"counts-{length}")
        few = frequent_of(known)
        if before is None:
            links = pairs.applyInArrow(_meeting(length, _linked, LINKS), LINKS)
        else:
            links = blobs.mapInArrow(_extending(length, before, _linked, few), LINKS)
        if before is None or few is None:
            links = links.join(known.select("h", "shard"), ["h", "shard"], "left_semi")
        found.append(common.written(known.drop("shard").join(links.drop("shard"), "h"), f"phrases-{length}"))
    return Counts(totals, found)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spelled(counts: Counts) -> list[DataFrame]:
    """Phrases of each length with h, f, lang, ``phrase`` and the counts of all their
    beginnings (``heads``) and ends (``tails``), shortest first."""
    none = F.array().cast("array<bigint>")
    out = [counts.phrases[0].select("h", "f", "lang", "phrase", none.alias("heads"), none.alias("tails"))]
    for longer in counts.phrases[1:]:
        shorter, n = out[-1], out[-1].count()
        begin = shorter.select(F.col("h").alias("pre"), "lang", F.col("phrase").alias("begin"), F.array_append("heads", F.col("f")).alias("heads"))
        end = shorter.select(F.col("h").alias("suf"), F.substring_index("phrase", " ", -1).alias("last"), F.array_append("tails", F.col("f")).alias("tails"))
        made = longer.join(_small(begin, n), "pre").join(_small(end, n), "suf")
        phrase = F.concat_ws(" ", "begin", "last").alias("phrase")
        out.append(common.written(made.select("h", "f", "lang", phrase, "heads", "tails", "pre", "suf"), "spelled"))
    return out


#: The lowest cut of a phrase: heads[k] and tails[size - k] are the counts of both parts.
LOWEST = """
array_min(transform(sequence(1, size(heads)), k -> named_struct(
  'score', (cast(1000 * f as decimal(19, 0)) * cast(n as decimal(19, 0)))
    div (cast(heads[k - 1] as decimal(19, 0)) * cast(tails[size(heads) - k] as decimal(19, 0))),
  'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k])))
"""


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = 5,
    least: int = 100,
    covered: int = 100,
    best: int = 2000,
    shard_bytes: int = SHARD_BYTES,
    broadcast_grams: int = BROADCAST_GRAMS,
) -> DataFrame:
    """The ``best`` phrases of each language by lowest cut score.

    Phrases are 2 to ``longest`` words of one piece (lower case A-Z; pieces end at
    ``.,;:!?`` and line ends) that occur ``least`` times or more. One goes where a longer
    frequent phrase holds it and has ``covered`` per cent of its count or more; as every
    phrase between the two has at least the longer one's count, those of one more word
    tell. Returns lang, rank, phrase, a, l, r, n, score, k (words of the first part), and
    how many frequent phrases have one more word at the left and at the right."""
    counts = count(docs, text_col, lang_col, longest, least, shard_bytes, broadcast_grams)
    levels = spelled(counts)
    sides = [[x.select(F.col(c).alias("h"), "f", F.lit(c == "suf").cast("long").alias("left")) for c in ("pre", "suf")] for x in levels[2:]]
    phrases = levels[1].drop("pre", "suf") if longest > 1 else None
    if phrases is None:
        raise ValueError("phrases need two words")
    for x in levels[2:]:
        phrases = phrases.unionByName(x.drop("pre", "suf"))
    around = None
    for x in (y for pair in sides for y in pair):
        around = x if around is None else around.unionByName(x)
    if around is None:
        phrases = phrases.select("*", F.lit(0).cast("long").alias("top"), F.lit(0).cast("long").alias("lefts"), F.lit(0).cast("long").alias("rights"))
    else:
        around = around.groupBy("h").agg(F.max("f").alias("top"), F.sum("left").alias("lefts"), F.sum(1 - F.col("left")).alias("rights"))
        phrases = phrases.join(around, "h", "left").fillna(0, ["top", "lefts", "rights"])
    kept = phrases.where(100 * F.col("top") < F.lit(covered) * F.col("f"))
    totals = counts.totals
    scored = kept.join(_small(totals, totals.count()), "lang").withColumn("cut", F.expr(LOWEST))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score",
        F.col("cut.k").cast("long").alias("k"), F.col("lefts").alias("left_extensions"), F.col("rights").alias("right_extensions"),
    )
