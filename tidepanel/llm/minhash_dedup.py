"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is that of its distinct shingles of ``size`` words after A-Z are
lower-cased; its sketch is the ``k`` least hashes of the set. Equal sets collapse
to one representative first. Inverted lists of the retained values then give
overlaps, in this order, each step losing no pair above the threshold but with
the stated odds:

* Two sets of similarity t share at least ``required`` sketch values (for k = 64,
  t = 0.85: 36, missed with odds below 1e-8; for sets of at most k shingles always).
  So values that only one set retains are left out, and so are sets with too few
  others: a passage or line that many documents share makes no candidates.
* Two such sets meet in the lists of their rarest ``s - required + 1`` values.
* Every member of a list is compared with its most central document, the one whose
  values are retained most often. Estimates over the union's sketch filter the
  pairs; the exact similarity of whole sets confirms. Confirmed links give first
  components.
* Only lists that still hold several components are taken further. Members outside
  the list's largest component are compared with those of other components. Short
  lists do it by a join. Documents of long ones form families by the lists they
  share. There, whole sets are used: shingles that no other set of the family has
  bound the similarity that a set can reach at all, which leaves out most strays of
  a large group of copies without comparing any pair. The others are compared in
  blocks of bounded size, which return one exact link for each stray and component.
  So no group is expanded into all pairs, and none is capped.

Sets hold 64-bit hashes of shingles. Rows that share an id count as one document
linked by any of their texts. A null id can't be named: its row is kept, with a
null component. Null, empty and blank texts have no shingle and no link. Columns
other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, floor, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import words as w
from tidepanel.llm.common import written
from tidepanel.llm.graph import components

STRETCH = 2 << 20
#: Lists up to this length are joined, longer ones compared in blocks of BLOCK rows.
SHORT_LIST, BLOCK = 64, 256
#: Deviations of the estimate below the threshold that a pair may show.
SLACK = 6.4
#: Ids of candidates are broadcast up to this many (8 MB), and shuffled beyond.
BROADCAST_IDS = 1_000_000


def shingles(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text."""
    data = w.LOWER[data]
    starts, ends, first = w.bounds(data, offs)
    values = w.window_hashes(w.slice_hashes(data, starts, ends), size).view(np.int64)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(values[lo : hi - size + 1]))
        elif hi > lo:
            whole = b" ".join(data[starts[i] : ends[i]].tobytes() for i in range(lo, hi))
            out.append(np.frombuffer(hashlib.blake2b(whole, digest_size=8).digest(), np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _sketched(batches: Iterator[pa.RecordBatch], size: int, k: int):
    for batch in batches:
        data, offs = w.texts_of(batch.column(1))
        for lo, hi in w.chunks(offs, STRETCH):
            sets = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            cuts = np.concatenate(([0], np.cumsum([min(len(s), k) for s in sets])))
            values = np.concatenate([s[:k] for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values)),
                ],
                ["doc_id", "n_shingles", "print", "sketch"],
            )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, k: int = 64) -> DataFrame:
    """doc_id, n_shingles, ``print`` (128 bits of the whole set), sketch (k least hashes)."""
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return only.mapInArrow(lambda b: _sketched(b, size, k), "doc_id long, n_shingles long, print binary, sketch array<long>")


def required(s: int, k: int, t: float) -> int:
    """Sketch values that a sketch of ``s`` shares with any of similarity ``t``."""
    if s >= k:
        return max(1, floor(t * k - SLACK * sqrt(k * t * (1 - t))))
    return max(1, min(ceil(t * s - 1e-9), floor(k - (1 - t) * s / t)))


def _estimated(a: Column, b: Column, na: Column, nb: Column, k: int, t: float) -> Column:
    """Whether the sketch of the union allows a similarity of ``t``."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    width = F.size(union)
    share = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    slack = F.when((na <= k) & (nb <= k), 1e-9).otherwise(SLACK * F.sqrt(width * (t * (1 - t))))
    return share >= t * width - slack


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, percent: int):
    last, own = None, None
    for batch in batches:
        a, b, texts_a, texts_b = batch.columns
        data, offs = w.texts_of(texts_b)
        keep = np.zeros(len(batch), bool)
        for lo, hi in w.chunks(offs, STRETCH):
            sets = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
            for i, other in zip(range(lo, hi), sets):
                text = texts_a[i].as_py() or ""
                if text != last:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    last, own = text, shingles(raw, np.array([0, len(raw)]), size)[0]
                both = np.intersect1d(own, other, assume_unique=True).size
                keep[i] = both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))


def _sets(batches: Iterator[pa.RecordBatch], size: int):
    for batch in batches:
        data, offs = w.texts_of(batch.column(1))
        for lo, hi in w.chunks(offs, STRETCH):
            sets = shingles(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], size)
            cuts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc", "whole"])


def _common(a: list[np.ndarray], b: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of sets: all of ``a`` with all of ``b``."""
    both = np.zeros((len(a), len(b)), np.float32)
    values, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    cut = sum(map(len, a))
    rows_a, rows_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    shared = np.flatnonzero((np.bincount(place[:cut], minlength=len(values)) > 0) & (np.bincount(place[cut:], minlength=len(values)) > 0))
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    col_a, col_b = column[place[:cut]], column[place[cut:]]
    for lo in range(0, len(shared), width):
        tables = []
        for rows, col, n in ((rows_a, col_a, len(a)), (rows_b, col_b, len(b))):
            here = (col >= lo) & (col < lo + width)
            table = np.zeros((n, min(width, len(shared) - lo)), np.float32)
            table[rows[here], col[here] - lo] = 1
            tables.append(table)
        both += tables[0] @ tables[1].T
    return both


def _blocks(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """One link for each stray of a block and each other component that it meets."""
    q, m = group[group["stray"]], group[~group["stray"]]
    none = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    if not len(q) or not len(m):
        return none

    def similar(common, n):
        return 100 * common >= percent * (n - common)

    sizes = np.add.outer(q["n"].to_numpy(), m["n"].to_numpy())
    most = np.minimum.outer(q["shared"].to_numpy(), m["shared"].to_numpy())
    able = similar(most, sizes) & (q["component"].to_numpy()[:, None] != m["component"].to_numpy()[None, :])
    i, j = np.flatnonzero(able.any(axis=1)), np.flatnonzero(able.any(axis=0))
    if not len(i):
        return none
    common = _common([q["whole"].iloc[x] for x in i], [m["whole"].iloc[x] for x in j]).astype(np.int64)
    x, y = np.nonzero(able[np.ix_(i, j)] & similar(common, sizes[np.ix_(i, j)]))
    found = pd.DataFrame({"x": q["doc"].to_numpy()[i[x]], "y": m["doc"].to_numpy()[j[y]], "component": m["component"].to_numpy()[j[y]]})
    found = found.drop_duplicates(["x", "component"])
    return pd.DataFrame({"a": found[["x", "y"]].min(axis=1), "b": found[["x", "y"]].max(axis=1)})


class _Search:
    """Candidate pairs, filtered and confirmed, of one set of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, k: int, percent: int):
        self.size, self.k, self.percent, self.t = size, k, percent, percent / 100
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.rows = written(sketches(docs, id_col, text_col, size, k), "sketches")
        self.first = written(self.rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("doc")), "prints")
        kept = self.rows.join(self.first, (F.col("doc") == F.col("doc_id")) & (self.rows["print"] == self.first["print"]))
        sets = kept.select("doc", "n_shingles", "sketch", F.size("sketch").alias("s"))
        need = F.element_at(F.array(*[F.lit(required(s, k, self.t)) for s in range(1, k + 1)]), F.col("s"))
        values = sets.select("doc", "n_shingles", "s", need.alias("need"), F.explode("sketch").alias("v"))
        shared = values.groupBy("v").agg(F.count("*").alias("times")).where("times > 1")
        # The s - need + 1 rarest values, less those that only this set retains.
        met = values.join(shared, "v").groupBy("doc", "n_shingles", "s", "need").agg(F.sort_array(F.collect_list(F.struct("times", "v"))).alias("vs"))
        met = met.where(F.size("vs") >= F.col("need"))
        weight = F.aggregate("vs", F.lit(0).cast("long"), lambda acc, x: acc + x["times"]).alias("weight")
        heads = met.select("doc", weight, F.explode(F.slice("vs", F.lit(1), F.size("vs") - F.col("need") + 1)).alias("x"))
        self.postings = written(heads.select("doc", "weight", F.col("x.v").alias("v")), "postings")
        self.sets = written(sets.join(self.postings.select("doc").distinct(), "doc", "left_semi").select("doc", "n_shingles", "sketch"), "sets")

    def texts(self, ids: DataFrame, n: int) -> DataFrame:
        """doc_id, text of ``n`` documents, found without shuffling texts while ``n`` is small."""
        return self.docs.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a < b) whose whole sets are similar enough."""
        x = self.sets.select(F.col("doc").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
        y = self.sets.select(F.col("doc").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
        near = (100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & _estimated(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"), self.k, self.t)
        chosen = written(pairs.join(x, "a").join(y, "b").where(near).select("a", "b"), "pairs")
        ids = chosen.select(F.col("a").alias("doc_id")).union(chosen.select("b")).distinct()
        texts = self.texts(ids, 2 * chosen.count())
        of_b = chosen.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        both = of_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
        size, percent = self.size, self.percent
        return written(both.mapInArrow(lambda r: _confirmed(r, size, percent), "a long, b long").distinct(), "links")

    def to_centre(self) -> DataFrame:
        """Every member of a list with the list's most central document."""
        centre = self.postings.groupBy("v").agg(F.max(F.struct("weight", -F.col("doc"))).alias("top"), F.count("*").alias("n")).where("n > 1")
        centre = centre.select("v", (-F.col("top.col2")).alias("c"))
        pairs = self.postings.join(centre, "v").where("c <> doc")
        return pairs.select(F.least("doc", "c").alias("a"), F.greatest("doc", "c").alias("b")).distinct()

    def mixed(self, found: DataFrame) -> DataFrame:
        """v, doc, component, length and stray of the lists that hold several components;
        a stray is outside the list's largest one."""
        members = self.postings.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        return self._strays(members.select("v", "doc", "component"), "v")

    @staticmethod
    def _strays(members: DataFrame, key: str) -> DataFrame:
        counted = members.groupBy(key, "component").agg(F.count("*").alias("n"))
        groups = counted.groupBy(key).agg(F.sum("n").alias("length"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts"))
        groups = groups.where("parts > 1").select(key, "length", F.col("top.n").alias("inside"), F.col("top.component").alias("main"))
        return members.join(groups, key).withColumn("stray", F.col("component") != F.col("main")).drop("main")

    @staticmethod
    def across(mixed: DataFrame) -> DataFrame:
        """Pairs (a < b) of a stray and a member of another component of a short list."""
        x = mixed.where("stray").select("v", F.col("doc").alias("x"), F.col("component").alias("cx"))
        y = mixed.select("v", F.col("doc").alias("y"), F.col("component").alias("cy"))
        pairs = x.join(y, "v").where("cx <> cy")
        return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def within_families(self, long: DataFrame) -> DataFrame:
        """Exact links of strays in the families that long lists form."""
        hubs = long.groupBy("v").agg(F.min("doc").alias("hub"))
        family = components(long.join(hubs, "v").select(F.col("doc").alias("a"), F.col("hub").alias("b")))
        docs = written(long.select("doc", "component").distinct().join(family.select(F.col("node").alias("doc"), F.col("component").alias("family")), "doc"), "family")
        size, percent = self.size, self.percent
        texts = self.texts(docs.select(F.col("doc").alias("doc_id")), docs.count())
        whole = written(docs.join(texts.mapInArrow(lambda r: _sets(r, size), "doc long, whole array<long>"), "doc").withColumn("n", F.size("whole")), "whole")
        values = whole.select("family", "doc", F.explode("whole").alias("s"))
        twice = values.groupBy("family", "s").agg(F.count("*").alias("times")).where("times > 1").drop("times")
        shared = values.join(twice, ["family", "s"]).groupBy("doc").agg(F.count("*").alias("shared"))
        able = whole.join(shared, "doc").where(100 * F.col("shared") >= percent * F.col("n"))
        rows = written(self._strays(able, "family"), "able")
        n_q, n_m = (F.ceil(x / BLOCK).cast("int") for x in (F.col("length") - F.col("inside"), F.col("length")))
        cell = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)).cast("int")
        cols = ["doc", "component", "n", "shared", "whole"]
        strays = rows.where("stray").select("family", (cell % n_q).alias("i"), F.explode(F.sequence(F.lit(0), n_m - 1)).alias("j"), "stray", *cols)
        every = rows.select("family", F.explode(F.sequence(F.lit(0), n_q - 1)).alias("i"), (cell % n_m).alias("j"), F.lit(False).alias("stray"), *cols)
        return written(strays.unionByName(every).groupBy("family", "i", "j").applyInPandas(lambda g: _blocks(g, percent), "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = 5, k: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id that links
    of at least ``percent`` reach), kept (whether that is its own)."""
    search = _Search(docs, id_col, text_col, size, k, percent)
    tried = written(search.to_centre(), "tried")
    links = search.links(tried)
    found = written(components(links), "components")
    mixed = written(search.mixed(found), "mixed")
    more = search.links(search.across(mixed.where(F.col("length") <= SHORT_LIST)).join(tried, ["a", "b"], "left_anti"))
    long = mixed.where(F.col("length") > SHORT_LIST)
    if long.head(1):
        more = more.unionByName(search.within_families(long))
    # An id of several rows links the sets of all its texts.
    repeated = search.rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1").select("doc_id")
    texts = search.rows.where("n_shingles > 0").join(repeated, "doc_id").join(search.first, "print")
    shared = written(texts.select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct(), "shared")
    if more.head(1) or shared.head(1):
        found = written(components(links.unionByName(more).unionByName(shared)), "components")
    named = search.first.join(found, F.col("doc") == F.col("node"), "left").select("print", F.coalesce("component", "doc").alias("component_id"))
    # Rows of one id share the smallest component that any of its texts reaches.
    rows = search.rows.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id"))
    if shared.head(1):
        by_id = shared.select(F.col("a").alias("node")).distinct().join(found, "node")
        rows = rows.join(by_id, F.col("doc_id") == F.col("node"), "left")
        own = F.coalesce("component", own)
    out = F.when(F.col("doc_id").isNotNull(), F.coalesce(own, "doc_id"))
    return rows.select("doc_id", "n_shingles", out.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
