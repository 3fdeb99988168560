"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (lower-cased, punctuation cut) and their first four and five
letters. Terms whose presence depends on the label (chi-squared over the sampled
examples) make the vectors. The index is inverted, in blocks of examples with the
largest weight of each term in each block: a query adds up its block bounds and
reads blocks from the highest bound down, until no bound reaches its k-th
similarity, so the k nearest are exact. Similarities weigh the neighbours' labels;
isotonic regression on examples kept out of the index turns votes into
probabilities. Neighbours are returned as evidence.

The classifier is fitted on a bounded sample: at most ``sample_rows`` labelled
documents, drawn by a hash of their id (a documented parameter, so that the index
fits every worker). All documents are scored over their whole texts.

Null and empty texts, and texts without such a term, have no neighbour; they get
the rate of such examples. Without labelled rows all get 0. Labels that are null
are not used; an id labelled twice counts as toxic if one label says so. Documents
keep all their columns; ``score`` and ``evidence`` must not be among them.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm import words as w

BLOCK = 64
_CUT = bytes(c if c >= 128 or chr(c) not in string.punctuation else 32 for c in range(256))
EVIDENCE = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def terms(text: str | None) -> Counter:
    """How often each word and each beginning of words stands in a whole text."""
    counts = Counter((text or "").lower().encode().translate(_CUT).split())
    out: Counter = Counter()
    for word, n in counts.items():
        word = word.decode()
        out[word] += n
        if len(word) > 4:
            out[word[:4] + "*"] += n
            if len(word) > 5:
                out[word[:5] + "*"] += n
    return out


def _term_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, list[int]] = {}
    for frame in frames:
        for text, toxic in zip(frame["text"], frame["toxic"]):
            for term in terms(text):
                sums.setdefault(term, [0, 0])[int(toxic)] += 1
    if sums:
        yield pd.DataFrame({"term": list(sums), "others": [x[0] for x in sums.values()], "toxic": [x[1] for x in sums.values()]})


def _vectors(frames: Iterator[pd.DataFrame], place: dict[str, int]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc, text, toxic in zip(frame["doc_id"], frame["text"], frame["toxic"]):
            own = sorted((place[t], n) for t, n in terms(text).items() if t in place)
            rows.append((doc, toxic, [p for p, _ in own], [n for _, n in own]))
        yield pd.DataFrame(rows, columns=["doc_id", "toxic", "terms", "counts"])


@dataclass
class Index:
    """Unit vectors of examples as posting lists in blocks, and what calibrates votes."""

    place: dict[str, int]
    idf: np.ndarray
    docs: np.ndarray
    labels: np.ndarray
    cells: np.ndarray  # (term, block): where its postings start; one more at the end
    n_blocks: int
    bounds: np.ndarray  # (term, block): largest weight
    posting_doc: np.ndarray
    posting_weight: np.ndarray
    k: int
    prior: float = 0.0
    rate_without: float = 0.0
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))

    def weights(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / np.sqrt((x * x).sum())

    def nearest(self, at: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine (ties: the first in the index), if above 0."""
        bounds = weight @ self.bounds[at]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        docs, sims, i, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while i < len(order):
            if len(sims) >= self.k and bounds[order[i]] < sims[self.k - 1] * (1 - 1e-9):
                break
            cell = (at[:, None] * self.n_blocks + order[None, i : i + step]).ravel()
            n = self.cells[cell + 1] - self.cells[cell]
            rows = w.runs(self.cells[cell], n)
            scaled = self.posting_weight[rows] * np.repeat(np.repeat(weight, min(step, len(order) - i)), n)
            found, spot = np.unique(self.posting_doc[rows], return_inverse=True)
            docs = np.concatenate((docs, found))
            sims = np.concatenate((sims, np.bincount(spot, scaled, len(found))))
            best = np.lexsort((docs, -np.round(sims, 12)))[: self.k]
            docs, sims = docs[best], sims[best]
            i, step = i + step, step * 2
        return docs, sims

    def vote(self, docs: np.ndarray, sims: np.ndarray) -> float:
        """Labels weighted by similarity, with a little of the prior."""
        return float((sims @ self.labels[docs] + 0.1 * self.prior) / (sims.sum() + 0.1))

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        own = sorted((self.place[t], n) for t, n in terms(text).items() if t in self.place)
        if own and len(self.docs):
            at, counts = np.array([p for p, _ in own]), np.array([n for _, n in own])
            docs, sims = self.nearest(at, self.weights(at, counts))
            if len(docs):
                return float(np.interp(self.vote(docs, sims), *self.knots)), docs, sims
        return self.rate_without, np.zeros(0, np.int64), np.zeros(0)


def build(rows: pd.DataFrame, place: dict[str, int], idf: np.ndarray, k: int, prior: float) -> Index:
    """``rows``: doc_id, toxic, terms, counts; rows without terms aren't indexed."""
    rows = rows[rows["terms"].map(len) > 0]
    # Like examples side by side keep the blocks' bounds tight.
    key = rows.assign(head=[int(t[0]) for t in rows["terms"]], width=rows["terms"].map(len))
    rows = key.sort_values(["toxic", "head", "width", "doc_id"]).reset_index(drop=True)
    sizes = rows["terms"].map(len).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
    n_blocks = max(1, -(-len(rows) // BLOCK))
    term = np.concatenate([np.asarray(x, np.int64) for x in rows["terms"]]) if len(rows) else np.zeros(0, np.int64)
    count = np.concatenate([np.asarray(x, np.float64) for x in rows["counts"]]) if len(rows) else np.zeros(0)
    doc = np.repeat(np.arange(len(rows)), sizes)
    weight = (1 + np.log(count)) * idf[term]
    weight /= np.sqrt(np.bincount(doc, weight * weight, len(rows)))[doc] if len(rows) else 1
    order = np.lexsort((doc, term))
    term, doc, weight = term[order], doc[order], weight[order]
    cell = term * n_blocks + doc // BLOCK
    cells = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=len(idf) * n_blocks)))).astype(np.int64)
    bounds = np.zeros(len(idf) * n_blocks)
    np.maximum.at(bounds, cell, weight)
    return Index(
        place, idf, rows["doc_id"].to_numpy(np.int64), rows["toxic"].to_numpy(np.float64), cells, n_blocks,
        bounds.reshape(len(idf), n_blocks), doc, weight, k, prior,
    )


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit of ``y`` on ``x`` (pool adjacent violators, smoothed by
    half an example of each label in a pool)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weighted sum, weight, first x, last x
    for v, t in zip(x[order], y[order]):
        pools.append([t, 1.0, v, v])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, last = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = last
    xs = np.array([v for p in pools for v in (p[2], p[3])])
    ys = np.maximum.accumulate(np.repeat([(p[0] + 0.5) / (p[1] + 1) for p in pools], 2))
    return xs, ys


def fit(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, most_terms: int = 4096, least_chi: float = 30.0, k: int = 15, hold_out: int = 5
) -> Index:
    """Fit on at most ``sample_rows`` rows of ``labels`` (doc_id, toxic); one in
    ``hold_out`` calibrates instead of entering the index."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    drawn = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(hold_out)) == 0
    shown = rows.where(~calibrates)
    totals = {r.toxic: r["count"] for r in shown.groupBy("toxic").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return build(pd.DataFrame({"doc_id": [], "toxic": [], "terms": [], "counts": []}), {}, np.zeros(0), k, 0.0)
    sums = shown.select("text", "toxic").mapInPandas(_term_counts, "term string, others long, toxic long")
    sums = sums.groupBy("term").agg(F.sum("others").alias("others"), F.sum("toxic").alias("toxic"))
    a, b = F.col("toxic"), F.col("others")
    n = float(pos + neg)
    chi = n * F.pow(a * (neg - b) - b * (pos - a), F.lit(2)) / (pos * float(neg) * (a + b) * F.greatest(n - a - b, F.lit(1.0)))
    best = sums.withColumn("chi", chi).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "term").limit(most_terms).collect()
    place = {r.term: i for i, r in enumerate(best)}
    idf = np.array([np.log((n + 1) / (r.toxic + r.others + 1)) + 1 for r in best])
    shape = "doc_id long, toxic int, terms array<int>, counts array<int>"
    vectors = rows.withColumn("held", calibrates).select("doc_id", "text", "toxic").mapInPandas(lambda f: _vectors(f, place), shape)
    table = vectors.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(hold_out)) == 0).toPandas()
    table = table.sort_values("doc_id").reset_index(drop=True)
    index = build(table[~table["held"]], place, idf, k, pos / n)
    votes, truth, without = [], [], []
    for r in table[table["held"]].itertuples():
        found = ()
        if len(r.terms) and len(index.docs):
            at = np.asarray(r.terms, np.int64)
            found = index.nearest(at, index.weights(at, np.asarray(r.counts, np.float64)))
        if len(found) and len(found[0]):
            votes.append(index.vote(*found))
            truth.append(float(r.toxic))
        else:
            without.append(float(r.toxic))
    index.rate_without = (sum(without) + 0.5 * index.prior) / (len(without) + 0.5) if without else index.prior
    if votes:
        index.knots = isotonic(np.array(votes), np.array(truth))
    return index


def _scored(batches: Iterator[pa.RecordBatch], index, column: int):
    own = index.value
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
    for batch in batches:
        scores, evidence = [], []
        for i in range(len(batch)):
            score, docs, sims = own.score(batch.column(column)[i].as_py())
            scores.append(score)
            evidence.append([{"doc_id": int(own.docs[d]), "similarity": float(s), "toxic": int(own.labels[d])} for d, s in zip(docs, sims)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(evidence, kind)], [*batch.schema.names, "score", "evidence"])


def score(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (probability of label 1) and ``evidence``."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    column = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("evidence", T._parse_datatype_string(EVIDENCE))])
    return docs.mapInArrow(lambda b: _scored(b, shared, column), schema)
