"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

* Examples: at most ``EXAMPLES`` labelled training rows (crc32(doc_id as text) mod 5 is
  not 0), those with the least hash of their id; the bound is a parameter.
* Terms: every word of the examples.  A term weighs (1 + ln tf) x idf x relevance; document
  frequencies are counted over all documents.  Relevance lies between ``LEAST`` and 1 and
  rises with the term's dependence on the label among the examples (hypergeometric z beyond
  ``Z_FROM``), so no term leaves the vectors, but telling ones outweigh topic words.
  A text's words that no example holds count in its length, at the greatest idf.
* Index: postings by term and block of ``BLOCK_IDS`` examples, with each block's
  greatest weight.  Examples of like words share blocks, so that bounds are tight.  The lists of the
  ``COMMON`` terms that most examples hold are nearly full and kept as rows of a matrix, which many
  queries meet at once.  A query bounds every block by the greatest of its sums over these plus the
  other terms' greatest weights, opens blocks from
  the highest bound on, and stops when the bound falls below its K-th best: the result
  is that of a search over all examples (ties: the smaller doc_id).
* Votes weigh similarity squared, with a prior; leave-one-out votes of the examples
  give an isotonic map to probabilities.  The neighbours and similarities returned are the
  evidence.  A text that shares no word with any example has no neighbour and gets the share
  of toxic ones.

Labels, lang, source and doc_id are never inputs of a score.

Cases: a row without doc_id is no example and not held out; null and empty texts are texts without terms.  Without labels, or with labels of
one kind alone, every score is the prior (0.5 over nothing, else the share with one added
to each kind).  Rows of ``labels`` that repeat a doc_id count once, as toxic if one says so.
Repeated documents are scored alike; of example rows that repeat a doc_id with different texts
the one of fewest words is the example (ties: the least word hashes).  An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import table

EXAMPLES, K, BLOCK_IDS, PRIOR_WEIGHT = 3_000, 10, 512, 0.015
#: Relevance: least, z from which it rises, and z beyond that at which it is half way.
LEAST, Z_FROM, Z_HALF = 0.1, 4.5, 3.0
#: Blocks opened at once while searching; terms with full lists; those of them whose presence orders the examples; queries that meet them at once.
OPENED, COMMON, AXES, QUERIES = 4, 512, 64, 256
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, neighbours array<long>, similarities array<double>"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def hashed(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (ASCII punctuation parts words) and their documents' places."""
    h, n = tb.hash_words([(r or b"").translate(_TABLE).split() for r in raws])
    return h, np.repeat(np.arange(len(n)), n)


def distinct(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, times) of each word of each document."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    at = np.flatnonzero(np.append(np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
    return h[at], doc[at], np.diff(np.append(at, len(h)))


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # idf x relevance of each
    unseen: float  # that of a word that no example holds
    ids: np.ndarray  # doc_ids of examples, in the order of blocks
    labels: np.ndarray
    column: np.ndarray  # of each term, its row of `full`, or -1
    full: np.ndarray  # weights of common terms in every example, by blocks
    first: np.ndarray  # of each term, its first group (common terms have none)
    block: np.ndarray  # of each group (a term's postings in a block)
    most: np.ndarray  # greatest weight of each group
    start: np.ndarray  # first posting of each group
    size: np.ndarray  # postings of each group
    rows: np.ndarray  # postings: place in the block
    weights: np.ndarray
    prior: float
    steps: tuple[np.ndarray, np.ndarray]  # calibration: raw votes, probabilities

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK_IDS)

    def vectors(self, h: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Term numbers and weights of n documents of unit length, and where each document's start."""
        if not len(self.terms) or not len(h):
            return np.empty(0, np.int64), np.empty(0), np.zeros(n + 1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[at] == h
        w = (1 + np.log(tf)) * np.where(hit, self.weight[at], self.unseen)
        w /= np.sqrt(np.bincount(doc, w * w, n))[doc]
        return at[hit], w[hit], np.searchsorted(doc[hit], np.arange(n + 1))

    def searches(self, t: np.ndarray, q: np.ndarray, cuts: np.ndarray, k: int = K, without: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query its k examples of highest positive cosine, exactly; without: an example that each leaves out."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(self.terms):
            yield from [none] * (len(cuts) - 1)
            return
        for at in range(0, len(cuts) - 1, QUERIES):
            some = cuts[at : at + QUERIES + 1]
            lo, n = some[0], len(some) - 1
            terms, weights = t[lo : some[-1]], q[lo : some[-1]]
            who, column = np.repeat(np.arange(n), np.diff(some)), self.column[terms]
            common = np.zeros((n, len(self.full)))
            use = column >= 0
            common[who[use], column[use]] = weights[use]
            sums = (common @ self.full).reshape(n, self.blocks, BLOCK_IDS)
            terms, weights, ends = terms[~use], weights[~use], np.searchsorted(who[~use], np.arange(n + 1))
            most = sums.max(2)
            for i in range(n):
                part = slice(ends[i], ends[i + 1])
                yield self._search(terms[part], weights[part], sums[i], most[i], k, -1 if without is None else without[at + i]) if some[i + 1] > some[i] else none

    def _search(self, t: np.ndarray, q: np.ndarray, common: np.ndarray, bounds: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[t]
        n = self.first[t + 1] - first
        group, weight = tb.spans(first, n), np.repeat(q, n)
        block = self.block[group]
        bounds = bounds + np.bincount(block, weight * self.most[group], self.blocks)
        order = np.argsort(-bounds, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        place = rank[block]
        best_rows, best = np.empty(0, np.int64), np.empty(0)
        for at in range(0, len(order), OPENED):
            least = best[k - 1] - 1e-9 if len(best) >= k else 0.0
            some = order[at : at + OPENED]
            some = some[(bounds[some] > 0) & (bounds[some] >= least)]
            if not len(some):
                break
            here = np.flatnonzero((place >= at) & (place < at + len(some)))
            g = group[here]
            m = self.size[g]
            posting = tb.spans(self.start[g], m)
            slot = np.repeat((place[here] - at) * BLOCK_IDS, m)
            slot += self.rows[posting]
            value = np.repeat(weight[here], m)
            value *= self.weights[posting]
            sums = common[some].ravel() + np.bincount(slot, value, len(some) * BLOCK_IDS)
            found = np.flatnonzero((sums > 0) & (sums >= least))
            rows = some[found // BLOCK_IDS] * BLOCK_IDS + found % BLOCK_IDS
            use = rows != without
            rows, values = np.append(best_rows, rows[use]), np.append(best, sums[found][use])
            if len(values) > 4 * k:
                use = np.flatnonzero(values >= np.partition(values, len(values) - k)[len(values) - k] - 1e-8)
                rows, values = rows[use], values[use]
            top = np.lexsort((self.ids[rows], -np.round(values, 9)))[:k]
            best_rows, best = rows[top], values[top]
        return best_rows, best

    def vote(self, rows: np.ndarray, sims: np.ndarray) -> float:
        w = sims**2
        return float(((w * self.labels[rows]).sum() + PRIOR_WEIGHT * self.prior) / (w.sum() + PRIOR_WEIGHT))

    def score(self, rows: np.ndarray, sims: np.ndarray) -> float:
        return float(np.interp(self.vote(rows, sims), *self.steps)) if len(rows) else self.prior


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: mean x and mean y (one prior count of each kind) of each pool, both ascending."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]):
            a2, b2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2] + n2]
    return np.array([p[0] / p[2] for p in pools]), np.maximum.accumulate(np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools]))


def relevance(df: np.ndarray, toxic_df: np.ndarray, n: int, toxic: int) -> np.ndarray:
    """Between LEAST and 1, by the z of toxic_df among df draws from n examples of which `toxic` are toxic."""
    p = toxic / n
    spread = np.sqrt(np.maximum(df * p * (1 - p) * (n - df) / max(n - 1, 1), 1e-12))
    beyond = np.maximum(0.0, np.where(df < n, np.abs(toxic_df - df * p) / spread, 0.0) - Z_FROM)
    return LEAST + (1 - LEAST) * beyond / (beyond + Z_HALF)


def alike(row: np.ndarray, term: np.ndarray, weight: np.ndarray, informative: np.ndarray, n: int, terms: int) -> np.ndarray:
    """An order of n examples in which neighbours have like words: by the signs of two principal axes over
    the most common terms (languages part there), then by the weight of informative terms."""
    common = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:AXES]
    column = np.full(terms, -1)
    column[common] = np.arange(len(common))
    use = column[term] >= 0
    dense = np.zeros((n, len(common)))
    dense[row[use], column[term[use]]] = 1.0
    dense -= dense.mean(0)
    axes = np.linalg.eigh(dense.T @ dense)[1][:, -2:]
    sides = ((dense @ axes) > 0) @ (1 << np.arange(axes.shape[1]))
    told = np.bincount(row, weight * informative[term], n)
    return np.lexsort((np.arange(n), told, sides))


def build(terms: np.ndarray, df: np.ndarray, documents: int, ids: np.ndarray, labels: np.ndarray, postings: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Index:
    """postings: example (place in ids, ascending), term number, times."""
    n, toxic = len(ids), int(labels.sum())
    prior, none = (toxic + 1) / (n + 2), np.empty(0, np.int64)
    if not n or toxic in (0, n) or not len(terms):
        return Index(terms[:0], np.empty(0), 0.0, ids, labels, none, np.empty((0, 0)), np.zeros(1, np.int64), none, np.empty(0), none, none, none, np.empty(0), prior, (np.array([0.0, 1.0]), np.array([prior, prior])))
    row, term, tf = postings
    tells = relevance(np.bincount(term, minlength=len(terms)), np.bincount(term, labels[row], len(terms)), n, toxic)
    weight = np.log((2.0 + documents) / (1.0 + df)) * tells
    value = (1 + np.log(tf)) * weight[term]
    value /= np.sqrt(np.bincount(row, value**2, n))[row]
    order = alike(row, term, value, tells > LEAST, n, len(terms))
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    row, ids, labels = back[row], ids[order], labels[order]
    value = value.astype(np.float32).astype(float)
    by = np.lexsort((term, row))
    cuts, own, weights = np.searchsorted(row[by], np.arange(n + 1)), term[by], value[by]
    often = np.bincount(term, minlength=len(terms))
    column, common = np.full(len(terms), -1), np.argsort(-often, kind="stable")[:COMMON]
    column[common] = np.arange(len(common))
    full = np.zeros((len(common), -(-n // BLOCK_IDS) * BLOCK_IDS))
    use = column[term] >= 0
    full[column[term[use]], row[use]] = value[use]
    row, term, value = row[~use], term[~use], value[~use]
    by = np.lexsort((row, term))
    row, term, value = row[by], term[by], value[by]
    new = np.flatnonzero(np.append(np.ones(min(1, len(term)), bool), (term[1:] != term[:-1]) | (row[1:] // BLOCK_IDS != row[:-1] // BLOCK_IDS)))
    index = Index(
        terms, weight, float(np.log(2.0 + documents) * LEAST), ids, labels, column, full, np.searchsorted(term[new], np.arange(len(terms) + 1)).astype(np.int32), (row[new] // BLOCK_IDS).astype(np.int32),
        np.maximum.reduceat(value, new) if len(new) else value, new.astype(np.int32), np.diff(np.append(new, len(row))).astype(np.int32), (row % BLOCK_IDS).astype(np.int32), value, prior, (np.array([0.0, 1.0]), np.array([0.0, 1.0])),
    )
    raw, truth = [], []
    for r, (rows, sims) in enumerate(index.searches(own, weights, cuts, without=np.arange(n))):
        if len(rows):
            raw.append(index.vote(rows, sims))
            truth.append(float(labels[r]))
    if len(set(truth)) == 2:
        index.steps = isotonic(np.array(raw), np.array(truth))
    return index


def examples(docs: DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in ids, word hash and times of the examples' words; at most EXAMPLES rows reach the driver."""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids.tolist()], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, raws in tb.blocks(batches, "doc_id", "text"):
            h, doc, tf = distinct(*hashed(raws))
            cuts = pa.array(np.searchsorted(doc, np.arange(len(keys) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h.view(np.int64), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *lists], names=["doc_id", "words", "times"])

    some = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id", "left_semi").distinct()
    got: dict[int, tuple[int, bytes, np.ndarray, np.ndarray]] = {}
    for r in some.mapInArrow(run, "doc_id long, words array<long>, times array<long>").toLocalIterator():
        w, n = np.array(r.words, np.int64).view(np.uint64), np.array(r.times, np.int64)
        one = (int(n.sum()), w.tobytes(), w, n)
        if r.doc_id not in got or one[:2] < got[r.doc_id][:2]:
            got[r.doc_id] = one
    held = [(i, got[d]) for i, d in enumerate(ids.tolist()) if d in got]
    none = np.empty(0, np.int64)
    return np.repeat(np.array([i for i, _ in held], np.int64), [len(x[2]) for _, x in held]), np.concatenate([none.view(np.uint64), *(x[2] for _, x in held)]), np.concatenate([none, *(x[3] for _, x in held)])


def frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """Over all documents: how many hold each term, and how many there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        df, seen = np.zeros(len(terms) + 1, np.int64), 0
        for keys, raws in tb.blocks(batches, "doc_id", "text"):
            seen += len(keys)
            h, _, _ = distinct(*hashed(raws))
            at = np.searchsorted(terms, h)
            at = at[np.append(terms, 0)[at] == h] if len(terms) else at[:0]
            df += np.bincount(at, minlength=len(df))
        t = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(t, -1)), pa.array(np.append(df[t], seen))], names=["term", "n"])

    got = docs.select("doc_id", "text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    term, n = got["term"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    df = np.zeros(len(terms))
    df[term[term >= 0]] = n[term >= 0]
    return df, int(n[term < 0].sum())


def fitted(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Index:
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = usable.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    some = training.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toPandas().sort_values("doc_id")
    ids, truth = some["doc_id"].to_numpy(np.int64), (some["toxic"].to_numpy(np.int64) > 0).astype(np.int64)
    none = np.empty(0, np.int64)
    if len(set(truth.tolist())) < 2:
        return build(none.view(np.uint64), np.empty(0), 0, ids, truth, (none, none, none))
    place, words, times = examples(docs, ids)
    terms, term = np.unique(words, return_inverse=True)
    df, documents = frequencies(docs, terms)
    return build(terms, df, documents, ids, truth, (place, term, times))


def scored(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """One row for each row of docs, with the neighbours that gave the score."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for ids, raws in tb.blocks(batches, "doc_id", "text"):
            t, q, cuts = index.vectors(*distinct(*hashed(raws)), len(ids))
            scores, near, sims = [], [], []
            for rows, s in index.searches(t, q, cuts):
                scores.append(min(1.0, max(0.0, index.score(rows, s))))
                near.append(index.ids[rows].tolist())
                sims.append(s.tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(near, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))],
                names=[x.split()[0] for x in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op8_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
