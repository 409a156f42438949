"""MinHash near-dedup by DartMinHash.

A document is the weighted set of its five-word shingles (lower-cased A-Z),
each weighing as often as it occurs; similarity is weighted Jaccard.  For each
element, hashed darts fall on the plane (weight, rank) as a Poisson process;
those below the element's weight count, each belongs to one of K coordinates,
and the earliest (least rank) of each coordinate is the signature.  Darts
depend on the element and its region alone, so equal regions get equal darts
whatever set they are in, and P[coordinate equal] is the weighted Jaccard
similarity.  Regions are dyadic cells, and only ranks below a bound of about
K (ln K + 2) / weight are looked at, so a document costs time in its elements plus
K log K darts.  A document in which a coordinate stays empty is done again
with twice the bound.

Signatures are joined by BANDS bands of ROWS coordinates: a pair at 0.8 is missed
with probability (1 - 0.8**5)**32 < 4e-6.  Four bits of each coordinate form a
document's sketch; a pair whose sketches differ in more than MOST_UNLIKE places is no
candidate (a pair at 0.8 differs in 30 places with a deviation of 4.9, so more than 54 have a
probability below 3e-6).  Then:

1. Documents of equal words are one text (a map-side combined minimum).
2. A bucket of up to SMALL texts gives all its pairs (a bounded number a text); in a larger one
   each text is paired with the smallest id there, never with all others.  Of each text's candidates
   the smallest is checked first, exactly and on whole texts; these links make classes
   (large-star, small-star rounds over written tables).
3. What small buckets paired is then checked where the two are in different classes.
4. A large bucket that holds several classes is cut by hash into bins of about BIN texts or WORDS words, and any two bins
   meet in one task, whose memory they bound.  There pairs of different classes are taken text by
   text, checked exactly on whole texts (a text meets all others through an inverted index of the task's
   shingles), and joined at once, so a task gives links (fewer than it has texts), not pairs.
   A pair is looked at only in the first band that it shares.  So any two texts that share a bucket are in one class
   or were compared; no bucket is cut short.

Links go through joins that AQE splits, so a class may hold a third of all
rows; nothing but counts reaches the driver.

Cases: a document of one to four words is one shingle; a document without words (null,
empty) is in a class of its own.  doc_id is a key; a row without one has no class (null) and stays.  An empty table gives an empty
result; other columns are carried by ``deduped`` and not read by ``classes``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import table, unused, written

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 5, 32
K = ROWS * BANDS
#: Places of the sketches (one a coordinate) in which a candidate pair may differ; places of one 64-bit word.
MOST_UNLIKE, PLACES = 54, 16
#: Documents of a block of signatures (darts go with documents, so this bounds a worker's memory).
DOCUMENTS = 256
#: Texts of a bucket that gives all its pairs.
SMALL = 8
#: The least rank interval is [0, 2**-FINE); the others double from there.
FINE = 8
#: Texts and words of a bin of a large bucket; texts and bytes whose shingles a task keeps.
BIN, WORDS, KEPT, KEPT_BYTES = 512, 1 << 18, 2048, 16 << 20
#: Texts of a bin that meet all others there at once.
STRIP = 32


def shingles(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document (place), shingle hash and count, of each distinct shingle."""
    words = [tb.split(r, True) for r in raws]
    h, counts = tb.hash_words(words)
    at = tb.inside(counts, SHINGLE)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams, owner = (tb.ngrams(h, SHINGLE)[at], doc[at]) if len(at) else (np.empty(0, np.uint64), np.empty(0, np.int64))
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        whole = [int.from_bytes(hashlib.blake2b(b" ".join(words[i]), digest_size=8).digest(), "little") for i in short]
        grams, owner = np.append(grams, np.array(whole, np.uint64)), np.append(owner, short)
    if not len(grams):
        return owner, grams, np.empty(0, np.int64)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    first = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(first)
    return owner[at], grams[at], np.diff(np.append(at, len(grams)))


_cdf: dict[float, np.ndarray] = {}


def poisson(uniform: np.ndarray, mean: float) -> np.ndarray:
    """Counts of a Poisson law by inversion."""
    if mean not in _cdf:
        k = np.arange(int(mean + 12 * math.sqrt(mean) + 24))
        logs = k * math.log(mean) - mean - np.array([math.lgamma(x + 1) for x in k])
        _cdf[mean] = np.cumsum(np.exp(logs))
    return np.searchsorted(_cdf[mean], uniform, side="right")


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seed_of(*parts: int) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "<u8")[0]


def darts(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, coordinate, rank, dart) of the darts below each element's weight and its owner's bound."""
    most_weight, most_rank = float(weight.max()), float(bound.max())
    v, w_lo, w_hi = 0, 0.0, 1.0
    while w_lo < most_weight:
        tall = np.flatnonzero(weight > w_lo)
        o, e, w = owner[tall], element[tall], weight[tall]
        p, r_lo, r_hi = 0, 0.0, 2.0**-FINE
        while r_lo < most_rank:
            use = np.flatnonzero(bound[o] > r_lo)
            cell = tb.mix(e[use] ^ seed_of(v, p))
            n = poisson(unit(cell), (w_hi - w_lo) * (r_hi - r_lo))
            if (total := int(n.sum())):
                which = np.repeat(np.arange(len(use)), n)
                nth = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                dart = tb.mix(cell[which] + tb.mix(nth.astype(np.uint64) + np.uint64(1)))
                rank = r_lo + (r_hi - r_lo) * unit(tb.mix(dart ^ seed_of(-1)))
                height = w_lo + (w_hi - w_lo) * unit(tb.mix(dart ^ seed_of(-2)))
                mine = use[which]
                ok = np.flatnonzero((height < w[mine]) & (rank < bound[o[mine]]))
                yield o[mine[ok]], (dart[ok] >> np.uint64(20)).astype(np.int64) % K, rank[ok], dart[ok]
            p, r_lo, r_hi = p + 1, r_hi, 2 * r_hi
        v, w_lo, w_hi = v + 1, w_hi, 2 * w_hi


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n x K darts; rows of owners without elements are zero."""
    out = np.zeros(n * K, np.uint64)
    if not len(owner):
        return out.reshape(n, K)
    totals = np.bincount(owner, weight, n)
    bound = K * (math.log(K) + 2) / np.maximum(totals, 1)
    todo = totals > 0
    while len(owner):
        best, dart = np.full(n * K, np.inf), np.zeros(n * K, np.uint64)
        for own, coordinate, rank, which in darts(owner, element, weight, bound):
            slot = own * K + coordinate
            order = np.argsort(-rank)  # the earliest is written last
            slot, rank, which = slot[order], rank[order], which[order]
            early = np.flatnonzero(rank < best[slot])
            best[slot[early]] = rank[early]
            dart[slot[early]] = which[early]
        fresh = dart.reshape(n, K)
        full = todo & np.isfinite(best).reshape(n, K).all(1)
        out.reshape(n, K)[full] = fresh[full]
        todo &= ~full
        stay = todo[owner]
        owner, element, weight, bound = owner[stay], element[stay], weight[stay], bound * 2
    return out.reshape(n, K)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """n x BANDS bucket keys."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(ROWS):
        key = tb.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return tb.mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """n x (K / PLACES) words: the upper four bits of each coordinate's dart."""
    bits = (signature >> np.uint64(60)).reshape(len(signature), K // PLACES, PLACES) << (4 * np.arange(PLACES, dtype=np.uint64))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, words_key (null without words), total (shingles with repeats), bands, sketch."""

    def lists(values: np.ndarray) -> pa.ListArray:
        n, width = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width), pa.int32()), pa.array(values.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in tb.blocks(batches, "doc_id", "text", rows=DOCUMENTS):
            keys = []
            for raw in raws:
                w = b" ".join(tb.split(raw, True))
                keys.append(hashlib.blake2b(w, digest_size=16).digest() if w else None)
            owner, element, count = shingles(raws)
            signature = signatures(owner, element, count.astype(np.float64), len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(np.bincount(owner, count, len(ids)).astype(np.int64)), lists(band_keys(signature)), lists(sketches(signature))],
                names=["doc_id", "words_key", "total", "bands", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, words_key binary, total long, bands array<long>, sketch array<long>")


def packed(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for ids, raws in tb.blocks(batches, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([packer.compress(r or b"") for r in raws], pa.binary())], names=["doc_id", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, packed binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (sorted shingles, counts)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    least = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return least / max(1, int(a[1].sum()) + int(b[1].sum()) - least)


class Shingles(dict):
    """Shingles of packed texts by a key; those used last are kept, up to KEPT of them and KEPT_BYTES."""

    def __init__(self) -> None:
        self.unpacker, self.size = zstandard.ZstdDecompressor(), 0

    def of(self, key: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
        got = self.pop(key, None)
        if got is None:
            got = shingles([self.unpacker.decompress(packed)])[1:]
            self.size += 2 * got[0].nbytes
        self[key] = got
        while len(self) > KEPT or self.size > KEPT_BYTES and len(self) > 2:
            self.size -= 2 * self.pop(next(iter(self)))[0].nbytes
        return got


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = Shingles()
        for batch in batches:
            good = [similarity(kept.of(a, x), kept.of(b, y)) >= threshold for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def elements(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and element of texts as sets: the k-th occurrence of a shingle in a text is an element of its own."""
    owner, shingle, count = shingles(raws)
    at = np.repeat(np.arange(len(owner)), count)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return owner[at], tb.mix(shingle[at] + tb.mix(nth.astype(np.uint64)))


def forest(group: dict[str, list], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of one task's bins wherever a pair reaches the threshold."""
    ids, side = np.array(group["a"], np.int64), np.array(group["bin"])
    total, sketch = np.array(group["total"], float), np.array(group["sketch"], np.int64).view(np.uint64)
    bands = np.array(group["bands"], np.int64)
    _, label = np.unique(np.array(group["class"], np.int64), return_inverse=True)
    if label.max() == 0:
        return []
    found: list[tuple[np.ndarray, ...]] = []
    places = np.arange(len(ids))
    for at in range(0, len(ids), STRIP):
        some = places[at : at + STRIP, None]
        ok = (places > some) & (label != label[some]) & (np.minimum(total, total[some]) >= threshold * np.maximum(total, total[some]))
        if group["i"][0] != group["j"][0]:
            ok &= side != side[some]  # pairs within a bin are another task's
        left, right = np.nonzero(ok)
        left += at
        x = sketch[left] ^ sketch[right]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        near = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64) <= MOST_UNLIKE
        left, right = left[near], right[near]
        first = (bands[left] == bands[right]).argmax(1) == group["band"][0]
        found.append((left[first], right[first]))
    one, other = map(np.concatenate, zip(*found, strict=True))
    if not len(one):
        return []
    unpacker, use = zstandard.ZstdDecompressor(), np.unique(np.append(one, other))
    owner, element = elements([unpacker.decompress(group["packed"][k]) for k in use.tolist()])
    sizes = np.bincount(owner, minlength=len(use))
    own = np.searchsorted(owner, np.arange(len(use) + 1))
    _, element = np.unique(element, return_inverse=True)
    holder = owner[np.argsort(element, kind="stable")].astype(np.int32)
    many = np.bincount(element).astype(np.int32)
    start = (np.cumsum(many) - many).astype(np.int32)
    parent = list(range(int(label.max()) + 1))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    links = []
    order = np.argsort(one, kind="stable")
    one, other = one[order], other[order]
    cuts = np.append(np.flatnonzero(np.append(True, one[1:] != one[:-1])), len(one))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, mine = int(one[lo]), np.searchsorted(use, one[lo])
        u = root(int(label[i]))
        partners = np.array([j for j in other[lo:hi].tolist() if root(int(label[j])) != u], np.int64)
        if not len(partners):
            continue
        mine_elements = element[own[mine] : own[mine + 1]]
        both = np.bincount(holder[tb.spans(start[mine_elements], many[mine_elements])], minlength=len(use))
        place = np.searchsorted(use, partners)
        alike = both[place] / (sizes[mine] + sizes[place] - both[place]) >= threshold
        for j in partners[alike].tolist():
            u, v = root(u), root(int(label[j]))
            if u != v:
                parent[u] = v
                links.append((int(ids[i]), int(ids[j])))
    return links


def binned(large: DataFrame, found: DataFrame, facts: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket of large (key, band, a, n, words)."""
    now = large.join(found, F.col("a") == F.col("v"), "left").select("key", "band", "a", "n", "words", F.coalesce("class", "a").alias("class"))
    mixed = now.groupBy("key").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least <> most").select("key")
    bins = F.ceil(F.greatest(F.col("n") / BIN, F.col("words") / WORDS))
    rows = now.join(mixed, "key").withColumn("bins", bins).withColumn("bin", F.pmod(F.xxhash64("a"), F.col("bins")))
    rows = written(rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).select("key", "band", "a", "class", "bin", F.least("bin", "other").alias("i"), F.greatest("bin", "other").alias("j")), "open")
    known = packed(docs.join(rows.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi")).join(facts, "doc_id").withColumnRenamed("doc_id", "a")
    names = ["key", "band", "a", "class", "bin", "i", "j", "total", "sketch", "bands", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = {c: [] for c in names}, None

        def links() -> pa.RecordBatch:
            some = forest(group, threshold)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in some], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (which := (row[0], row[5], row[6])) != last and last is not None:
                    yield links()
                    group = {c: [] for c in names}
                last = which
                for c, x in zip(names, row, strict=True):
                    group[c].append(x)
        if last is not None:
            yield links()

    return rows.join(known, "a").select(names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "a").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v, class: the smallest vertex connected with each vertex of links (a, b); large-star and small-star rounds until all are stars."""
    now = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while not now.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty() or not now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
    return now.select(F.col("u").alias("v"), F.col("v").alias("class")).union(now.select("v", F.col("v").alias("class")).distinct())


def unlike(one: str, other: str) -> Column:
    """The number of places in which two sketches differ."""
    total = F.lit(0)
    for i in range(K // PLACES):
        x = F.get(one, F.lit(i)).bitwiseXOR(F.get(other, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def candidates(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b and others) whose shingle counts and sketches allow the threshold."""
    sides = [facts.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("total", "sketch"))) for x in ("a", "b")]
    enough = F.least("total_a", "total_b") >= threshold * F.greatest("total_a", "total_b")
    return pairs.join(sides[0], "a").join(sides[1], "b").where(enough).where(unlike("sketch_a", "sketch_b") <= MOST_UNLIKE).select(*pairs.columns)


def parted(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose texts are in different classes."""
    a, b = found.toDF("a", "class_a"), found.toDF("b", "class_b")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), same_words_id (smallest doc_id with the same words)."""
    sig = written(signed(docs), "signatures")
    first = written(sig.where("words_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("words_key").agg(F.min("doc_id").alias("same")), "texts")
    facts = written(sig.join(first.select(F.col("same").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "total", "sketch", "bands"), "facts")
    rows = facts.select(F.col("doc_id").alias("a"), "total", F.posexplode("bands").alias("band", "key"))
    heads = rows.groupBy("key").agg(F.min("a").alias("b"), F.count("*").alias("n"), F.sum("total").alias("words")).where("n > 1")
    members = written(rows.drop("total").join(heads, "key"), "buckets")
    few = members.where(F.col("n") <= SMALL).select("key", "a")
    small = few.join(few.withColumnRenamed("a", "b"), "key").where("a > b").select("a", "b", F.lit(True).alias("small"))
    headed = members.where(F.col("n") > SMALL).where("a <> b").select("a", "b", F.lit(False).alias("small"))
    pairs = small.union(headed).groupBy("a", "b").agg(F.max("small").alias("small"))
    pairs = written(candidates(pairs, facts, threshold), "pairs")

    def checked(some: DataFrame) -> DataFrame:
        texts = packed(docs.join(some.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi"))
        return written(verified(some, written(texts, "candidates"), threshold), "verified")

    links = checked(pairs.groupBy("a").agg(F.min("b").alias("b")))
    found = components(links)
    links = found.toDF("a", "b").union(checked(written(parted(pairs.where("small").select("a", "b"), found), "pairs")))
    found = components(links)
    found = components(links.union(written(binned(members.where(F.col("n") > SMALL), found, facts, docs, threshold), "verified")))
    same = sig.select("doc_id", "words_key").join(first, "words_key", "left")
    same = same.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("same", "doc_id")).alias("same_words_id"))
    return same.join(found, F.col("same_words_id") == F.col("v"), "left").select("doc_id", F.coalesce("class", "same_words_id").alias("class_id"), "same_words_id")


def deduped(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the smallest doc_id of each class; all columns stay as they are."""
    gone_id = unused(docs, "gone_id")
    gone = classes(docs, threshold).where("doc_id <> class_id").select(F.col("doc_id").alias(gone_id))
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
