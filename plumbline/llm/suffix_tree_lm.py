"""LM scoring by a probabilistic suffix tree.

Symbols are a text's lower-cased (A-Z) words and one end.  The model is learned
from the whole training part: every word, pair and triple counts, however rare
it is and however large the corpus.

* The root's distribution is add-one smoothed, one share standing for all unseen words.
* A context (one or two words, or a text's start) is retained if its next-symbol
  distribution diverges from its suffix's by ``DIVERGENCE`` nats or more.  Counts
  are discounted by ``DISCOUNT``; the mass left over goes to the suffix's
  distribution, so every state has a whole distribution over all words.

A token is scored at its longest retained suffix.  Where a state has no entry
for the word its left-over share multiplies the suffix's probability.

The tree is never in one place.  Texts are kept as pieces (``pieces``): a list of word
hashes and the symbols' places in it.  In each of four rounds every piece sends the
keys it holds, each once and with its own part of a sum, to the buckets of the keys'
ranges; a bucket adds the parts up and answers each piece.  So no key, however common,
has more rows than there are pieces, and nothing is broadcast.

1. Words and pairs: occurrences in training, and whether held-out texts have them.
2. Triples: the same.  Words: next symbols, as the sum of 1 / count over occurrences.
3. Words: divergence, a sum over occurrences.  Pairs: next symbols.
4. Pairs: divergence.

Then every piece scores its own texts.  A context that no held-out text has and that one
symbol alone follows is settled by its piece without asking: its count says all of it.
64-bit hashes identify words, pairs and triples.

Cases: null counts as the empty text (one end token); a row without doc_id is not held out.  Repeated rows are
scored row by row.  Without training rows c = N = V = 0 and scores are 0.  An
empty table gives an empty result.  Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import new_dir, shuffle_partitions, table, written

DIVERGENCE, DISCOUNT = 0.01, 0.75
#: Symbols of a piece, at least, if its task has as many; a piece has a block of texts more at most.
SYMBOLS = 1 << 19
WORDS, PAIRS, TRIPLES, WORD_TYPES, WORD_GAINS, PAIR_TYPES, PAIR_GAINS = range(7)
#: What one next symbol and one nat are in sums: rounding is below half a symbol and 2**-14 of DIVERGENCE for 2**16 pieces, and whole numbers add up alike in any order.
TYPE, NAT = 1 << 24, 1 << 36
#: The end's hash, and the key of the context before a text's first word.
END, START = np.uint64(0x5EED0F7E47E2D000), np.uint64(0x57A27)
STEP = np.uint64(0xD1342543DE82EF95)
PIECE = "piece long, train long, texts long, ids array<long>, sizes binary, words binary, places binary"
REQUEST = "bucket int, piece long, tag int, keys binary, parts binary"
ANSWER = "piece long, bucket int, tag int, sums binary"
SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def packed(x: np.ndarray) -> bytes:
    """64-bit values as planes of bytes, without the highest ones where they are all zero; the first byte is the number of planes."""
    width = (int(x.view(np.uint64).max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(b: bytes, kind: type, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if b[0]:
        out[:, : b[0]] = np.frombuffer(b, np.uint8, offset=1).reshape(b[0], n).T
    return out.view(kind)[:, 0]


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys as their differences, with their number."""
    return len(x).to_bytes(8, "little") + packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b[8:], np.uint64, int.from_bytes(b[:8], "little")), dtype=np.uint64)


def pieces(docs: DataFrame) -> DataFrame:
    """The texts of docs as pieces: hashes in ascending order and, for all symbols, the hash's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, hashes, sizes, held = [], [], [], 0

        def piece() -> pa.RecordBatch:
            n = np.concatenate(sizes)
            words, places = np.unique(np.concatenate(hashes), return_inverse=True)
            train = ~np.array([held_out(i) for i in ids], bool)
            row = {"piece": number, "train": int(n[train].sum()), "texts": int(train.sum()), "ids": ids, "sizes": packed(n), "words": packed_keys(words), "places": packed(places.astype(np.int64))}
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for some, raws in tb.blocks(batches, "doc_id", "text"):
            h, n = tb.hash_words([tb.split(r, True) for r in raws])
            ids.extend(some)
            hashes.append(np.insert(h, np.cumsum(n), END))
            sizes.append(n + 1)
            held += len(hashes[-1])
            if held >= SYMBOLS:
                yield piece()
                ids, hashes, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield piece()

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


class Piece:
    """A piece with the answers so far, and the requests it makes for the next ones."""

    def __init__(self, row: dict, answers: pa.Table | None, buckets: int) -> None:
        self.number, self.buckets, self.ids = row["piece"], buckets, row["ids"]
        self.words = unpacked_keys(row["words"])
        self.sizes = unpacked(row["sizes"], np.int64, len(self.ids))
        self.ends = np.cumsum(self.sizes)
        self.w = unpacked(row["places"], np.int64, int(self.ends[-1]))
        self.end = int(np.searchsorted(self.words, END))
        out = np.array([held_out(i) for i in self.ids], bool)
        self.owner = np.repeat(np.arange(len(out)), self.sizes)
        self.held_out, self.train = out, ~out[self.owner]
        self.requests: list[tuple[int, int, bytes, bytes]] = []
        self.answers: dict[int, list[bytes]] = {}
        if answers is not None:
            for _, tag, sums in sorted(zip(answers["bucket"].to_pylist(), answers["tag"].to_pylist(), answers["sums"].to_pylist(), strict=True), key=lambda r: r[:2]):
                self.answers.setdefault(tag, []).append(sums)

    def bounds(self, keys: np.ndarray) -> list[int]:
        """Where each bucket's keys start, and the end of the last."""
        edges = np.array([-(-(k << 64) // self.buckets) for k in range(1, self.buckets)], np.uint64)
        return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]

    def ask(self, tag: int, keys: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(keys)
        keys, parts = keys[order], parts[order]
        at = self.bounds(keys)
        self.requests += [(k, tag, packed_keys(keys[a:b]), packed(parts[a:b])) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]

    def told(self, tag: int, keys: np.ndarray) -> np.ndarray:
        """The sums of the keys that were asked for."""
        order = np.argsort(keys)
        bounds = self.bounds(keys[order])
        at = [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if a < b]
        out = np.empty(len(keys), np.int64)
        if at:
            out[order] = np.concatenate([unpacked(s, np.int64, b - a) for s, (a, b) in zip(self.answers[tag], at, strict=True)])
        return out

    def counts(self, tag: int, keys: np.ndarray, place: np.ndarray, train: np.ndarray) -> None:
        """Asks how often training has each key (place: of each symbol's key); bit 0 says that held-out texts have it."""
        n = np.bincount(place[train], minlength=len(keys))
        self.ask(tag, keys, 2 * n + (np.bincount(place[~train], minlength=len(keys)) > 0))

    def level(self, tags: tuple[int, int], stage: int, keys: np.ndarray, context: np.ndarray, held: np.ndarray, asked: np.ndarray, c: np.ndarray, below: np.ndarray) -> np.ndarray | None:
        """log P of each symbol after its context, given that after the suffix (below); None if answers are still to come.

        keys, held, asked: of the contexts, with their occurrences in training; context, c: of each symbol, with its count there.
        stage: how many of tags are answered; the next is asked for.
        """
        alone = np.flatnonzero(~asked[context] & (held[context] > 0) & (c == held[context]))
        settled = np.zeros(len(keys), bool)
        settled[context[alone]] = True
        open_ = ~settled & (held > 1)
        use = self.train
        if stage == 0:
            self.ask(tags[0], keys[open_], np.rint(TYPE * np.bincount(context[use], 1.0 / c[use], len(keys))[open_]).astype(np.int64))
            return None
        types = np.ones(len(keys))
        types[open_] = self.told(tags[0], keys[open_])
        rest = np.maximum(DISCOUNT * types / np.maximum(held, 1), 1e-9)
        logs = np.log(rest)[context] + below
        known = np.flatnonzero(c > 0)
        logs[known] = np.log((c[known] - DISCOUNT) / held[context[known]] + rest[context[known]] * np.exp(below[known]))
        gain = logs - below
        open_ = ~settled & (held > 0)
        if stage == 1:
            self.ask(tags[1], keys[open_], np.rint(NAT * np.bincount(context[use], gain[use] / held[context[use]], len(keys))[open_]).astype(np.int64))
            return None
        keep = np.zeros(len(keys), bool)
        keep[context[alone]] = gain[alone] >= DIVERGENCE
        keep[open_] = self.told(tags[1], keys[open_]) > 0
        return np.where(keep[context], logs, below)

    def work(self, stage: int, texts: int, total: float) -> np.ndarray | None:
        """Makes the requests of a round (stage, from 0); after the last, log P of each symbol.  texts: in training; total: the root's divisor."""
        first = np.zeros(len(self.w), bool)
        first[self.ends - self.sizes] = True
        one = np.where(first, self.end, np.append(self.end, self.w[:-1]))
        pairs, pair = np.unique(tb.mix(self.words[one] * STEP + self.words[self.w]), return_inverse=True)
        if stage == 0:
            self.counts(WORDS, self.words, self.w, self.train)
            self.counts(PAIRS, pairs, pair, self.train)
            return None
        self.known = self.told(WORDS, self.words)
        n, asked = self.known >> 1, (self.known & 1) > 0
        self.known = n
        self.root = np.log((n + 1.0) / total)
        of_pairs = self.told(PAIRS, pairs)
        c, root = (of_pairs >> 1)[pair], self.root[self.w]
        # a symbol's context of two is the pair before it; before a text's first word it is START, which every text has
        context = np.where(first, len(pairs), np.append(0, pair[:-1]))
        contexts = np.append(pairs, START)
        held, sought = np.append(of_pairs >> 1, texts), np.append((of_pairs & 1) > 0, True)
        once = (held == 1) & ~sought  # what follows was seen here, once
        open_ = np.flatnonzero((held > 0)[context] & ~once[context])
        triples, triple = np.unique(tb.mix(tb.mix(contexts[context[open_]] + STEP) * STEP + self.words[self.w[open_]]), return_inverse=True)
        after = self.level((WORD_TYPES, WORD_GAINS), stage - 1, self.words, one, n, asked, c, root)
        if stage == 1:
            self.counts(TRIPLES, triples, triple, self.train[open_])
            return None
        count = once[context].astype(np.int64)
        count[open_] = (self.told(TRIPLES, triples) >> 1)[triple]
        # the divergence of pairs needs their suffixes' answers, which come a round before
        return self.level((PAIR_TYPES, PAIR_GAINS), stage - 2, contexts, context, held, sought, count, root if after is None else after)

    def asked(self) -> pa.Table:
        k, tag, keys, parts = zip(*self.requests, strict=True) if self.requests else ((),) * 4
        return pa.table({"bucket": pa.array(k, pa.int32()), "piece": pa.array([self.number] * len(k), pa.int64()), "tag": pa.array(tag, pa.int32()), "keys": pa.array(keys, pa.binary()), "parts": pa.array(parts, pa.binary())})


def totals(asked: pa.Table) -> pa.Table:
    """A bucket's sums, for each piece in the order of its keys; a row without piece has the number of words in training."""
    bucket, tags, out = asked["bucket"][0].as_py(), asked["tag"].to_numpy(), []
    for tag in np.unique(tags).tolist():
        some = asked.filter(pa.array(tags == tag))
        keys = [unpacked_keys(b) for b in some["keys"].to_pylist()]
        sizes = [len(k) for k in keys]
        unique, place = np.unique(np.concatenate(keys), return_inverse=True)
        keys, unique = [], len(unique)
        parts = np.concatenate([unpacked(b, np.int64, n) for b, n in zip(some["parts"].to_pylist(), sizes, strict=True)])
        if tag in (WORDS, PAIRS, TRIPLES):
            n = np.bincount(place, parts >> 1, unique).astype(np.int64)
            sums = 2 * n + (np.bincount(place, parts & 1, unique) > 0)
            if tag == WORDS:
                out.append((None, bucket, tag, int((n > 0).sum()).to_bytes(8, "little")))
        elif tag in (WORD_TYPES, PAIR_TYPES):
            sums = np.rint(np.bincount(place, parts, unique) / TYPE).astype(np.int64)
        else:
            sums = (np.bincount(place, parts, unique) >= DIVERGENCE * NAT).astype(np.int64)
        ends = np.cumsum(sizes).tolist()
        out += [(p, bucket, tag, packed(sums[place[b - n : b]])) for p, n, b in zip(some["piece"].to_pylist(), sizes, ends, strict=True)]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["piece", "bucket", "tag", "sums"])


def answered(requests: DataFrame, what: str) -> DataFrame:
    """The answers to requests, as a table; the files of its shuffles go at once, as each round has some of the input's size."""
    conf, name = requests.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return written(requests.groupBy("bucket").applyInArrow(totals, ANSWER), what)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def by_piece(found: DataFrame) -> DataFrame:
    """found as a table in the shared folder, dealt by piece, so that rounds meet it where it lies; the catalogue forgets it at once."""
    spark, at = found.sparkSession, new_dir(found.sparkSession, "pieces")
    name = "plumbline_" + at.rsplit("-", 1)[1]
    found.write.option("path", at).option("compression", "zstd").bucketBy(shuffle_partitions(spark), "piece").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # it is external: the files stay
    return out


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows that are not held out."""
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    kept = by_piece(pieces(docs))
    tokens, texts = kept.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("texts"), F.lit(0))).first()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                piece = Piece(batch.slice(row, 1).to_pylist()[0], None, buckets)
                piece.work(0, texts, 1.0)
                yield from piece.asked().to_batches()

    answers = [answered(kept.mapInArrow(first, REQUEST), "words")]
    counted = answers[0].where("piece IS NULL").select("sums").toPandas()["sums"]
    total = tokens + sum(int.from_bytes(b, "little") for b in counted) + 1.0

    def met(run, schema: str) -> DataFrame:
        told = reduce(DataFrame.unionByName, answers).where("piece IS NOT NULL")
        return kept.groupBy("piece").cogroup(told.groupBy("piece")).applyInArrow(run, schema)

    def asks(stage: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            piece = Piece(left.to_pylist()[0], right, buckets)
            piece.work(stage, texts, total)
            return piece.asked()

        return run

    def scores(left: pa.Table, right: pa.Table) -> pa.Table:
        piece = Piece(left.to_pylist()[0], right, buckets)
        logs = piece.work(4, texts, total) / np.log(10)
        n = len(piece.ids)
        add = lambda x: np.bincount(piece.owner, x, n)
        columns = (piece.ids, piece.held_out, piece.sizes, add(piece.known[piece.w] > 0).astype(np.int64), np.full(n, tokens, np.int64), add(piece.root[piece.w]) / np.log(10), add(logs))
        types = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCORE.split(", ")])

    for stage, what in ((1, "triples"), (2, "types"), (3, "states")):
        answers.append(answered(met(asks(stage), REQUEST), what))
    return met(scores, SCORE)


def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
