"""Substring dedup by a count-min prefilter and an exact second pass.

A window is ``N`` consecutive words of one document.  Every word covered by a
window whose word sequence also starts in a document with a smaller doc_id is
removed; windows are judged on the input.

1. Each task sends, for its windows, the cells they hit in ``ROWS`` rows of a
   count-min sketch, as compressed gaps of sorted cells.  The sketches
   are merged chunk by chunk, counting to two.  A merged count never is below
   the true one, so a window of two documents is never lost.
2. The merged bits (``ROWS`` x cells / 8 bytes, at most ``MOST_CELLS`` cells, so
   64 MB) are broadcast; only windows estimated repeated go on, with 96
   hash bits, once for each document, and are grouped exactly by these bits.  A task resolves what it
   can itself: of the documents that it met with a window all but that of the least doc_id lose it, whatever others
   hold; only the least one is sent on.  So a window sends one row a task, however many documents share it,
   and no bucket holds more than a row a window and task.
   Beyond about MOST_CELLS windows the filter lets more windows pass; results
   stay the same, and the exact pass carries the load in as many buckets as the texts' size asks for.
3. The positions found come together by row and the words go.

Cases: null counts as the empty text; a document of fewer than N words loses
nothing; words are compared by two hashes of their bytes.  A row without doc_id loses nothing and takes nothing from others.  Rows that repeat a
doc_id take nothing from each other and are judged each by its own text (a row is known by a 64-bit hash of doc_id and text).  An empty table gives an empty
result.  Other columns are carried by ``dedup`` and not read by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import shuffle_partitions, table, unused

N, ROWS, MOST_CELLS, LEAST_CELLS, CHUNKS = 13, 2, 1 << 28, 1 << 16, 64
#: Windows that a task holds before it sends them on; bytes of text for each bucket of the exact pass.
HELD, BUCKET_BYTES = 1 << 20, 8 << 20
_ROW = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
PACKED = "doc_id long, row long, packed binary"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def windows(raws: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: document (place in raws), position, and two hashes."""
    h, counts = tb.hash_words([tb.split(r, False) for r in raws])
    at = tb.inside(counts, n)
    if not len(at):
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64), np.empty(0, np.uint64)
    doc = np.repeat(np.arange(len(counts)), counts)[at]
    pos = at - (np.cumsum(counts) - counts)[doc]
    return doc, pos, tb.ngrams(h, n, 1)[at], tb.ngrams(h, n, 2)[at]


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return tb.mix(h * _ROW[row]) >> np.uint64(64 - bits)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def sketch_bits(size: int) -> int:
    """Twice as many cells as words at least, from the texts' total length, within the bounds."""
    return (min(MOST_CELLS, max(LEAST_CELLS, size // 4)) - 1).bit_length()


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def sketch(docs: DataFrame, n: int, bits: int) -> list[np.ndarray]:
    """For each row the bits of cells counted twice or more."""
    per = 1 << (bits - 6)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = zstandard.ZstdCompressor(level=1), [], 0

        def send() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            for row in range(ROWS):
                c = np.sort(cells(h, row, bits))
                c = c[np.append(np.ones(min(2, len(c)), bool), c[2:] != c[:-2])]  # twice is enough
                ends = np.searchsorted(c, np.arange(1, CHUNKS + 1, dtype=np.uint64) * np.uint64(per))
                parts = np.split(c, ends[:-1])
                keys = [row * CHUNKS + k for k, p in enumerate(parts) if len(p)]
                gaps = [packer.compress(np.diff(p, prepend=np.uint64(k % CHUNKS * per)).astype("<u4").tobytes()) for k, p in enumerate(parts) if len(p)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(gaps, pa.binary())], names=["chunk", "gaps"])

        for _, raws in tb.blocks(batches, "doc_id", "text"):
            h = windows(raws, n)[2]
            held.append(h)
            size += len(h)
            if size >= HELD:
                yield from send()
                held, size = [], 0
        if size:
            yield from send()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, seen = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for chunk, gaps in zip(batch.column("chunk").to_pylist(), batch.column("gaps").to_pylist(), strict=True):
                at = np.cumsum(np.frombuffer(unpacker.decompress(gaps), "<u4"), dtype=np.int64)
                counts = seen.setdefault(chunk, np.zeros(per, np.uint8))
                twice = at[1:][at[1:] == at[:-1]]
                counts[at] = np.minimum(counts[at] + 1, 2)
                counts[twice] = 2
        for chunk, counts in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(counts >= 2).tobytes()], pa.binary())], names=["chunk", "bits"])

    spark = docs.sparkSession
    sent = docs.select("doc_id", "text").mapInArrow(count, "chunk int, gaps binary")
    merged = sent.repartition(min(ROWS * CHUNKS, shuffle_partitions(spark)), "chunk").mapInArrow(merge, "chunk int, bits binary")
    out = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(ROWS)]
    for chunk, got in merged.toLocalIterator():  # at most ROWS x MOST_CELLS / 8 bytes
        row, k = divmod(chunk, CHUNKS)
        out[row][k * per // 8 : (k + 1) * per // 8] = np.frombuffer(got, np.uint8)
    return out


def repeated(rows: list[np.ndarray], h: np.ndarray, bits: int) -> np.ndarray:
    """Which windows are estimated repeated."""
    hit = np.ones(len(h), bool)
    for row, held in enumerate(rows):
        c = cells(h, row, bits).astype(np.int64)
        hit &= (held[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
    return hit


def parted(rows: np.ndarray, pos: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Late windows (row, position) as blobs by the bucket of their row."""
    home = (tb.mix(rows.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((rows, home))
    rows, pos, home = rows[order], pos[order], home[order]
    cuts = np.flatnonzero(home[1:] != home[:-1]) + 1
    blobs = [b"L" + r.astype("<i8").tobytes() + p.astype("<u4").tobytes() for r, p in zip(np.split(rows, cuts), np.split(pos, cuts), strict=True)] if len(rows) else []
    return pa.RecordBatch.from_arrays([pa.array(home[np.append(0, cuts)] if len(rows) else home), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def lost(h1: np.ndarray, h2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and doc_id, and which in that order have a smaller doc_id beside them."""
    order = np.lexsort((ids, h2, h1))
    a, b, i = h1[order], h2[order], ids[order]
    new = np.append(np.ones(min(1, len(i)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    least = i[np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))]
    return order, i > least


def found(docs: DataFrame, n: int = N) -> DataFrame:
    """row, positions (unsigned 32-bit integers): windows that a smaller doc_id has; each distinct window of a row once."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", row_key().alias("row"), "text")
    size = text_bytes(docs)
    bits = sketch_bits(size)
    shared = spark.sparkContext.broadcast(sketch(docs, n, bits))
    buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of, packer, held, size = shared.value, zstandard.ZstdCompressor(level=1), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, rows, pos, h1, h2 = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, late = lost(h1, h2, ids)
            yield parted(rows[order[late]], pos[order[late]], buckets)
            some = np.sort(order[~late])  # by document, so that their places compress
            bucket = (h1[some] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            some, bucket = some[by], bucket[by]
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            keys, blobs = bucket[np.append(0, cuts)], []
            for part in np.split(some, cuts):
                places = packer.compress(np.stack([ids[part], rows[part], pos[part]]).astype("<i8").tobytes())
                blobs.append(b"W" + len(part).to_bytes(4, "little") + h1[part].astype("<u8").tobytes() + h2[part].astype("<u4").tobytes() + places)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for keys, raws in tb.blocks(batches, ("doc_id", "row"), "text"):
            doc, pos, h1, h2 = windows(raws, n)
            hit = np.flatnonzero(repeated(bits_of, h1, bits))
            if len(hit):
                _, first = np.unique(h1[hit] ^ tb.mix(doc[hit].astype(np.uint64) + np.uint64(1)), return_index=True)
                hit = hit[np.sort(first)]
                ids, rows = np.array(keys, np.int64).T
                held.append((ids[doc[hit]], rows[doc[hit]], pos[hit], h1[hit], h2[hit] & np.uint64(0xFFFFFFFF)))
                size += len(hit)
                if size >= HELD:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Late windows pass on; of the others those go on that a smaller doc_id has."""
        unpacker, got = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            late = []
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                late.append(blob[:1] == b"L")
                if not late[-1]:
                    got.setdefault(b, []).append(blob)
            yield batch.filter(pa.array(late, pa.bool_()))
        for b in list(got):
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for blob in got.pop(b):
                m = int.from_bytes(blob[1:5], "little")
                ids, rows, pos = np.frombuffer(unpacker.decompress(blob[5 + 12 * m :]), "<i8").reshape(3, m)
                for c, x in zip(cols, (np.frombuffer(blob, "<u8", m, 5), np.frombuffer(blob, "<u4", m, 5 + 8 * m), ids, rows, pos), strict=True):
                    c.append(x)
            h1, h2, ids, rows, pos = map(np.concatenate, cols)
            order, late = lost(h1, h2, ids)
            yield parted(rows[order[late]], pos[order[late]], buckets)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pos = [np.empty(0, np.int64)], [np.empty(0, np.uint32)]
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                m = len(blob) // 12
                rows.append(np.frombuffer(blob, "<i8", m, 1))
                pos.append(np.frombuffer(blob, "<u4", m, 1 + 8 * m))
        r, p = np.concatenate(rows), np.concatenate(pos)
        if len(r):
            order = np.argsort(r, kind="stable")
            r, p = r[order], p[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(r[np.append(0, cuts)]), pa.array([x.astype("<u4").tobytes() for x in np.split(p, cuts)], pa.binary())], names=["row", "positions"])

    schema = "bucket int, blob binary"
    late = docs.mapInArrow(send, schema).repartition(buckets, "bucket").mapInArrow(group, schema)
    return late.repartition(buckets, "bucket").mapInArrow(gather, "row long, positions binary")


def kept_words(raw: bytes | None, positions: bytes | None, n: int) -> tuple[int, list[bytes]]:
    """The number of words, and those that stay."""
    words = tb.split(raw, False)
    if not positions:
        return len(words), words
    h = windows([raw], n)[2]
    starts = np.frombuffer(positions, "<u4").astype(np.int64)
    starts = np.flatnonzero(np.isin(h, h[starts]))
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    stay = np.cumsum(edge)[:-1] == 0
    return len(words), [w for w, s in zip(words, stay.tolist(), strict=True) if s]


def _joined(docs: DataFrame, n: int) -> DataFrame:
    """Packed texts with the positions found, side by side."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for keys, raws in tb.blocks(batches, ("doc_id", "row"), "text"):
            ids, rows = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array([packer.compress(r or b"") for r in raws], pa.binary())], names=["doc_id", "row", "packed"])

    return docs.select("doc_id", row_key().alias("row"), "text").mapInArrow(pack, PACKED).join(found(docs, n), "row", "left")


def dedup_digests(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for i, packed, positions in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "positions")), strict=True):
                total, stay = kept_words(unpacker.decompress(packed), positions, n)
                rows.append((i, total, total - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return _joined(docs, n).mapInArrow(run, SCHEMA)


def dedup(docs: DataFrame, n: int = N) -> DataFrame:
    """docs with each text's kept words, joined by single spaces where words were removed; other texts stay as they are, as do other columns."""
    row, positions = unused(docs, "late_row"), unused(docs, "late_positions")
    late = found(docs, n).toDF(row, positions)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, late in zip(binaries_of(batch), batch.column(positions).to_pylist(), strict=True):
                texts.append(raw if not late else b" ".join(kept_words(raw, late, n)[1]))
            field = batch.schema.field("text")
            out = batch.select(names)
            yield out.set_column(names.index("text"), field, pa.array(texts, pa.binary()).cast(field.type))

    def binaries_of(batch: pa.RecordBatch) -> list[bytes | None]:
        return tb.binaries(batch.column("text"))

    return docs.withColumn(row, row_key()).join(late, row, "left").drop(row).mapInArrow(run, schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digests(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) AS r(i)),
m AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT s.doc_id, s.i + k AS p FROM s JOIN m USING (g), unnest(range(13)) AS r(k) WHERE m.least < s.doc_id),
w AS (SELECT doc_id, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS r(p)),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY w.p) AS t FROM w ANTI JOIN hit ON w.doc_id = hit.doc_id AND w.p = hit.p GROUP BY w.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
