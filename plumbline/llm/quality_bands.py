"""Quality rules: zstandard compression bands.

A text that repeats itself compresses far better than prose of its length, and
random or encoded text far worse.  ``BANDS`` gives, by length in bytes, the
ratios (bytes / compressed bytes) that prose can have; a document is rejected
if its whole text lies outside its band, or if chunks outside the band of their
length (``CHUNK_BANDS``) hold more than ``BAD_SHARE`` of the bytes of its chunks.  A tail too
short to be judged belongs to the chunk before it.  The lower chunk limits lie between base64 (1.25
at 1 KiB, 1.31 at 4 KiB) and the least of the prose of sf0.1 (1.58 and 1.90), so that clean documents stay.

Cases: null and empty texts have no words and fail the base rule (``n_words``
0); their ratio is null.  Repeated rows and ties are judged row by row.  An
empty table gives an empty result.  Columns beyond ``doc_id`` and ``text``
are not read, so clashing names do no harm.  Texts of any length are
compressed whole and chunk by chunk, never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import table

#: (bytes below, lowest, highest ratio) of whole texts.
BANDS = (
    (100, 0.0, 3.5), (250, 0.85, 2.7), (500, 1.05, 2.7), (1000, 1.15, 2.8), (2000, 1.25, 3.0),
    (4000, 1.35, 3.3), (8000, 1.4, 3.6), (16000, 1.4, 3.9), (64000, 1.4, 4.4), (1 << 62, 1.4, 6.0),
)
#: Bytes of a chunk, shortest chunk that is judged, share of bad bytes that rejects.
CHUNK, LEAST_CHUNK, BAD_SHARE = 4096, 1024, 0.2
#: As BANDS, of chunks.
CHUNK_BANDS = ((1536, 1.4, 3.6), (2048, 1.45, 3.6), (3072, 1.5, 3.6), (4096, 1.55, 3.6), (1 << 62, 1.6, 3.6))
LEVEL = 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunk_share double, reason string"
)


def band_of(n: int, bands: tuple = BANDS) -> tuple[float, float]:
    return next((lo, hi) for most, lo, hi in bands if n < most)


def compression(raw: bytes, packer: zstandard.ZstdCompressor) -> tuple[float | None, float]:
    """Ratio of the whole text, and the share of its chunk bytes that lie outside their band."""
    if not raw:
        return None, 0.0
    ratio = len(raw) / len(packer.compress(raw))
    bad = seen = at = 0
    while len(raw) - at >= LEAST_CHUNK:
        end = at + CHUNK if len(raw) - at >= CHUNK + LEAST_CHUNK else len(raw)
        n = end - at
        r = ratio if n == len(raw) else n / len(packer.compress(raw[at:end]))
        lo, hi = band_of(n, CHUNK_BANDS)
        seen += n
        bad += n * (not lo <= r <= hi)
        at = end
    return ratio, bad / seen if seen else 0.0


def verdict(n: int, ratio: float | None, bad_share: float) -> str | None:
    """Why the method rejects a text, or None."""
    if ratio is None:
        return None
    lo, hi = band_of(n)
    if ratio > hi:
        return "repetitive"
    if ratio < lo:
        return "incompressible"
    return "chunks" if bad_share > BAD_SHARE else None


def dup_lines(text: str) -> int:
    lines = text.split("\n")
    if len(lines) < 2:
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.encode().split())
        else:
            seen.add(line)
    return n


def repeat_words(h: np.ndarray, counts: np.ndarray, n: int = 3) -> np.ndarray:
    """Per document, the words in windows of n words that the document has twice or more."""
    doc = np.repeat(np.arange(len(counts)), counts)
    at = tb.inside(counts, n)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    grams = tb.ngrams(h, n)[at] ^ tb.mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(h), bool)
    starts = at[order[twice]]
    for k in range(n):
        hit[starts + k] = True
    return np.bincount(doc[hit], minlength=len(counts)).astype(np.int64)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for ids, raws in tb.blocks(batches, "doc_id", "text"):
        h, n_words = tb.hash_words([tb.split(r, False) for r in raws])
        repeats = repeat_words(h, n_words)
        out: dict[str, list] = {k: [] for k in ("word_chars", "n_symbols", "n_dup_lines", "ratio", "bad_chunk_share", "reason")}
        for raw in raws:
            text = (raw or b"").decode("utf-8", "replace")
            out["word_chars"].append(len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")))
            out["n_symbols"].append(sum(map(text.count, "#*$%&|<>")))
            out["n_dup_lines"].append(dup_lines(text))
            ratio, bad = compression(raw or b"", packer)
            out["ratio"].append(ratio)
            out["bad_chunk_share"].append(bad)
            out["reason"].append(verdict(len(raw or b""), ratio, bad))
        base = (n_words < 50) | (100 * repeats > 50 * n_words)
        kept = [not b and r is None for b, r in zip(base.tolist(), out["reason"], strict=True)]
        long = pa.int64()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, long), pa.array(n_words, long), pa.array(out["word_chars"], long), pa.array(out["n_symbols"], long),
                pa.array(out["n_dup_lines"], long), pa.array(repeats, long), pa.array(base), pa.array(kept, pa.bool_()),
                pa.array(out["ratio"], pa.float64()), pa.array(out["bad_chunk_share"], pa.float64()), pa.array(out["reason"], pa.string()),
            ],
            names=[x.split()[0] for x in SCHEMA.split(", ")],
        )


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), with the base counts, both verdicts and the method's figures."""
    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs without what the rules reject; all columns stay as they are."""
    names = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [k for out in judge(iter([batch])) for k in out.column("kept").to_pylist()]
            yield batch.filter(pa.array(flags, pa.bool_())).select(names)

    return docs.mapInArrow(keep, docs.schema)


def op7_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
