"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

``MergeList.lookahead`` gives, of each token, how many symbols beyond its end must be
known before no further input can change it.  New input changes a token only by a
rule (c, d) that takes a piece c off the right side of the token, where c is the token or
a last piece from which it was merged later than that rule; and whether d comes about
depends in the same way on what follows d.  So a rule's reach is the length of d and the reach into d,
computed in the order of the merge list, and a token's lookahead is the longest reach of the rules that can take a piece of it.
A rule whose right part ends a word reaches no further.
``Transducer`` holds symbols back, emits every token once it is
stable, and restarts at the last emitted boundary (merges never cross a token
boundary of the final result, so what follows it is encoded as if alone).
Its memory is constant in the length of a word.  Every word goes through it; the tokens of short words are kept
for the next time they come.  ``Decoder`` turns ids into
text: tokens' bytes go through an incremental UTF-8 state machine, cut anywhere.

The encoder follows the tokenizer file (normalizer, split pattern, merges,
word end, added tokens) and equals the tokenizers library with
add_special_tokens=False; its ``decode`` equals that library's
decode(ids, skip_special_tokens=False), which joins the tokens' strings by
spaces as this file names no decoder.

Cases: null counts as the empty text, which has no tokens and decodes to the
empty text.  Very long texts go through in segments cut at white space, very long words byte by byte.
Repeated rows give repeated rows, an empty table an empty result; columns
beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import textblocks as tb
from plumbline.llm.shared import table

TOKENIZER = "word_bpe_49k.json"
#: Words and white-space-free runs kept at once in a worker's memory; longer ones than LONG are never kept.
KEPT, RUNS, LONG = 200_000, 250_000, 48
#: Characters of a segment of a text; bytes pushed at once.
SEGMENT, PUSHED = 1 << 16, 1 << 12
#: White space of the file's pattern (Unicode White_Space).
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = re.compile("[\x1c-\x1f]")

LITTLE = sys.byteorder == "little"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: Latin-1's own where printable, else from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


LETTER = byte_letters()


class MergeList:
    """Vocabulary and merge rules as integers, and the sufficient lookahead."""

    def __init__(self, model: dict) -> None:
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        #: Of a pair its rule's place in the list and the new token, as one number: the least is the strongest.
        self.rules: dict[tuple[int, int], int] = {}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        for rank, (a, b) in enumerate(merges):
            self.rules.setdefault((self.ids[a], self.ids[b]), rank << 32 | self.ids[a + b])
        self.symbol = [self.ids.get(LETTER[b]) for b in range(256)]
        self.final = [self.ids.get(LETTER[b] + self.end) for b in range(256)]
        self.width = {i: len(s.removesuffix(self.end) if self.end else s) for s, i in self.ids.items()}
        self.lookahead = self._lookahead()
        self.most = max(self.lookahead.values(), default=0)
        self.room = max((self.width[t] + n for t, n in self.lookahead.items()), default=1)

    def _lookahead(self) -> dict[int, int]:
        """Of each token, the symbols beyond its end that can still change it."""
        whole: dict[int, int] = {}  # reach of the rules so far that take a token as their left part
        inner: dict[int, int] = {}  # reach into a token's last pieces before they are merged
        used: set[int] = set()
        for (a, b), rule in sorted(self.rules.items(), key=lambda r: r[1]):
            new = rule & 0xFFFFFFFF
            if new in used:
                raise ValueError("a rule makes a token that an earlier rule uses; the lookahead would not be sufficient")
            into = max(whole.get(b, 0), inner.get(b, 0))
            whole[a] = max(whole.get(a, 0), self.width[b] + into)
            inner[new] = max(inner.get(new, 0), into)
            used |= {a, b}
        return {t: max(whole.get(t, 0), inner.get(t, 0)) for t in self.width}

    def merge(self, symbols: list[int]) -> list[int]:
        """The tokens of a run of symbols: the strongest rule first, from the left."""
        get, none, out = self.rules.get, 1 << 62, symbols[:]
        found = [get(pair, none) for pair in zip(out, out[1:])]
        n = len(found)
        while n:
            best = min(found)
            if best == none:
                break
            i, n = found.index(best), n - 1
            out[i] = new = best & 0xFFFFFFFF
            del out[i + 1], found[i]
            if i:
                found[i - 1] = get((out[i - 1], new), none)
            if i < n:
                found[i] = get((new, out[i + 1]), none)
        return out


class Transducer:
    """Encodes one word that comes in pieces of bytes; push() and finish() return the tokens that have become stable."""

    #: Symbols held beyond the least that lets a token go, so that merging is not done for each of them.
    SLACK = 256

    def __init__(self, merges: MergeList) -> None:
        self.merges = merges
        self.held: list[int] = []
        self.last: int | None = None
        self.emitted = 0
        self.room = merges.room + self.SLACK

    def push(self, raw: bytes) -> list[int]:
        """The last byte waits, as it may end the word."""
        if self.last is not None:
            raw = bytes((self.last,)) + raw
        if not raw:
            return []
        self.last, out, at, end = raw[-1], [], 0, len(raw) - 1
        while at < end:
            step = min(end, at + self.room - len(self.held))
            self.held += [s for b in raw[at:step] if (s := self.merges.symbol[b]) is not None]
            at = step
            if len(self.held) >= self.room:
                out += self._stable()
        return out

    def _stable(self) -> list[int]:
        out, used, n, m = [], 0, len(self.held), self.merges
        for t in m.merge(self.held):
            if used + m.width[t] + m.lookahead[t] > n:
                break
            out.append(t)
            used += m.width[t]
        self.held = self.held[used:]
        self.emitted += len(out)
        return out

    def finish(self) -> list[int]:
        if self.last is not None and (s := self.merges.final[self.last]) is not None:
            self.held.append(s)
        out, self.held, self.last = self.merges.merge(self.held), [], None
        self.emitted += len(out)
        return out


class Decoder:
    """Ids to text, as they come.

    The bytes of each id go through an incremental UTF-8 decoder: a character may be cut anywhere, malformed
    bytes become U+FFFD.  `bytes_of` gives each id's bytes; `between` parts two ids.
    """

    def __init__(self, bytes_of: list[bytes | None], between: bytes = b"") -> None:
        self.bytes_of, self.between, self.first = bytes_of, between, True
        self._state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        parts = [x for x in map(self.bytes_of.__getitem__, ids) if x is not None]
        if not parts:
            return ""
        raw = self.between.join(parts)
        if not self.first:
            raw = self.between + raw
        self.first = False
        return self._state.decode(raw)

    def finish(self) -> str:
        return self._state.decode(b"", True)


class Encoder:
    """The tokenizer file's encoder and decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = MergeList(spec["model"])
        text_of = {i: s for s, i in self.merges.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        text_of |= {i: s for s, i in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        most, end, byte_of = max(text_of) + 1, self.merges.end, {c: b for b, c in LETTER.items()}
        #: Of each id its string's bytes, and the bytes of the text that it stands for (a word end is a space).
        self.strings: list[bytes | None] = [text_of[i].encode() if i in text_of else None for i in range(most)]
        self.texts: list[bytes | None] = list(self.strings)
        special = set(self.added.values())
        for i, s in text_of.items():
            if i not in special:
                ends = bool(end) and s.endswith(end)
                self.texts[i] = bytes(byte_of[c] for c in (s.removesuffix(end) if ends else s)) + b" " * ends
        self.pieces: dict[str, bytes] = {}
        outer = self

        class Runs(dict):
            def __missing__(self, run: str) -> bytes:
                if len(run) > LONG:
                    return b"".join(outer.run(run))
                ids = b"".join([outer.pieces.get(w) or outer.piece(w) for w in outer.split(run)])
                if len(self) >= RUNS:
                    self.clear()
                self[run] = ids
                return ids

        self.runs = Runs()
        self.transducer = Transducer(self.merges)

    def split(self, run: str) -> list[str]:
        """The words of a run without white space: NFC, lower case character by character, split."""
        if not run.isascii():
            run = unicodedata.normalize("NFC", run).replace("Σ", "σ")
        return self.words.findall(run.lower())

    def piece(self, word: str) -> bytes:
        """Ids of one word, kept if it is short."""
        raw = word.encode()
        ids = array("I", self.transducer.push(raw) + self.transducer.finish()).tobytes()
        if len(raw) <= LONG:
            if len(self.pieces) >= KEPT:
                self.pieces.clear()
            self.pieces[word] = ids
        return ids

    def run(self, run: str) -> Iterator[bytes]:
        """Ids of text without white space, as the transducer emits them."""
        for w in self.split(run):
            if len(w) <= LONG:
                yield self.pieces.get(w) or self.piece(w)
                continue
            raw = w.encode()
            for at in range(0, len(raw), PUSHED):
                yield array("I", self.transducer.push(raw[at : at + PUSHED])).tobytes()
            yield array("I", self.transducer.finish()).tobytes()

    def packed(self, text: str) -> Iterator[bytes]:
        """Ids of a text as native unsigned 32-bit integers, segment by segment."""
        for part in self.special.split(text) if self.special and "<|" in text else [text]:
            if part in self.added:
                yield array("I", [self.added[part]]).tobytes()
                continue
            at = 0
            while at < len(part):
                cut = SPACE.search(part, at + SEGMENT) if len(part) - at > SEGMENT else None
                end = cut.end() if cut else len(part)
                segment = part[at:end] if at or end < len(part) else part
                at = end
                runs = list(filter(None, SPACE.split(segment))) if SEPARATORS.search(segment) else segment.split()
                if len(segment) > 2 * SEGMENT:
                    for run in runs:
                        yield from self.run(run)
                else:
                    yield b"".join(map(self.runs.__getitem__, runs))

    def encode(self, text: str) -> list[int]:
        return array("I", b"".join(self.packed(text))).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """As the library's decode for a file without decoder: the tokens' strings, parted by spaces."""
        state = Decoder(self.strings, b" ")
        return state.feed(ids) + state.finish()

    def text(self, ids: Iterable[int]) -> str:
        """Readable text: byte letters back to bytes, word ends to spaces, bytes to characters as they come."""
        state = Decoder(self.texts)
        return state.feed(ids) + state.finish()


_encoders: dict[str, Encoder] = {}


def encoder(name: str = TOKENIZER) -> Encoder:
    """One for each worker process, found by the public file's name or a path."""
    if name not in _encoders:
        import public_tokenizers

        _encoders[name] = Encoder(name if "/" in name else public_tokenizers.path(name))
    return _encoders[name]


def digests(batches: Iterator[pa.RecordBatch], name: str = TOKENIZER) -> Iterator[pa.RecordBatch]:
    """Counts and digests of the ids and of their decoding; both go on segment by segment."""
    enc = encoder(name)
    for ids, raws in tb.blocks(batches, "doc_id", "text"):
        counts, hashes, decoded = [], [], []
        for raw in raws:
            n, of_ids, of_text, state = 0, hashlib.sha256(), hashlib.sha256(), Decoder(enc.strings, b" ")
            for packed in enc.packed((raw or b"").decode("utf-8", "replace")):
                some = array("I", packed)
                n += len(some)
                of_ids.update(packed if LITTLE else swapped(some))
                of_text.update(state.feed(some).encode())
            of_text.update(state.finish().encode())
            counts.append(n)
            hashes.append(of_ids.hexdigest())
            decoded.append(of_text.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def swapped(ids: array) -> bytes:
    out = array("I", ids)
    out.byteswap()
    return out.tobytes()


def encode(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, ids (array of int): the tokens of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for ids, raws in tb.blocks(batches, "doc_id", "text"):
            rows = [enc.encode((r or b"").decode("utf-8", "replace")) for r in raws]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, decoded, text of (doc_id, ids): the library's decoding and the readable one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            rows = [r or [] for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(enc.decode, rows), pa.string()), pa.array(map(enc.text, rows), pa.string())], names=["doc_id", "decoded", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded string, text string")


def round_trip(docs: DataFrame) -> DataFrame:
    """Counts and digests of both directions, one row for each row of docs."""
    return docs.select("doc_id", "text").mapInArrow(digests, SCHEMA)


def op3_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
