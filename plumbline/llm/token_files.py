"""Token ids in Arrow's stream-file format, as fixed-size-list batches.

The ids of all documents, each followed by the end id, form one stream in
ascending doc_id order, cut into sequences of ``WIDTH`` ids; a mask of the
same shape, of packed bits, marks the ids that belong to the file's documents
(the last sequence of a file is padded by zeros outside the mask), and a third column, `ends`, the last id of
each document; a batch's metadata names the documents that end in it.  So a file alone tells its documents, where they
start and how long they are.  Ids take 16
bits where the vocabulary allows it, else 32.  A file is an Arrow
IPC file of record batches with these columns; being
fixed-size lists, sequence i lies at a computed offset, so a memory-mapped
file gives it without copying or parsing (``Sequences``).  The table that ``write`` returns has a row a
file (name, place, documents, tokens).

Range-partitioning by doc_id makes each partition's documents a contiguous
run, so files are written side by side, as many as the input's size asks for; a file's place in the stream is the sum of the
files before (one number a file, by a window over the table of files).  A file's name holds its task attempt, and
only the names that tasks report count: a lost executor's half-written files
are never read.

Cases: rows without doc_id come first; a null text counts as the empty text (its ids are just the end id).  Repeated
doc_ids stay next to each other, in the order of their bytes.  An empty table
gives no files and an empty result.  Columns beyond ``doc_id`` and ``text``
are not read.  Texts are encoded word by word.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import textblocks as tb
from plumbline.llm.bpe_stream import LETTER
from plumbline.llm.shared import new_dir, shuffle_partitions, table, written

TOKENIZER, END, WIDTH = "byte_bpe_50k.json", 0, 2048
#: Sequences of a record batch; documents whose ids are held at once while reading.
BATCH = 256
#: Bytes of words and of pieces kept in each of two generations in a worker's memory, and those of an entry beyond its characters and ids.
WORDS, PIECES, ENTRY = 128 << 20, 16 << 20, 150
#: Characters of the longest text kept, and of the longest word that is not encoded as a text is.
LONG, SHORT = 48, 4096
DOUBLE = re.compile(r"\s\s")


def latin(kind: str) -> str:
    """The visible characters below U+0250 of a Unicode category; all of them are assigned since Unicode 5.0."""
    return "".join(re.escape(chr(c)) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) if unicodedata.category(chr(c))[0] == kind)


LATIN = re.compile("[!-~\xa1-\u024f]+").fullmatch
#: The file's split pattern for a word of these characters, after a space or none.
PIECE = re.compile(rf" ?[{latin('L')}]+|'(?:[stmd]|re|ve|ll)| ?[{latin('N')}]+| ?[^ {latin('L')}{latin('N')}]+").findall
#: White space of the pattern (Unicode White_Space), and the pattern's runs of it with the words between.
WHITE = frozenset(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
RUNS = re.compile(" ?[^{0}]+|[{0}]+(?![^{0}])|[{0}]".format("".join(sorted(WHITE)))).findall
SPACE, SIGNS = LETTER[32], frozenset(string.punctuation)

#: Bytes of input for a file.
FILE_BYTES = 64 << 20
INDEX = "file string, part int, documents long, file_tokens long"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


class Uncut(ValueError):
    """White space at a word's side, so that its text cannot be cut into words."""


class Kept(dict):
    """Ids of texts met lately, as bytes; others come from `make`.

    After `most` bytes of new ones, those before are let go unless they are met again.  Long texts are not kept.
    """

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        self.make, self.most, self.held, self.before = make, most, 0, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text) or self.make(text)
        if len(text) <= LONG:
            if self.held >= self.most:
                self.before, self.held = dict(self), 0
                self.clear()
            self[text] = ids
            self.held += ENTRY + len(text) + len(ids)
        return ids


class Encoder:
    """The tokenizers library, asked once for each piece of a word.

    This file's split pattern starts a token at each space between two
    non-space characters, and makes a single line feed between two non-space
    characters a token of its own.  So the ids of a text without two white
    space characters in a row are those of its space-led words and lines, in
    order.  A longer run of white space is a token but for its last character,
    which leads the next word if it is a space and stands alone if not; a run
    that ends the text is one token.  A text with an added token goes to the
    library whole, and so does one with U+001C to U+001F at a word's side.
    Words met lately are kept.  Other words are split into pieces (runs of letters, of digits, of
    other signs), by ``PIECE`` if they are of Latin characters, else by the
    library; the library's model gives the ids of each new piece.
    """

    def __init__(self, name: str) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tk = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.tk.no_padding()
        self.tk.no_truncation()
        self.tokenize = self.tk.model.tokenize
        self.raw = [i.to_bytes(4, "little") for i in range(max(self.tk.get_vocab().values()) + 1)]
        self.cuts = self._splits_as_piece()
        self.added = [t.content for t in self.tk.get_added_tokens_decoder().values()]
        self.feed = self._whole("\n") if self.cuts else b""
        assert not self.cuts or len(self.feed) == 4
        self.words, self.pieces = Kept(self._word, WORDS), Kept(self._piece, PIECES)

    def _splits_as_piece(self) -> bool:
        """Whether the file's split is that of ``PIECE``; texts go to the library whole otherwise."""
        if self.tk.normalizer or not self.tk.pre_tokenizer:
            return False
        split = json.loads(self.tk.pre_tokenizer.__getstate__())
        return split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]

    def _ids(self, letters: str) -> bytes:
        raw = self.raw
        return b"".join([raw[t.id] for t in self.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece, which may begin with a space, or of a run of white space."""
        if len(piece) > SHORT:
            return self._whole(piece)
        return self._ids(piece.replace(" ", SPACE) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(LETTER))

    def _word(self, word: str) -> bytes:
        """A word's ids: space-led, unless a line feed leads it."""
        long = len(word) > SHORT
        if word.isascii() and not long:
            if word.isalpha():
                return self._ids(SPACE + word)
            if word[-1:] in SIGNS and word[:-1].isalpha():
                return self.words[word[:-1]] + self.pieces[word[-1]]
        lead, bare = (self.feed, word[1:]) if word[:1] == "\n" else (b"", word)
        if not long and LATIN(bare):
            if lead:
                return lead + b"".join(map(self.pieces.__getitem__, PIECE(bare)))
            first, *rest = PIECE(" " + bare)
            return self.words[first[1:]] + b"".join(map(self.pieces.__getitem__, rest)) if rest else self._piece(first)
        if not bare or bare[0].isspace() or bare[-1].isspace() or DOUBLE.search(bare):
            raise Uncut
        led = bare if lead else " " + bare
        return lead + (self._whole(led) if long else b"".join([self._ids(letters) for letters, _ in self.tk.pre_tokenizer.pre_tokenize_str(led)]))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tk.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        if not self.cuts or not text or any(x in text for x in self.added):
            return self._whole(text)
        try:
            if "\n\n" in text or "  " in text or text[-1].isspace():
                return self._runs(text)
            words = ("\n" + text).replace("\n", " \n")[1:].split(" ")  # as if a line feed came before
            try:
                return b"".join(map(self.words.__getitem__, words))[4:]
            except Uncut:
                return self._runs(text)
        except Uncut:
            return self._whole(text)

    def _runs(self, text: str) -> bytes:
        """Ids of a text with runs of white space."""
        words, pieces, out = self.words, self.pieces, []
        for part in RUNS(text):
            if part[-1] in WHITE:
                out.append(pieces[part])
            elif part[0] == " ":
                out.append(words[part[1:]])
            else:
                out.append(words["\n" + part][4:])
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without the end id."""
        return list(map(self._text, texts))


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _encoders[name] = Encoder(name)
    return _encoders[name]


class Writer:
    """Fixed-size-list batches of one file; memory for BATCH sequences."""

    def __init__(self, uri: str, width: int, small: bool) -> None:
        fs, path = opened(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.width, self.held, self.count = width, bytearray(), 0
        self.documents, self.ending, self.before = 0, [], 0
        bits = pa.list_(pa.bool_(), width)
        self.schema = pa.schema([("ids", pa.list_(pa.uint16() if small else pa.uint32(), width)), ("mask", bits), ("ends", bits)])
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, self.schema)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """The ids of one document, which are at least one."""
        self.held += raw
        self.count += len(raw) // 4
        self.documents += 1
        self.ending.append((self.count - 1, doc_id))
        step = 4 * self.width * BATCH
        while len(self.held) >= step:
            self._write(bytes(self.held[:step]), self.width * BATCH)
            del self.held[:step]

    def _write(self, raw: bytes, real: int) -> None:
        ids = np.frombuffer(raw, "<u4")
        mask, ends = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        mask[:real] = True
        until = bisect.bisect_left(self.ending, self.before + real, key=lambda x: x[0])
        some, self.ending = self.ending[:until], self.ending[until:]
        ends[[at - self.before for at, _ in some]] = True
        self.before += real
        named = {"doc_ids": np.array([i or 0 for _, i in some], "<i8").tobytes(), "absent": bytes(i is None for _, i in some)}
        ids = ids.astype(self.schema.field("ids").type.value_type.to_pandas_dtype())
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask, ends)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema), custom_metadata=named)

    def close(self) -> None:
        if self.held:
            real = len(self.held) // 4
            self._write(bytes(self.held) + bytes(-len(self.held) % (4 * self.width)), real)
        self.file.close()
        self.out.close()


class Sequences:
    """Random access to a file's equal-length sequences; memory-mapped where the file is local."""

    def __init__(self, uri: str) -> None:
        fs, path = opened(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("ids").type.list_size

    def batch(self, k: int, column: str = "ids") -> np.ndarray:
        """Batch k as a two-dimensional view of the file."""
        values = self.file.get_batch(k).column(column).flatten()
        return values.to_numpy(zero_copy_only=column == "ids").reshape(-1, self.width)

    def sequence(self, i: int, column: str = "ids") -> np.ndarray:
        return self.batch(i // BATCH, column)[i % BATCH]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start in the file, number of ids and their crc32 of each document, from views of one batch after another."""
        before = start = crc = 0
        for k in range(self.file.num_record_batches):
            batch, named = self.file.get_batch_with_custom_metadata(k)
            ids = batch.column("ids").flatten().to_numpy()
            ends = np.flatnonzero(batch.column("ends").flatten().to_numpy(zero_copy_only=False)) + 1
            real = int(batch.column("mask").flatten().true_count)
            doc_ids, absent = np.frombuffer(named[b"doc_ids"], "<i8").tolist(), named[b"absent"]
            wide, at = ids.astype("<u4"), 0
            for end, doc_id, none in zip(ends.tolist(), doc_ids, absent, strict=True):
                yield None if none else doc_id, start, before + end - start, zlib.crc32(wide[at:end], crc)
                at, start, crc = end, before + end, 0
            crc = zlib.crc32(wide[at:real], crc)
            before += real

    def close(self) -> None:
        self.source.close()


def write(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, width: int = WIDTH, end: int = END, partitions: int | None = None) -> DataFrame:
    """Writes the files below folder; returns the index as a table in the shared folder."""
    spark = docs.sparkSession
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        uri = f"{folder}/part-{part:06d}-{context.taskAttemptId()}.arrow"
        enc, out = encoder(tokenizer), None
        for ids, raws in tb.blocks(batches, "doc_id", "text"):
            out = out or Writer(uri, width, enc.tk.get_vocab_size() <= 1 << 16)
            for i, raw in zip(ids, enc.encode([(r or b"").decode("utf-8", "replace") for r in raws]), strict=True):
                out.add(i, raw + tail)
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([part], pa.int32()), pa.array([out.documents]), pa.array([out.count])], names=[x.split()[0] for x in INDEX.split(", ")])

    n = partitions or max(shuffle_partitions(spark), planned_bytes(docs) // FILE_BYTES)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, INDEX), "token-index")


def planned_bytes(df: DataFrame) -> int:
    """The input's size as the plan has it; no job."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0  # unknown


def read(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the files that index names; a task reads whole files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(),) * 4
        for batch in batches:
            for file, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                data = Sequences(file)
                found = data.documents()
                while some := list(itertools.islice(found, 4096)):
                    i, at, n, crc = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((i, [before + x for x in at], n, crc), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                data.close()

    before = F.coalesce(F.sum("file_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = index.select("file", "part", before.alias("before"))  # a row a file
    return files.repartition(max(shuffle_partitions(index.sparkSession), 1), "part").select("file", "before").mapInArrow(run, SCHEMA)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(table(spark, sf_dir, "documents"), new_dir(spark, "token-files")))
