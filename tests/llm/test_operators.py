"""Each operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns, against brute force."""

import collections
import hashlib
import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import bpe_stream, dart_minhash, decontaminate, quality_bands, substring_dedup, suffix_tree_lm, token_files, toxicity_knn, url_rules, warc
from plumbline.llm.shared import new_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, h long, positions string"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("aeiou", k=1) + r.choices("lmnrst", k=r.randint(1, 3)) + r.choices("aeiou", k=1)) for _ in range(n))


SHARED = prose(99, 60)
TEXTS = [None, "", " \n\t ", "one", "a b c d", prose(1, 80), prose(1, 80), prose(1, 79) + " changed", f"{prose(2, 40)} {SHARED} {prose(3, 30)}", f"{prose(4, 90)}\n{SHARED}", "Le " * 3000, "Ünïcode ÉCOLE ΑΣ ΣΑΣ. it's <|endoftext|> x", prose(5, 20000), "\x1c a\x1cb   c\n\n\nd", prose(1, 80)]


def frame(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "k", 1, "p") for i, t in enumerate(texts)], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words(t, lower=False):
    return WORD.findall((t or "").encode().lower().decode() if lower else t or "")


def test_quality_counts(spark):
    got = rows(quality_bands.quality(frame(spark)))
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        at = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(at))
        assert got[i].base_failed == (len(w) < 50 or 100 * len(at) > 50 * len(w))
        lines = (t or "").split("\n")
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t or "")
        assert got[i].n_dup_lines == sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines))
    assert got[5].kept and got[12].kept and not got[10].kept and not got[0].kept
    assert quality_bands.quality(frame(spark, [])).count() == 0
    kept = quality_bands.kept_documents(frame(spark))
    assert kept.schema == frame(spark).schema and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


@pytest.mark.parametrize("n, ratio, why", [(3000, 9.0, "repetitive"), (3000, 1.1, "incompressible"), (3000, 2.1, None), (0, None, None), (90, 0.7, None)])
def test_quality_bands(n, ratio, why):
    assert quality_bands.verdict(n, ratio, 0.0) == why


@pytest.mark.parametrize("share", [0.3, 0.5])
def test_quality_finds_incompressible_stretches(share):
    import base64

    import zstandard

    packer, n = zstandard.ZstdCompressor(level=quality_bands.LEVEL), 40_000
    junk = base64.b64encode(random.Random(8).randbytes(n))[: int(n * share)]
    text = prose(9, 8000).encode()[: n - len(junk)]
    for raw, why in ((text + junk, "chunks"), (junk + text, "chunks"), (text, None)):
        assert quality_bands.verdict(len(raw), *quality_bands.compression(raw, packer)) == why
    for tail in (1, 1023, 1024):  # every byte is judged
        ratio, bad = quality_bands.compression(text[:4096] + junk[:tail], packer)
        assert bad == (0.0 if tail < 1024 else tail / (4096 + tail))


def test_bpe_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(bpe_stream.TOKENIZER))
    got = rows(bpe_stream.round_trip(frame(spark)))
    for i, t in enumerate(TEXTS):
        ids = tk.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = rows(bpe_stream.decode(bpe_stream.encode(frame(spark, ["héllo wörld", None]))))
    assert back[0].text == "héllo wörld " and back[1].text == ""


def test_bpe_streams_long_words():
    m = bpe_stream.encoder().merges
    r = random.Random(1)
    for alphabet, n in (("than", 6000), ("e", 5000), ("io", 4000), (["an", "nan", "tion", "ti", "on", "ing"], 1500), ("abcdefghijklmnopqrstuvwxyz", 5000)):
        raw = "".join(random.Random(n).choices(alphabet, k=n)).encode()
        run, early, at = bpe_stream.Transducer(m), [], 0
        run.room = m.room + r.randrange(64)
        while at < len(raw):
            step = r.randint(1, 300)
            early += run.push(raw[at : at + step])
            assert len(run.held) <= run.room
            at += step
        assert len(early) > 0.5 * n / 5
        assert early + run.finish() == m.merge([m.symbol[b] for b in raw[:-1]] + [m.final[raw[-1]]])


def test_lookahead_is_sufficient():
    """Whatever follows, a token that the lookahead calls stable stays; `mo` needs the longest one."""
    m, r = bpe_stream.encoder().merges, random.Random(2)
    tokens = [s for s in m.ids if not s.endswith("</w>")]
    for _ in range(300):
        symbols = [m.symbol[{c: b for b, c in bpe_stream.LETTER.items()}[x]] for x in "".join(r.choices(tokens, k=60))]
        whole = m.merge(symbols)
        for cut in r.choices(range(1, len(symbols)), k=5):
            used = 0
            for k, t in enumerate(m.merge(symbols[:cut])):
                used += m.width[t]
                if used + m.lookahead[t] > cut:
                    break
                assert whole[k] == t


def test_all_ids_come_from_the_transducer(monkeypatch):
    seen = []

    class Counted(bpe_stream.Transducer):
        def finish(self):
            out, n = super().finish(), sum(seen)
            seen.append(self.emitted - n)
            return out

    monkeypatch.setattr(bpe_stream, "Transducer", Counted)
    import public_tokenizers

    enc = bpe_stream.Encoder(public_tokenizers.path(bpe_stream.TOKENIZER))
    ids = enc.encode("all different words, once each " + "x" * 5000)
    assert sum(seen) == len(ids) and len(seen) == 7


def test_long_texts_go_segment_by_segment(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe_stream, "SEGMENT", 40)
    tk = Tokenizer.from_file(public_tokenizers.path(bpe_stream.TOKENIZER))
    for t in [x for x in TEXTS if x and len(x) < 2000] + ["a" * 300 + " b", "é" * 200 + "\u3000Ω " + "don't " * 50]:
        pieces = list(bpe_stream.encoder().packed(t))
        ids = np.frombuffer(b"".join(pieces), np.uint32).tolist()
        assert ids == tk.encode(t, add_special_tokens=False).ids
        assert bpe_stream.encoder().decode(ids) == tk.decode(ids, skip_special_tokens=False)


def test_decoder_takes_cut_bytes():
    d = bpe_stream.Decoder([bytes([b]) for b in range(256)])
    assert "".join(d.feed([b]) for b in "né日🙂".encode()) + d.finish() == "né日🙂"
    assert d.feed(b"\xe6") == "" and d.finish() == "�"
    d = bpe_stream.Decoder([b"a", None, b"b"], b" ")
    assert d.feed([0, 1]) + d.feed([]) + d.feed([2]) + d.finish() == "a b"


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    index = token_files.write(frame(spark), new_dir(spark, "t"), width=64, partitions=3)
    got, start = rows(token_files.read(index)), 0
    for i, t in enumerate(TEXTS):
        ids = np.asarray([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = index.orderBy("part").first()
    assert index.agg({"documents": "sum"}).first()[0] == len(TEXTS)
    data = token_files.Sequences(one.file)
    assert [d[:2] for d in data.documents()][:2] == [(0, 0), (1, 1)]
    assert data.sequence(0).base is not None and data.sequence(0, "mask").sum() == min(64, one.file_tokens)
    assert token_files.read(token_files.write(frame(spark, []), new_dir(spark, "t"))).count() == 0


@pytest.mark.parametrize("between", [" ", "\n\n", "  ", "\t \n"])
def test_token_files_ask_the_library_once_a_piece(between):
    asked, enc = [], token_files.Encoder(token_files.TOKENIZER)

    class Spy:
        def __init__(self, tk):
            self.tk = tk

        def __getattr__(self, name):
            return getattr(self.tk, name)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return self.tk.encode_batch_fast(texts, **more)

    model, enc.tk = enc.tk.model.tokenize, Spy(enc.tk)
    enc.tokenize = lambda letters: asked.append(letters) or model(letters)
    some = list(dict.fromkeys(prose(7, 2000).split()))
    texts = [between.join(w + sign for w in some) for sign in ("", ",", ".", ");", "'s")]
    enc.encode(texts)
    enc.encode(texts[::-1])
    assert sum(map(len, asked)) < 2.2 * sum(len(w) + 1 for w in some)


def test_token_files_keep_what_comes_again():
    made = []
    kept = token_files.Kept(lambda t: made.append(t) or t.encode(), 3 * (token_files.ENTRY + 2))
    for t in "abacadaeafagahaiajaka" + "x" * 2:
        assert kept[t] == t.encode() and len(kept) + len(kept.before) <= 6
    assert made.count("a") == made.count("x") == 1 and len(made) == 12
    assert kept["y" * 99] and "y" * 99 not in kept


@pytest.mark.parametrize("name", [token_files.TOKENIZER, bpe_stream.TOKENIZER])
def test_token_files_encode_odd_words_as_the_library(monkeypatch, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "WORDS", 9000, raising=False)
    monkeypatch.setattr(token_files, "PIECES", 3000, raising=False)
    monkeypatch.setattr(token_files, "SHORT", 60, raising=False)
    tk, enc, r = Tokenizer.from_file(public_tokenizers.path(name)), token_files.Encoder(name), random.Random(3)
    odd = [*"aBéßªº²½7٣'_-.,日яЯ\u0301🙂ĠĊĀŉǅƻɐİⅧ①", *"\0\x7f\xad\u200b\u180e\ufeff", "'s", "'re", "'LL", "<|", "<|endoftext|>", "y" * 70, *" \n \n \t\r\xa0\x85\x1c\x1f\u2028\u3000"]
    texts = [t or "" for t in TEXTS if len(t or "") < 9000] + ["".join(r.choices(odd, k=r.randint(1, 12))) for _ in range(3000)]
    texts += [t for c in map(chr, [*range(0x3000), 0x10D4A, 0x1C800, 0x1D7D8]) for t in (f"a{c}b {c}'s 1{c}.\n{c}z", f"a\n\n{c}b{c}\t{c} {c}{c}")] + [" " * 100 + "a" + "\t" * 99]
    for t, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, ascii(t)


def test_warc(spark):
    html = ["x" * 1500, "x" * 1500, "short", "short", None, "", "é" * 600, "é" * 600, "y" * 1000]
    pages = spark.createDataFrame([(i, f"http://a/{i} b" if i else None, h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, sha1 string")
    got = rows(warc.read(warc.write(pages, new_dir(spark, "w"))), "page_id")
    for i, h in enumerate(html):
        raw = (h or "").encode()
        same = [j for j, x in enumerate(html) if x == h] if len(raw) >= 1000 else [i]
        want = ("response", None) if max(same) == i else ("revisit", max(same))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == want
    assert got[0].url is None and got[1].url == "http://a/1%20b"
    assert warc.read(warc.write(pages.limit(0), new_dir(spark, "w"))).count() == 0


def test_warc_detects_damage():
    import io

    raw = b"payload" * 100
    one = warc.member(1, "u", raw, None, hashlib.sha1(raw).digest(), len(raw))
    assert [r.payload for r in warc.Reader(io.BytesIO(one + one), True)] == [raw, raw]
    other = warc.member(1, "u", raw, None, hashlib.sha1(b"else").digest(), len(raw))
    for bad in (one[:-9], other, one[:60] + b"\0\0" + one[62:]):
        with pytest.raises(warc.WarcError):
            list(warc.Reader(io.BytesIO(bad)))


def brute_substrings(texts, n=13):
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = []
    for i, t in enumerate(texts):
        w = words(t)
        gone = {k + j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(n)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup(spark):
    got = rows(substring_dedup.dedup_digests(frame(spark)))
    for i, want in enumerate(brute_substrings(TEXTS)):
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == want
    whole = rows(substring_dedup.dedup(frame(spark)))
    assert whole[6].text == "" and whole[5].text == TEXTS[5] and whole[0].text is None and SHARED not in whole[9].text
    assert substring_dedup.dedup_digests(frame(spark, [])).count() == 0


def test_substring_dedup_of_clashing_and_repeated_rows(spark, monkeypatch):
    """Rows of one doc_id take nothing from each other; hot windows go one row a flush."""
    monkeypatch.setattr(substring_dedup, "HELD", 64)
    data = [(1, prose(1, 40)), (1, f"{prose(2, 90)} {SHARED}"), (1, prose(1, 40)), (2, f"x {SHARED}"), (2, prose(1, 30)), (None, SHARED), (0, None)] + [(100 + i, f"{SHARED} {i}") for i in range(60)]
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.dedup_digests(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, 40): 0, (1, 150): 0, (2, 61): 60, (2, 30): 30, (None, 60): 0, (0, 0): 0} | {(100 + i, 61): 60 for i in range(60)}
    df = spark.createDataFrame([(*r, "a", "b") for r in data], "doc_id long, text string, late_row string, late_positions string")
    out = substring_dedup.dedup(df)
    assert out.schema == df.schema and out.count() == len(data) and out.where("text = '7'").count() == 1


def test_sketch_never_undercounts():
    h = np.arange(5000, dtype=np.uint64) * np.uint64(977)
    bits = 16
    rows_ = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(substring_dedup.ROWS)]
    for r, row in enumerate(rows_):
        c, n = np.unique(substring_dedup.cells(np.append(h, h[:50]), r, bits), return_counts=True)
        flat = np.zeros(1 << bits, np.uint8)
        flat[c.astype(np.int64)] = n >= 2
        row[:] = np.packbits(flat)
    assert substring_dedup.repeated(rows_, h[:50], bits).all()


def weighted_sets(texts):
    out = []
    for t in texts:
        w = words(t, True)
        out.append(collections.Counter(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else []))
    return out


def brute_classes(texts):
    """Least place of each text's class, by comparing all pairs."""
    sets, least = weighted_sets(texts), list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                both = sum((sets[i] & sets[j]).values())
                if both and both / (sum(sets[i].values()) + sum(sets[j].values()) - both) >= 0.8:
                    least[i] = least[j] = min(least[i], least[j])
    return least


def test_near_dedup(spark):
    got, least = rows(dart_minhash.classes(frame(spark))), brute_classes(TEXTS)
    assert [got[i].class_id for i in range(len(TEXTS))] == least
    assert {r.doc_id for r in dart_minhash.deduped(frame(spark)).collect()} == set(least)
    assert dart_minhash.classes(frame(spark, [])).count() == 0


def test_near_dedup_links_texts_that_fail_against_every_head(spark):
    base = prose(1000, 400).split()
    r, texts = random.Random(5), []
    for i in range(90):  # about 0.6 to the rest, with the smaller ids
        at = r.randrange(300)
        texts.append(" ".join(base[:at] + prose(2000 + i, 100).split() + base[at + 100 :]))
    for i in range(10):
        at = r.randrange(400)
        texts.append(" ".join([*base[:at], f"edit{i}", *base[at + 1 :]]))
    got = rows(dart_minhash.classes(frame(spark, texts)))
    assert [got[i].class_id for i in range(90)] == list(range(90))
    assert {got[i].class_id for i in range(90, 100)} == {90}


def test_signature_estimates_weighted_jaccard():
    r = np.random.default_rng(1)
    same, hits = 0.0, 0
    for _ in range(30):
        e = r.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = r.integers(0, 6, 60).astype(float), r.integers(0, 6, 60).astype(float)
        b[:40] = a[:40]
        sig = []
        for w in (a, b):
            use = np.flatnonzero(w)
            sig.append(dart_minhash.signatures(np.zeros(len(use), np.int64), e[use], w[use], 1)[0])
        hits += (sig[0] == sig[1]).sum()
        same += np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(hits / (30 * dart_minhash.K) - same / 30) < 0.03


def brute_scores(texts, held):
    """log10 probability of each text by a suffix tree in dictionaries: contexts of two words, one and none."""
    end = None  # a symbol that no word is
    runs = [[*words(t, True), end] for t in texts]
    one, two = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    root = collections.Counter()
    for i, run in enumerate(runs):
        if not held(i):
            root.update(run)
            for k, w in enumerate(run):
                before = [run[j] if j >= 0 else end for j in (k - 2, k - 1)]
                one[before[1]][w] += 1
                two[tuple(before)][w] += 1
    total = sum(root.values()) + len(root) + 1
    p0 = lambda w: (root[w] + 1) / total

    def retained(table, below):
        out = {}
        for context, nexts in table.items():
            n = sum(nexts.values())
            rest = max(1e-9, 1 - sum((c - 0.75) / n for c in nexts.values()))
            p = {w: (c - 0.75) / n + rest * below(context, w) for w, c in nexts.items()}
            if sum(c / n * math.log(p[w] / below(context, w)) for w, c in nexts.items()) >= 0.01:
                out[context] = (p, rest)
        return out

    def of(level, context, w, below):
        p, rest = level.get(context, ({}, 1.0))
        return p[w] if w in p else rest * below

    first = retained(one, lambda c, w: p0(w))
    p1 = lambda c, w: of(first, c, w, p0(w))
    second = retained(two, lambda c, w: p1(c[1], w))
    out = []
    for run in runs:
        symbols = [w if w in root else "\x00unseen" for w in run]
        before = [(symbols[k - 2] if k > 1 else end, symbols[k - 1] if k else end) for k in range(len(run))]
        out.append(sum(math.log10(of(second, c, w, p1(c[1], w))) for c, w in zip(before, symbols, strict=True)))
    return out


def test_language_model(spark):
    r = random.Random(7)
    chain = ["a b c d a b c d a b e", "the cat sat on the mat the cat sat"]
    texts = TEXTS + [prose(k, 50) for k in range(20)] + chain * 3 + [" ".join(r.choices("abc", k=30)) for _ in range(10)]
    got = rows(suffix_tree_lm.scored(frame(spark, texts)))
    c, ends = collections.Counter(), 0
    for i, t in enumerate(texts):
        if not suffix_tree_lm.held_out(i):
            c.update(words(t, True))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    want = brute_scores(texts, suffix_tree_lm.held_out)
    for i, t in enumerate(texts):
        w = words(t, True)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score < 0
        assert got[i].score == pytest.approx(want[i], rel=1e-6), i
    assert got[5].score > got[5].base_score
    assert suffix_tree_lm.scored(frame(spark, [])).count() == 0


def test_language_model_keeps_what_is_rare_in_a_large_corpus(spark):
    """Words, pairs and triples seen once count in a million tokens as in a hundred."""
    r = random.Random(3)
    passages = [" ".join(f"p{k}x{j}" for j in range(60)) for k in range(20)]
    texts = passages + [" ".join(r.choices("abcdefgh", k=4000)) for _ in range(466)]
    texts += passages
    out = [i for i in range(len(texts)) if suffix_tree_lm.held_out(i)]
    assert any(i >= 486 for i in out) and sum(len(t.split()) for i, t in enumerate(texts) if i not in out) > 1.2 * 2**20
    got, want = rows(suffix_tree_lm.scored(frame(spark, texts))), brute_scores(texts, suffix_tree_lm.held_out)
    for i in range(len(texts)):
        assert got[i].score == pytest.approx(want[i], rel=1e-6), i
    assert all(got[i].score > got[i].base_score / 2 for i in out if i >= 486)  # its other copy is in training


def test_language_model_does_not_depend_on_pieces(spark):
    """Sums of many pieces equal those of one."""
    texts = [t for t in TEXTS if len(t or "") < 2000] + ["the cat sat on the mat", "the cat sat", "on the mat the cat"] * 4
    want = brute_scores(texts, suffix_tree_lm.held_out)
    for docs, least, most in ((frame(spark, texts).coalesce(1), 1, 1), (frame(spark, texts).repartition(9), 4, 9)):
        assert least <= suffix_tree_lm.pieces(docs).count() <= most
        got = rows(suffix_tree_lm.scored(docs))
        assert [got[i].score for i in range(len(texts))] == pytest.approx(want, rel=1e-6)


def brute_hits(text, items, n=10):
    take = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    w, at, names = take(text), set(), set()
    for name, t in items:
        b = take(t)
        m = min(n, len(b))
        for k in range(len(b) - m + 1) if m else ():
            for p in range(len(w) - m + 1):
                if w[p : p + m] == b[k : k + m]:
                    at |= set(range(p, p + m))
                    names.add(str(name))
    return len(w), len(at), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(at)


def test_decontamination(spark):
    w = words(SHARED)
    items = [(1, " ".join(w[5:25])), (2, prose(77, 30)), (3, " ".join(w[0:3])), (4, " ".join(w[30:36])), (5, None), (6, ""), (7, w[50]), (10, " ".join(w[40:42])), (11, " ".join(w[5:25]).upper())]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    got = rows(decontaminate.judged(frame(spark), bench))
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(t, items), i
    clean = {r.doc_id for r in decontaminate.clean(frame(spark), bench).collect()}
    assert clean == {i for i, r in got.items() if not r.contaminated}
    assert decontaminate.judged(frame(spark), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.judged(frame(spark, []), bench).count() == 0


def brute_toxicity(texts, toxic):
    """Scores by full cosine over dictionaries; toxic: label by place."""
    take = lambda t: collections.Counter(re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()))
    bags = [take(t) for t in texts]
    train = [i for i in sorted(toxic) if zlib.crc32(str(i).encode()) % 5]
    n, bad = len(train), sum(toxic[i] for i in train)
    prior = (bad + 1) / (n + 2)
    df, own, own_bad = collections.Counter(), collections.Counter(), collections.Counter()
    for b in bags:
        df.update(b.keys())
    for i in train:
        own.update(bags[i].keys())
        own_bad.update(bags[i].keys() if toxic[i] else ())

    def weight(w):
        if not own[w]:
            return math.log(2 + len(texts)) * 0.1
        p, k = bad / n, own[w]
        z = abs(own_bad[w] - k * p) / math.sqrt(k * p * (1 - p) * (n - k) / (n - 1)) if k < n else 0
        x = max(0, z - 4.5)
        return math.log((2 + len(texts)) / (1 + df[w])) * (0.1 + 0.9 * x / (x + 3))

    vectors = []
    for b in bags:
        v = {w: (1 + math.log(c)) * weight(w) for w, c in b.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / size for w, x in v.items()} if size else {})

    def vote(i, leave=False):
        sims = [(sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()), j) for j in train if not (leave and i == j)]
        top = sorted(((s, j) for s, j in sims if s > 0), key=lambda x: (-round(x[0], 6), x[1]))[:10]
        w = sum(s * s for s, _ in top)
        return (sum(s * s * toxic[j] for s, j in top) + 0.015 * prior) / (w + 0.015) if top else None

    pools = []
    for x, y in sorted((vote(i, True), toxic[i]) for i in train):
        pools.append([x, y, 1])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] / pools[-2][2] >= pools[-1][0] / pools[-1][2]):
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    xs, ys = [p[0] / p[2] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]
    ys = [max(ys[: k + 1]) for k in range(len(ys))]
    return [prior if (v := vote(i)) is None else float(np.interp(v, xs, ys)) for i in range(len(texts))]


def test_toxicity(spark):
    bad = ["idiot", "moron", "scum", "loser", "trash"]
    texts = [prose(3 if i == 395 else i, 30) + (f" {bad[i % 5]}, {bad[(i + 1) % 5]}! " if i % 4 == 0 else "") for i in range(400)] + [None, "", "Ünseen wörds ünseen"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "t") for i in range(400)] + [(3, 0, None, "t"), (None, 1, 1, "t"), (0, 1, 0, "t")], "doc_id long, quality int, toxic int, text string")
    got = rows(toxicity_knn.scored(docs, labels))
    held = [r for i, r in got.items() if i < 400 and r.held_out]
    assert len(held) > 40 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert got[400].predicted == got[401].predicted == 0 and got[400].score == got[401].score
    for i, want in enumerate(brute_toxicity(texts, {i: int(i % 4 == 0) for i in range(400)})):
        assert got[i].score == pytest.approx(want, abs=1e-4), i
        assert len(got[i].neighbours) == len(got[i].similarities) == (0 if i >= 400 else 10)
    assert toxicity_knn.scored(docs, labels.limit(0)).select("score").distinct().count() == 1
    assert toxicity_knn.scored(docs, labels.where("toxic = 0")).select("score").distinct().count() == 1
    assert toxicity_knn.scored(frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("common, block", [(0, 64), (8, 16), (512, 512)])
def test_block_max_search_is_exact(monkeypatch, common, block):
    monkeypatch.setattr(toxicity_knn, "COMMON", common)
    monkeypatch.setattr(toxicity_knn, "BLOCK_IDS", block)
    r = np.random.default_rng(3)
    n, terms = 900, 40
    tf = (r.random((n, terms)) < 0.1) * r.integers(1, 4, (n, terms))
    row, term = np.nonzero(tf)
    index = toxicity_knn.build(np.arange(terms, dtype=np.uint64), (tf > 0).sum(0), n, np.arange(n), r.integers(0, 2, n), (row, term, tf[row, term]))
    place = np.empty(n, np.int64)
    place[index.ids] = np.arange(n)
    t, q, cuts = index.vectors(term.astype(np.uint64), row, tf[row, term], n)
    dense = np.zeros((n, terms))
    dense[place[row], t] = q
    for i, (got, _) in enumerate(index.searches(t, q, cuts)):
        sims = dense @ dense[place[i]]
        want = np.lexsort((index.ids, -np.round(sims, 6)))[:10]
        assert index.ids[got].tolist() == [x for x, y in zip(index.ids[want].tolist(), want.tolist(), strict=True) if sims[y] > 0]


def test_url_rules(spark):
    urls = [("http://a.net/x", "net/", "block"), ("http://www.Example.NET/en/1?q", "example.net/en/", "allow"), ("https://m.example.com/de/2#t", "example.com/de/", "block"), ("http://x.org/fr/", "org/fr/", "allow"), ("http://x.net", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("http://notnet/x", None, "allow")]
    pages = [(i, u, "h") for i, (u, _, _) in enumerate(urls)] + [(100 + i, f"http://{'junk' if i % 2 else 'fine'}.example.com/en/{i}", "h") for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = rows(url_rules.judged(df, labels), "page_id")
    for i, (_, rule, verdict) in enumerate(urls):
        assert (got[i].rule, got[i].verdict) == (rule, verdict)
    assert all(got[100 + i].verdict == ("block" if i % 2 else "allow") for i in range(200))
    assert got[1].host == "www.example.net" and got[1].path == "/en/1" and got[6].host == "" == got[6].path
    assert url_rules.judged(df, labels.limit(0)).where("verdict = 'block'").count() == 2
    assert url_rules.judged(df.limit(0), labels).count() == 0


def test_url_rules_see_deep_segments(spark):
    df = spark.createDataFrame([(i, f"http://a.example.com/en/2024/{'casino' if i % 2 else 'news'}/{i}", "h") for i in range(200)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = rows(url_rules.judged(df, labels), "page_id")
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(200))


def brute_rules(urls, labels, support, confidence):
    """Verdicts by counting every item set; urls: by page_id; labels: page_id to bad."""
    def parts(url):
        scheme, rest = url.split("://", 1) if "://" in url else ("", "")
        host = re.match("[^/?#]*", rest).group().lower()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        query = re.search(r"\?([^#]*)", rest)
        return scheme, host, path, query.group(1) if query else ""

    def fixed(host, path):
        fits = [(len(h + p), v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    def items(scheme, host, path, query):
        names = [x for x in host.split(".") if x]
        out = {f"scheme={scheme.lower()}"} | {f"host={x}" for x in names} | {f"word={w}" for x in names if "-" in x for w in x.split("-") if w} | {f"path={re.sub('[0-9]+', '0', x)}" for x in path.split("/") if x}
        if len(names) > 1:
            out.add("domain=" + ".".join(names[-2:]))
        if m := re.search(r"\.([A-Za-z0-9]{1,5})$", path):
            out.add("ext=" + m.group(1))
        return frozenset(out | {"query=" + x.split("=")[0] for x in query.split("&") if x})

    known, baskets = {}, []
    for i, u in urls.items():
        p = parts(u)
        known[i] = (fixed(*p[1:3]), items(*p) if p[1] else frozenset())
        label = "block" if set(re.split("[.-]", p[1])) & set(url_rules.SEEDS) else known[i][0] or ({True: "block", False: "allow"}.get(labels.get(i)))
        if label and p[1]:
            baskets.append((known[i][1], label == "block"))
    counts, blocked = collections.Counter(), collections.Counter()
    for have, bad in baskets:
        for n in range(1, len(have) + 1):
            for some in itertools.combinations(sorted(have), n):
                counts[some] += 1
                blocked[some] += bad
    least = max(support * len(baskets), url_rules.LEAST_PAGES)
    base = sum(b for _, b in baskets) / max(len(baskets), 1)
    rules = [set(k) for k, n in blocked.items() if n >= least and n / counts[k] >= confidence and n / counts[k] > base]
    return {i: v or ("block" if any(r <= have for r in rules) else "allow") for i, (v, have) in known.items()}, rules


def test_url_rules_are_mined_as_by_counting(spark):
    r = random.Random(4)
    urls = {i: f"http{r.choice(['', 's'])}://{r.choice(['www.', 'm.', ''])}{r.choice(['fine', 'casino-win', 'big-win', 'other'])}.example.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'de', 'fr'])}/{r.randrange(99)}{r.choice(['', '.html', '?page=2&ref=x'])}" for i in range(400)}
    labels = {i: r.random() < 0.2 for i in range(0, 400, 3)}
    df = spark.createDataFrame([*urls.items(), (None, urls[5]), (None, None)], "page_id long, url string")
    table = spark.createDataFrame([(i, int(not b), 0) for i, b in labels.items()], "doc_id long, quality int, toxic int")
    want, rules = brute_rules(urls, labels, url_rules.SUPPORT, url_rules.CONFIDENCE)
    out = url_rules.judged(df, table).collect()
    got = {x.page_id: x.verdict for x in out if x.page_id is not None}
    assert got == want and rules
    assert sorted(x.verdict for x in out if x.page_id is None) == sorted(["allow", want[5]])
    assert {"path=de"} in rules and any(want[i] == "block" and "casino" in u and "example.org/en" in u for i, u in urls.items())


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_url_rules_change_verdicts_on_the_tables(spark, sf):
    at = f"/root/testdata/{sf}"
    if not os.path.exists(at):
        pytest.skip("no driver tables")
    out = url_rules.op9_url_rules(spark, at)
    assert out.where("rule IS NULL AND verdict = 'block'").count() > 0 and out.where("rule IS NULL AND verdict = 'allow'").count() > 0


def brute_pipeline(data, items):
    """What the five stages leave of (doc_id, text) rows, with the digests of ids and decoded text."""
    import public_tokenizers
    import zstandard
    from tokenizers import Tokenizer

    def good(t):
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {p for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        raw = (t or "").encode()
        return len(w) >= 50 and 2 * len(again) <= len(w) and quality_bands.verdict(len(raw), *quality_bands.compression(raw, zstandard.ZstdCompressor(level=quality_bands.LEVEL))) is None

    data = [r for r in data if good(r[1])]
    order = sorted(range(len(data)), key=lambda k: (data[k][0] is None, data[k][0] or 0))
    known = [k for k in order if data[k][0] is not None]
    least = brute_classes([data[k][1] for k in known])
    data = [data[known[k]] for k in range(len(known)) if data[known[least[k]]][0] == data[known[k]][0]] + [data[k] for k in order if data[k][0] is None]
    first = {}
    for i, t in data:
        w = words(t)
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = []
    tk = Tokenizer.from_file(public_tokenizers.path(bpe_stream.TOKENIZER))
    for i, t in data:
        w = words(t)
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        t = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
        if not brute_hits(t, items)[-1]:
            ids = tk.encode(t, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return out


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "BPE encoding and decoding"]
    data = [*enumerate(TEXTS), (7, TEXTS[7]), (None, prose(31, 70)), (None, None), (20, f"{prose(32, 60)} {SHARED}"), (21, f"{prose(33, 70)} {' '.join(words(prose(2, 40))[3:20])}"), (22, prose(34, 60).upper())]
    items = [(1, " ".join(words(prose(2, 40))[3:20])), (2, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, gone_id string, late_row string, late_positions string, row_key string, Row_Key_ string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in data], names)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute_pipeline(data, items), key=str) and len(got) >= 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, TEXTS[5]), (3, TEXTS[5]), (None, None), (4, TEXTS[5])], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, " ".join(words(TEXTS[5])[:12])), (None, None)], "item_id long, text string")
    for df in (
        quality_bands.quality(docs), bpe_stream.round_trip(docs), token_files.read(token_files.write(docs, new_dir(spark, "t"))), substring_dedup.dedup_digests(docs), substring_dedup.dedup(docs),
        dart_minhash.classes(docs), suffix_tree_lm.scored(docs), toxicity_knn.scored(docs, labels), decontaminate.judged(docs, bench),
    ):
        assert df.count() == 4 and df.where("doc_id IS NULL").count() == 2
    assert sorted((r.doc_id or -1) for r in dart_minhash.deduped(docs).collect()) == [-1, -1, 3]
    pages = spark.createDataFrame([(None, "http://a.net/", "x" * 2000), (1, None, "x" * 2000), (None, None, None)], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, new_dir(spark, "w"))).where("page_id IS NULL").count() == 2
    assert url_rules.judged(pages, labels).count() == 3


def test_pipeline_stages_bound_arrow_batches(spark, tmp_path):
    import corpus_pipeline

    from plumbline.llm.shared import BATCH

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    schema = "doc_id long, text string, n_chars long"
    spark.createDataFrame([(i, "a few words", 11) for i in range(4)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("x", "other words")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.conf.get(key)
    try:
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            for held, most in (("10000", BATCH), ("0", BATCH), ("7", 7))[: 1 if k else 3]:  # 0: no limit
                spark.conf.set(key, held)
                stage(spark, docs, str(tmp_path))
                got = [r.n for r in spark.range(0, 3000, 1, 1).mapInArrow(sizes, "n long").collect()]
                assert sum(got) == 3000 and max(got) == most
    finally:
        spark.conf.set(key, before)
