"""Token counts, packing and token files, held against the tokenizer library itself."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import packing, rans, token_counts, token_files
from weftline.llm.common import new_path
from weftline.llm.tokens import PieceCodec

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a  b", "<|endoftext|> x<|endoftext|>y", "<|startoftext|>  hi", "a b", "é é x", "Σ ΑΣ Σ", "tab\tx\r\n\r\ny  ", "don't 's \n\n 's", "İstanbul İ", "ﬁ ﬂ", "1234 12a",
       "-- --- a-b", "x\n y \n  z", "e ́x", "a\x1cb", "\n\n\n", "a \n", "word. word, word", "日本語 🙂🙂", "Word, .x ..", "a b"]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,drops", [(WORDS, True), (BYTES, False)])
def test_codec_gives_what_the_library_gives(path, drops):
    import pyarrow as pa

    codec, library = PieceCodec(path, drops), Tokenizer.from_file(path)
    texts = ODD + ["".join(random.Random(i).choice("ab.,'\n \té<|1") for _ in range(60)) for i in range(300)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert codec.lengths_of(pa.array(texts)).tolist() == list(map(len, want))
    got = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in codec.ids_of(pa.array(texts)) for i in range(len(bounds) - 1)]
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_codec_on_any_text(texts):
    import pyarrow as pa

    texts = [t.encode(errors="replace").decode() for t in texts]
    for path, drops in ((WORDS, True), (BYTES, False)):
        assert PieceCodec.of(path, drops).lengths_of(pa.array(texts, pa.string())).tolist() == [len(ids_of(path, t)) for t in texts]


def test_new_words_reach_the_library_many_at_once():
    import pyarrow as pa

    class Counting:
        def __init__(self, of):
            self.of, self.model, self.calls = of, self, 0

        def encode_batch_fast(self, texts, **how):
            self.calls += len(texts)
            return self.of.encode_batch_fast(texts, **how)

        def tokenize(self, text):
            self.calls += 1
            return self.of.model.tokenize(text)

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshré") for _ in range(rng.randint(3, 12)))
    texts = ["".join(word() + rng.choice(["", "", ",", "."]) + rng.choice("   \n") for _ in range(500))[:-1] for _ in range(20)]
    want = [[*e.ids, 0] for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False)]
    codec = PieceCodec(BYTES, False)
    counted = [Counting(codec.tokenizer)]
    codec.tokenizer = counted[0]
    if getattr(codec, "bare", None):
        codec.bare = Counting(codec.bare)
        counted.append(codec.bare)
    got = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in codec.ids_of(pa.array(texts), 0) for i in range(len(bounds) - 1)]
    assert got == want
    assert sum(c.calls for c in counted) < 1000  # nearly all of 10,000 words are new


def test_tokens_that_would_lie_across_words(tmp_path):
    import pyarrow as pa
    from tokenizers import models, pre_tokenizers

    signs = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("a", "\u0120"), ("b", ","), ("\u010a", "c"), ("a", "b")]
    vocab = {t: i for i, t in enumerate([*signs, *(x + y for x, y in merges)])}
    tokenizer = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.save(path := str(tmp_path / "across.json"))
    codec = PieceCodec(path, False)
    for text in ("x ab a b", "x a b, ab, c", "x ab\nc a\ncb", "x ab cab"):
        assert next(codec.ids_of(pa.array([text])))[1].tolist() == ids_of(path, text)


def test_ids_take_little_room_besides_themselves():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(6)
    known = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(2000)]
    texts = pa.array([" ".join(rng.choices(known, k=300)) for _ in range(2000)])
    codec = PieceCodec(BYTES, False)
    list(codec.ids_of(texts, 0))
    tracemalloc.start()
    n = sum(len(ids) for _, ids, _ in codec.ids_of(texts, 0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * n


def test_full_memory_changes_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr("weftline.llm.tokens.MEMO_BYTES", 5000)
    monkeypatch.setattr("weftline.llm.tokens.by_bytes", lambda texts: ((i, texts.slice(i, 7)) for i in range(0, len(texts), 7)))
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice(["ab", "cd,", "\nef", f"w{rng.randint(0, 400)}", "".join(rng.choice("xyz") for _ in range(5))]) for _ in range(40)) for _ in range(60)]
    for path, drops in ((WORDS, True), (BYTES, False)):
        codec = PieceCodec(path, drops)
        want = [[*e.ids, 7] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        for _ in range(2):
            got = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in codec.ids_of(pa.array(texts), 7) for i in range(len(bounds) - 1)]
            assert got == want
            assert codec.most and len(codec.code) < 400


def test_token_counts(odd_docs, odd_rows, no_docs):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd_docs, WORDS).collect())
    want = sorted((i is None, i or 0, len((t or "").encode()), n := len(ids_of(WORDS, t)), n > 2048) for i, t, _ in odd_rows)
    assert got == want
    assert token_counts.token_counts(no_docs, WORDS).count() == 0


def test_packing_places_each_id_once(odd_docs, odd_rows, no_docs):
    rows = packing.pack(odd_docs, BYTES, with_ids=True).collect()
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        docs[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, t, _ in odd_rows:
        want[i] += [ids_of(BYTES, t) + [0]]
    for i, own in want.items():
        assert sorted(x for ids in own for x in ids) == sorted(x for r in docs[i] for x in r.ids)
        if len(own) == 1:
            assert [x for r in sorted(docs[i], key=lambda r: r.start) for x in r.ids] == own[0]
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(no_docs, BYTES).count() == 0


def test_differencing_is_near_equal_and_raises_the_count():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randint(1, 200) for _ in range(rng.randint(1, 120))]
        windows = packing.partition(sizes, 1024)
        sums = [sum(sizes[i] for i in own) for own in windows]
        assert sorted(i for own in windows for i in own) == list(range(len(sizes))) and max(sums) <= 1024
        if len(sizes) > 8 * len(windows):
            assert max(sums) - min(sums) <= 60
    assert len(packing.partition([600, 600, 600], 1024)) == 3  # two could hold the sum
    packer = packing.Packer(1024)
    pieces = [p for i in range(3000) for p in packer.add(i, rng.randint(1, 2500))] + packer.end()
    used = defaultdict(int)
    for _, _, length, window, _ in pieces:
        used[window] += length
    assert sum(1024 - n for n in used.values()) < 4 * 1024


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=3000))
def test_coding_round_trip(ids):
    table = rans.Table(rans.normalize(np.bincount(ids, minlength=6000)))
    assert table.decode(table.encode(np.array(ids))).tolist() == ids


def test_a_block_is_coded_in_few_steps():
    assert rans.BLOCK // rans.LANES <= 128  # each step costs some calls, however many lanes it has
    ids = np.random.default_rng(2).integers(0, 50_000, rans.BLOCK)
    block = rans.Table(rans.normalize(np.bincount(ids, minlength=1 << 16))).encode(ids)
    assert len(block) < 2.15 * rans.BLOCK  # 15.6 bits of an id, and the states that are noted


def test_coding_parts_checksums_and_bounds():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.4, rans.BLOCK) % 50_000
    table = rans.Table(rans.normalize(np.bincount(ids, minlength=1 << 16)))
    block = table.encode(ids)
    step = rans.STEPS * rans.LANES
    assert (table.decode_part(block, 1) == ids[step : 2 * step]).all()
    assert len(table.encode(ids[:0])) and table.decode(table.encode(ids[:0])).size == 0
    broken = bytearray(block)
    broken[16] ^= 1
    with pytest.raises(ValueError):
        table.decode(bytes(broken))
    with pytest.raises(ValueError):
        table.encode(np.array([65_000]))
    for counts in ([1], [5, 0, 0], [1] * 70_000, [10**15, 1, 1], [0, 0]):
        freq = rans.normalize(np.array(counts))
        assert freq.sum() == (1 << rans.SCALE if sum(counts) else 0) and ((freq > 0) == (np.array(counts) > 0)).all()
    assert rans.crc32_combine(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_token_files_round_trip(spark, odd_docs, odd_rows, no_docs, monkeypatch):
    path = new_path(spark, "token-files")
    token_files.write_token_files(odd_docs, BYTES, path)
    pieces = token_files.read_token_files(spark, path)
    got = token_files.document_digests(pieces).collect()
    want = sorted((i is None, i or 0, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())) for i, t, _ in odd_rows for ids in [ids_of(BYTES, t)])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    path = new_path(spark, "token-files")
    token_files.write_token_files(no_docs, BYTES, path)
    assert token_files.read_token_files(spark, path).count() == 0


def test_documents_longer_than_a_block(spark):
    text = "ab " * rans.BLOCK
    docs = spark.createDataFrame([(1, "x"), (2, text), (3, "y z")], "doc_id long, text string")
    path = new_path(spark, "token-files")
    token_files.write_token_files(docs, BYTES, path)
    got = {r.doc_id: r for r in token_files.document_digests(token_files.read_token_files(spark, path)).collect()}
    ids = np.array(ids_of(BYTES, text) + [0], "<u4")
    assert (got[2].start, got[2].n_tokens, got[2].ids_crc32) == (2, len(ids), zlib.crc32(ids.tobytes()))
    assert got[3].start == 2 + len(ids)
