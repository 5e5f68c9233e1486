"""Encoding and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cliploom.llm import bpe, packing
from cliploom.llm import queries as Q

HARD = ["", "  a\x1c\x1d b  c  ", "日本語テキスト" * 50, "a" * 3000, "don't I'LL 12345678 \n\n\n x", "é ́a", "<|endoftext|> hi <|startoftext|>x", " \x85\x1f x", "😀👍🏽 नमस्ते", "x²³ ¼½ªº µ_a__b", " ab" * 9, "ΣΑΣ ΟΔΟΣ Σ", "İstanbul ÀÉ'S DON'T ''s", "a\xa0b\x85c d", "﻿x​y"]
DOCS = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(P.path(Q.BPE_FILE), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    return packing.Words(P.path(Q.WORD_FILE)), Tokenizer.from_file(P.path(Q.WORD_FILE))


def ids(data):
    return list(memoryview(data).cast("I"))


@pytest.mark.parametrize("text", HARD)
def test_same_ids_as_the_libraries(codec, library, words, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()
    assert ids(words[0].encode(text)) == words[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(blacklist_categories=["Cs", "Cn"], max_codepoint=0x2FF), max_size=60))
def test_any_text(codec, library, words, text):
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert ids(words[0].encode(text)) == words[1].encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(piece=st.binary(min_size=2, max_size=200))
def test_one_tree_and_many_agree(codec, piece):
    want = bpe.merge(piece, codec.ranks)
    assert b"".join(codec.tokens[i] for i in want) == piece
    if len(piece) <= 64 and piece not in codec.ranks:
        width = next(w for w in bpe.WIDTHS if len(piece) <= w)
        assert ids(codec.merger.encode([piece], width)[0]) == want


def test_bpe_rows(spark, library):
    rows = [(k, t, "x") for k, t in enumerate([*HARD, None])] + [(0, "same", "x"), (None, "same", "x")]
    got = bpe.bpe(spark.createDataFrame(rows, DOCS), P.path(Q.BPE_FILE), P.PATTERN).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, ids(r.ids)) for r in got) == sorted((-1 if k is None else k, library.encode_ordinary(t or "")) for k, t, _ in rows)
    assert bpe.bpe(spark.createDataFrame([], DOCS), P.path(Q.BPE_FILE), P.PATTERN).count() == 0


def test_bpe_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in Q.op3_bpe(spark, sf_dir).collect():
        want = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert r.n_tokens == len(want) and r.ids_sha256 == __import__("hashlib").sha256(want.tobytes()).hexdigest()


def check_packing(rows, want, size):
    """Every id once, offsets without gaps, lengths full or powers of two."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) == len(want[d]) == own[0].doc_tokens
        for r in own:
            part = np.array(want[d][r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        total = sum(r.length for r in own)
        assert total == size or total < size and total & total - 1 == 0


def test_packing_query(spark, sf_dir, words):
    want = {r.doc_id: words[1].encode(r.text, add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(Q.op6_packing(spark, sf_dir).collect(), want, 2048)


def test_packing_edges(spark, words):
    rng = random.Random(2)
    texts = {k: " ".join("word" for _ in range(rng.randrange(0, 40))) for k in range(60)} | {90: "", 91: None, 92: "long " * 500}
    want = {k: words[1].encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], DOCS)
    check_packing(packing.pack(df.repartition(3), P.path(Q.WORD_FILE), 32, 2).collect(), want, 32)
    assert packing.pack(spark.createDataFrame([], DOCS), P.path(Q.WORD_FILE)).count() == 0


def test_packer_keeps_whole_what_fits():
    packer = packing.Packer(8, 2, 0)
    one = lambda n: b"\0\0\0\0" * n
    out = packer.add("a", one(5)) + packer.add("b", one(6)) + packer.add("c", one(2)) + packer.add("d", one(3))
    assert [(q, o, k) for q, o, k, _, _ in out] == [(0, 0, "b"), (0, 6, "c"), (1, 0, "a"), (1, 5, "d")]
    assert packer.finish() == []
