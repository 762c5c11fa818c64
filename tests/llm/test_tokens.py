import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mosaiq.llm import byte_bpe, catalog, token_files
from tests.oracle import SF

MULTI, WORD = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
BPE = byte_bpe.codec(MULTI, P.PATTERN)
PLAIN = Tokenizer.from_file(WORD)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(MULTI), special_tokens={})
ODD = ["", " ", "  a", "a  b", " a", "a ", "a\n b", "a \nb", "\n\n x", "it's we'll 'S", " 's", "x" * 700, "ab" * 3000, "\x1c a\x1db", "²½ 12 ٣", "a\xa0b \u2003 c", "ﬁ ǅ", "\U0001f600\U0001f600  😀", "<|endoftext|> x", "a <|endoftext|> b<|startoftext|>c <|EndOfText|>", "<|endoftext", "\x1ca\x1f b", "e\u0301 \u0301x K\u212aelvin", "ΑΣ Σ", "İstanbul e\u0301 é", "a...b, c!! d."]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_bpe_as_tiktoken(texts):
    for t, ids in zip(texts, BPE.encode_batch(texts), strict=True):
        assert ids.tolist() == TIK.encode_ordinary(t)
        assert BPE.decode(ids.tolist()) == t.encode()


def test_bpe_odd_texts():
    for t, ids in zip(ODD, BPE.encode_batch(ODD), strict=True):
        assert ids.tolist() == TIK.encode_ordinary(t), t


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_words_as_library(t):
    own = token_files._encoder(WORD)
    assert np.frombuffer(own.encode(t), own.wide).tolist() == PLAIN.encode(t, add_special_tokens=False).ids


def test_words_odd_texts():
    own = token_files._encoder(WORD)
    for t in ODD:
        assert np.frombuffer(own.encode(t), own.wide).tolist() == PLAIN.encode(t, add_special_tokens=False).ids, t


def _docs(spark, d):
    return sorted(((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("which", ["sf", "odd", "none"])
def test_op2_against_library(spark, which, odd_docs, no_docs, as_table):
    d = SF if which == "sf" else as_table(odd_docs if which == "odd" else no_docs)
    t = Tokenizer.from_file(WORD)
    want, start = [], 0
    for doc, text in _docs(spark, d):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in catalog.queries()["op2_token_files"](spark, d).collect()), key=lambda r: r[1])
    assert got == want


def test_shard_access(spark):
    docs = spark.createDataFrame([(i, f"some words number {i} " * (i % 5)) for i in range(300)], "doc_id long, text string")
    shards, held = token_files.write_tokens(docs, WORD)
    dictionary = bytes(held.first()["dictionary"])
    row = shards.first()
    own = token_files._encoder(WORD)
    for i in (0, 1, len(row["docs"]) - 1):
        text = f"some words number {row['docs'][i]} " * (row["docs"][i] % 5)
        assert token_files.read_document(bytes(row["blob"]), i, dictionary).tolist() == [*own.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    with pytest.raises(ValueError):
        token_files.read_document(bytes(row["blob"]), 0, dictionary + b"x")


@pytest.mark.parametrize("which", ["sf", "odd", "none"])
def test_op6_against_tiktoken(spark, which, odd_docs, no_docs, as_table):
    d = SF if which == "sf" else as_table(odd_docs if which == "odd" else no_docs)
    want = []
    for doc, text in _docs(spark, d):
        ids = TIK.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = [tuple(r) for r in catalog.queries()["op6_byte_bpe"](spark, d).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
