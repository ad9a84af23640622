"""Tokenising against the libraries, on hard texts and on the smallest documents."""

import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from revlake.llm import queries, sentencepiece_codec, token_counts

HARD = ["", " ", "a", "  a  b\t\n\n c ", "▁x ▁▁ y", "日本語 テスト 😀é́ ", "<s> <0x41> </s>", "a" * 200, " " * 80, "\x00\x01", "<|endoftext|> a<|endoftext|>b <|endof", "'s 'll don't we'll'x !'s \x1c \x85 z", "x" * 5000, "!?" * 300]
random.seed(5)
HARD += ["".join(random.choice("ab '\n\tlsterv.1é 日▁-_=") for _ in range(random.randint(1, 50))) for _ in range(300)]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(HARD)] + [(9999, None, "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_encode_equals_library_and_decodes(frame):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    coded = sentencepiece_codec.decode(sentencepiece_codec.encode(frame, P.path("piece_bpe_32k.model")), P.path("piece_bpe_32k.model"))
    for r in coded.collect():
        assert list(r.ids) == sp.encode(r.text or "")
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_encode_equals_library_on_documents(spark, sf):
    import hashlib

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_sentencepiece(spark, sf).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_pieces, r.round_trip) == (len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()


def test_counts_equal_library(spark, sf, frame):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in token_counts.count_tokens(frame, P.path("byte_bpe_50k.json")).collect():
        assert r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op5_token_counts(spark, sf).collect():
        n = len(t.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert tuple(r)[:4] == (r.doc_id, len(docs[r.doc_id].encode()), n, n > 1024)
        assert r.fitting_chars == len(docs[r.doc_id]) or len(t.encode(docs[r.doc_id][: r.fitting_chars], add_special_tokens=False).ids) <= 1024 < n


def test_every_prefix_and_truncation(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    texts = [x for x in HARD if len(x) < 200][:150]
    rows = token_counts.prefix_counts(spark.createDataFrame([(x,) for x in texts] + [(None,)], "text string"), P.path("byte_bpe_50k.json"))
    for r in token_counts.truncate(rows, 7).collect():
        want = [count((r.text or "")[:k]) for k in range(len(r.text or "") + 1)]
        assert list(r.prefix_tokens) == want
        if r.text is not None:
            assert r.truncated == r.text[: max(k for k, n in enumerate(want) if n <= 7)]


def test_answers_equal_the_stored_counts(spark):
    path = P.path("byte_bpe_50k.json")
    rows = spark.createDataFrame([(x, "y") for x in HARD] + [(None, "y")], "text string, answers string")
    stored = token_counts.prefix_counts(token_counts.answers(rows, path, (0, 1, 7, 1024)), path)
    assert stored.columns == ["text", "answers", "n_tokens", "fits_0", "fits_1", "fits_7", "fits_1024", "prefix_tokens"]
    for r in stored.collect():
        assert r.n_tokens == r.prefix_tokens[-1]
        for b in (0, 1, 7, 1024):
            assert r[f"fits_{b}"] == max(k for k, n in enumerate(r.prefix_tokens) if n <= b)


def test_long_chunks_are_encoded_in_stretches(monkeypatch):
    path = P.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Model(path)
    monkeypatch.setattr(sentencepiece_codec, "INDEX_CHARS", 40)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aeinorst\u00e9\u65e5-1") for _ in range(n)) for n in (39, 40, 41, 200, 777)] + ["a" * 300]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, np.int32).tolist() == sp.encode(text)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sentencepiece_codec.encode(none, P.path("piece_bpe_32k.model")).count() == 0
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json")).agg(F.sum("n_tokens")).first()[0] is None
