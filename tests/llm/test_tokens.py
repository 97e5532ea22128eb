"""Encoding and counting agree with the libraries; decoding gives the text back."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, catalog, token_counts
from tests.llm.frames import documents, odd, prose

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["'", "'s", "'re", "'LL", "'d", "'x", " ", "  ", "\n", "\t", "a", "bc", "é", "1", "23", "!", "?!", "中", "́", "😀", "²", "Ⅷ", "\x1c", "　", "'v"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def mixed():
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(3000)]


def test_encoding_equals_the_library(spark, library, mixed):
    df = documents(spark, list(enumerate(mixed)))
    got = {r.doc_id: r.ids for r in bpe.encode(df, RANKS).collect()}
    assert all(got[i] == library.encode_ordinary(t) for i, t in enumerate(mixed))


def test_odd_documents_come_back(spark, library):
    df = odd(spark).withColumn("IDS", F.lit("clash")).withColumn("extra", F.lit(1))
    rows = bpe.decode(bpe.encode(df, RANKS, ends="ends", decoded="same"), RANKS).collect()
    assert len(rows) == df.count() and "extra" in rows[0]
    for r in rows:
        raw = (r.text or "").encode()
        assert bytes(r.decoded) == raw and bytes(r.same) == raw and r.ids == library.encode_ordinary(r.text or "")
        assert len(r.ends) == len(r.ids) and (not raw or r.ends[-1] == len(raw))


def test_long_piece_and_short_pieces_merge_alike(library):
    with open(RANKS, "rb") as f:
        merges, _ = bpe.encoder(f.read())
    for piece in (b"thentionthe", "ééé中".encode(), b"a" * 60, b"abcabcabcxyz"):
        assert bpe.merge_many([piece], merges)[0] == bpe.merge_long(piece, merges.ranks)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert bpe.decode(bpe.encode(empty, RANKS), RANKS).count() == 0
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_null_ids_decode_to_null(spark):
    df = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert sorted((r.decoded is None, r.decoded) for r in bpe.decode(df, RANKS).collect()) == [(False, b""), (True, None)]


def test_query_digests(spark, folder, library):
    texts = {r.doc_id: r.text or "" for r in catalog.documents(spark, folder).collect()}
    rows = catalog.QUERIES["op1_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chunks_resynchronise():
    with open(MODEL, "rb") as f:
        count = token_counts.Counter(f.read(), chunk=200, overlap=10)
    r = random.Random(2)
    for i in range(400):
        parts = PARTS + ["▁", "the ", "   "] if i % 3 else ["a", "bc", "中"]  # without a space to cut at, overlaps widen
        text = "".join(r.choice(parts) for _ in range(r.randint(200, 900)))
        assert count.huge(text) == len(count.model.encode(text))


def test_counts_of_odd_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = odd(spark).withColumn("N_TOKENS", F.lit("clash"))
    out = token_counts.count_tokens(df.withColumn("copy", F.col("text")), MODEL, chunk=1000, overlap=50).collect()
    assert len(out) == df.count()
    assert all(r.n_tokens == len(library.encode(r.copy or "")) for r in out)


def test_query_counts(spark, folder):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r.doc_id: r.text or "" for r in catalog.documents(spark, folder).collect()}
    for r in catalog.QUERIES["op8_token_counts"](spark, folder).collect():
        n = len(library.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)


def test_long_prose_is_counted_in_chunks(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = prose(3, 20_000)
    assert token_counts.count_tokens(documents(spark, [(1, text)]), MODEL).first().n_tokens == len(library.encode(text))
