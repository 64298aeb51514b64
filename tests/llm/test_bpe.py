import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hitloom.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = [
    None, "", " ", "it's 'still we're 'llx\n\n  x  ", "'s's 's!'s", " \n \t x", "a" * 5000, "¼ ² ½½ x²",
    "日本語のテキスト 한국어 текст", "a\x1cb\x85c　d", "é 👩‍👩‍👧", "the end the end", "the end the end",
    "<|endoftext|> 0123456789",
]


@pytest.fixture(scope="module")
def want():
    tokens = bpe.read_ranks(PATH)
    ranks = {token: i for i, token in enumerate(tokens)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_has_one_slot_per_key():
    tokens = bpe.read_ranks(PATH)
    hashed = bpe.PerfectHash(tokens)
    assert hashed.lookup(tokens).tolist() == list(range(len(tokens)))
    assert sorted(hashed.ids.tolist()) == list(range(len(tokens)))
    assert set(hashed.lookup([b"", b"x" * 99, b"zqzqzqzq", b"\xff\xff\xff"]).tolist()) == {-1}


def test_small_vocabularies():
    for n in (1, 2, 3, 5):
        keys = [bytes([i]) for i in range(n)]
        assert bpe.PerfectHash(keys).lookup(keys).tolist() == list(range(n))


def test_like_the_library(spark, want):
    rows = [(i, t, 0, 0) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens int")
    df = bpe.encode(df.drop("ids"), F.col("text"), PATH, PATTERN)
    for row in bpe.decode(df, F.col("ids"), PATH, PATTERN).collect():
        text = row.text or ""
        assert list(row.ids) == want.encode_ordinary(text)
        assert bytes(row.bytes) == text.encode()


def test_digests(spark, want):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for row in bpe.round_trip(df, F.col("text"), PATH, PATTERN).collect():
        ids = want.encode_ordinary(row.text or "")
        assert row.trip.n_tokens == len(ids)
        assert row.trip.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.trip.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.round_trip(df.limit(0), F.col("text"), PATH, PATTERN).count() == 0


def test_pieces_do_not_change_the_ids(want):
    text = "the quick brown fox don't stop  at 42\n" * 50
    codec = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    parts = list(bpe.pieces(text, 100))
    assert len(parts) > 5 and "".join(parts) == text
    assert [i for p in parts for i in codec.encode(p)] == want.encode_ordinary(text)


def test_another_pattern_holds_for_every_text():
    ranks = bpe.read_ranks(PATH)
    for pattern in (r"\S+|\s+", r"[a-z]+ [a-z]+|[\s\S]"):
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})
        codec = bpe.Codec(ranks, pattern)
        for text in ("a b-1 c", "a b-1 c 日", "one two three 4", "it's " * 400_000):
            assert codec.encode(text) == library.encode_ordinary(text)
