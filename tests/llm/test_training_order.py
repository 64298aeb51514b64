import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from hitloom.llm import bpe
from hitloom.llm import training_order as order

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_permutation(n):
    slots = [order.permuted(np.arange(n), n, key) for key in (1, 2)]
    assert all(sorted(s.tolist()) == list(range(n)) for s in slots)
    assert n < 17 or (slots[0] != slots[1]).any() and (slots[0] != np.arange(n)).any()
    assert order.permuted(np.array([n - 1]), n, 1)[0] == slots[0][-1]


def test_shards(spark, tmp_path):
    tokens = bpe.read_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, "word " * 700), (None, "no id"), (5, "é\n" * 33), (5, "é\n" * 33)]
    texts += [(10 + i, f"text {i} " * (i % 9)) for i in range(200)]
    df = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, slot int, seq int").repartition(5)
    want = []
    for doc, text in texts:
        ids = library.encode_ordinary(text or "")
        want += [(doc or -1, at // 16, ids[at : at + 16]) for at in range(0, len(ids), 16)]
    path, size = str(tmp_path / "shards"), order.stride(16, 2)
    n = order.materialise(df, F.col("text"), path, PATH, PATTERN, 9, seq_tokens=16, shard_slots=64)
    rows = order.read_shards(spark, path, 16, shard_slots=64).collect()
    assert n == len(want) and sorted(r.slot for r in rows) == list(range(n))
    assert sorted((r.doc_id or -1, r.seq, r.ids) for r in rows) == sorted(want)
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u2").tobytes()) and r.n_tokens == len(r.ids) for r in rows)
    files = sorted((tmp_path / "shards").glob("part-*"))
    assert [f.stat().st_size for f in files] == [64 * size] * (n // 64) + [n % 64 * size] * (n % 64 > 0)
    for r in rows[:50]:  # a record is found by its slot alone
        raw = files[r.slot // 64].read_bytes()[r.slot % 64 * size :][:size]
        assert int.from_bytes(raw[:8], "little") == r.slot and r.offset == r.slot % 64 * size and r.shard == r.slot // 64


def test_empty_and_small_ids(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    for name, rows in (("a", df), ("b", df.limit(0))):
        assert order.materialise(rows, F.col("text"), str(tmp_path / name), PATH, PATTERN, 1) == 0
        assert order.read_shards(spark, str(tmp_path / name)).count() == 0


def test_cut_goes_on_over_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_CHARS", 50)
    import pyarrow as pa

    codec = order.LibraryCodec((bpe.read_ranks(PATH), PATTERN))
    text = "the quick brown fox jumps over the lazy dog " * 20
    got = list(order._cut(codec, pa.array(["x", text, None, text]), 7))
    whole = codec.library.encode_ordinary(text)
    assert [i for row, _, ids in got if row == 3 for i in ids] == whole
    assert [seq for row, seq, _ in got if row == 1] == list(range(-(-len(whole) // 7)))
