import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hitloom.llm import langid


def test_words_of_a_large_vocabulary_are_known(spark):
    digits = F.translate(F.format_string("%05d", "id"), "0123456789", "abcdefghij")
    words = spark.range(39_000).select(digits.alias("w")).agg(F.concat_ws(" ", F.collect_list("w")).alias("text"))
    fitted = langid.fit(words.withColumn("lang", F.lit("en")))
    assert len(fitted["parts"][0]) == 39_000


def test_copies_take_one_place_of_the_sample(spark):
    texts = spark.range(200).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    first = texts.orderBy(F.xxhash64("text")).limit(1)
    copies = first.crossJoin(spark.range(500)).select("text", "lang")
    sample = langid.sampled(texts.unionByName(copies), 50)
    assert sample.count() == sample.distinct().count() == 50


def test_memo_is_beside_the_known_words(monkeypatch):
    known = ["the", "le", "chat", "cat"]

    def fitted():
        grams = {4: {"_cha": 4, "_the": 5}, 3: {"cat": 6, "dog": 7}, 2: {"_d": 8}, 1: {"o": 9}}
        logs = -np.arange(20, dtype=np.float32).reshape(10, 2) ** 1.5
        return {"langs": ["en", "fr"], "parts": {0: dict(zip(known, range(4))), **grams}, "logs": logs}

    texts = ["the dog", "le chaton", "cats then dogs", "a b c d e f g h o", "the cat the dog", None, "chatte o"]
    want = langid.Model(fitted()).scores(texts)
    monkeypatch.setattr(langid, "MEMO_CELLS", 6)  # three words; the fourth text has nine
    small = langid.Model(given := fitted())
    assert small.scores(texts) == want and small.scores(texts[::-1]) == want[::-1]
    assert list(given["parts"][0]) == known and not set(small.memo) & set(known)


def test_pack_keeps_names_beside_counts():
    rows = [(0, "b", [1, 2]), (4, "abcd", [3, 4]), (0, "a", [5, 6]), (0, "c", [7, 8])]
    table = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.list_(pa.int64())))]
    batch = pa.RecordBatch.from_arrays(table, ["n", "part", "counts"])
    got = [tuple(r.values()) for b in langid._pack(iter([batch.slice(0, 1), batch.slice(1), batch.slice(0, 0)])) for r in b.to_pylist()]
    assert [(n, p, np.frombuffer(c, np.int64).tolist()) for n, p, c in got] == [(0, "b\na\nc", [1, 2, 5, 6, 7, 8]), (4, "abcd", [3, 4])]
