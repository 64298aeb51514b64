import zlib

from pyspark.sql import functions as F

from hitloom.llm import langid
from hitloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = QUERIES["op8_langid"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    scored = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out and lang[r.doc_id]]
    assert sum(scored) / len(scored) > 0.97


def test_words_first_then_shorter_grams():
    fitted = {
        "langs": ["aa", "bb"],
        "parts": {0: {"the": 0}, 4: {"_hou": 1}, 3: {"hou": 2}, 2: {}, 1: {"x": 3}},
        "logs": __import__("numpy").array([[-1.0, -5.0], [-5.0, -1.0], [-1.0, -9.0], [-2.0, -1.0]]),
    }
    model = langid.Model(fitted)
    assert model.scores(["the"])[0][0] == "aa"  # known as a word
    assert model.word("house").tolist() == [-5.0, -1.0]  # the 4-gram wins over the 3-gram
    assert model.word("ahou").tolist() == [-1.0, -9.0]
    assert model.word("zx").tolist() == [-2.0, -1.0]
    assert model.word("zz").tolist() == [0.0, 0.0]
    assert model.scores(["zz"])[0] == ("aa", 0.5, True)  # a tie goes to the first


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "en"), (4, "the cat and the dog", "en"), (4, "le chat et le chien", "fr"),
            (5, "the", None), (6, "THE " * 3000, "en"), (None, "the cat", "en"), (7, "日本", "ja")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    fitted = langid.fit(df)
    got = [(r.doc_id, r.language.lang, r.language.letters) for r in langid.identify(df, F.col("text"), fitted).collect()]
    assert got == [(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "fr", True),
                   (5, "en", True), (6, "en", True), (None, "en", True), (7, "ja", True)]
    empty = langid.fit(df.limit(0))
    assert [r.language.lang for r in langid.identify(df, F.col("text"), empty).collect()] == ["und"] * 9
    assert langid.identify(df.limit(0), F.col("text"), fitted).count() == 0


def test_sample_is_bounded(spark):
    df = spark.range(400).select(F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"))
    assert langid.sampled(df, 30).count() == 30
    assert langid.sampled(df, 1000).count() == 400


def test_blocks_hold_whole_words(monkeypatch):
    monkeypatch.setattr(langid, "PIECE_CHARS", 7)
    text = "one twothree, fourfivesix seven " * 3
    assert sum(langid.words_of(text), []) == ["one", "twothree", "fourfivesix", "seven"] * 3
