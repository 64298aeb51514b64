import tiktoken
from test_decontaminate import brute as brute_items
from test_near_copies import plain_near_copies
from test_pii import brute as brute_spans

import corpus_pipeline
from hitloom.llm import bpe, pii
from hitloom.llm.queries import PATTERN, TOKENIZER

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, "12 .. 34", None, "x", 8), (9002, None, "en", "x", None), (9003, "", "en", None, 0)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], SF).cache())
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(t.columns == docs.columns and t.dtypes == docs.dtypes for t in tables[:-1])

    letters = {d for d, r in rows[0].items() if any(c.isalpha() for c in r.text or "")}
    assert set(rows[1]) == letters and any(r.lang is None for r in rows[0].values())
    for d, r in rows[1].items():  # a missing language is filled in, all else stays
        before = rows[0][d].asDict()
        assert r.lang and r.asDict() == {**before, "lang": before["lang"] or r.lang}

    groups = plain_near_copies({d: r.text for d, r in rows[1].items()})
    assert set(rows[2]) == set(groups.values())
    assert all(rows[2][d] == rows[1][d] for d in rows[2])

    hit = {d: brute_items(r.text, items) for d, r in rows[2].items()}
    assert set(rows[3]) == {d for d, (n, words, _) in hit.items() if len(words) <= n / 2}
    assert all(rows[3][d].text == rows[2][d].text for d in rows[3] if not hit[d][1])
    assert any(words for _, words, _ in hit.values())
    assert not any(brute_items(r.text, items)[1] for r in rows[3].values())

    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        want = brute_spans(rows[3][d].text)
        assert sum(r.text.count(f"[{kind.upper()}]") for kind in pii.KINDS) >= len({a for a, _, _ in want}) > 0 or not want
        assert r.n_chars == len(r.text)

    ranks = {token: i for i, token in enumerate(bpe.read_ranks(TOKENIZER))}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for d, r in rows[5].items():
        assert list(r.ids) == library.encode_ordinary(rows[4][d].text) and r.n_tokens == len(r.ids) and r.lossless


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
