"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import (
    bpe,
    decontaminate,
    exact_dedup,
    langid,
    lexical_search,
    licenses,
    pii,
    sharding,
    simhash,
    topk,
    training_order,
    warc,
    whitening,
)
from hitloom.llm.store import saved
from hitloom.session import scratch_dir

TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ORDER_KEY = 20_240_601


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, F.col("text"), TOKENIZER, PATTERN).select("doc_id", "trip.*")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_items(docs, F.col("text"), table(spark, sf_dir, "benchmark"))
    n_hit, items = decontaminate.removed(F.col("match")), F.col("match")["items"]
    return found.select(
        "doc_id",
        "match.n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.with_spans(docs, F.col("text"), pii.fit(docs, F.col("text")))
    base = F.col("pii")["base"]
    of_kind = lambda rank: F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(rank).alias(f"n_{kind}") for rank, kind in enumerate(pii.FORMATS)],
        F.sha2(pii.named(base), 256).alias("base_sha256"),
        pii.named(F.col("pii")["spans"]).alias("spans"),
    )


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training_order.materialise(docs, F.col("text"), path, TOKENIZER, PATTERN, key=ORDER_KEY)
    return training_order.read_shards(spark, path, with_ids=False).drop("ids")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"))
    starts = F.col("license")["starts"]
    return found.select(
        "doc_id",
        "license.n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("license.base", ",").alias("base_labels"),
        F.array_join("license.labels", ",").alias("labels"),
        "license.score",
    )


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out(F.col("doc_id"))
    fitted = langid.fit(docs.where(~held_out & F.col("doc_id").isNotNull()))
    found = langid.identify(docs.select("doc_id", "text"), F.col("text"), fitted)
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_by_bytes(docs, F.col("text"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = saved(warc.read_records(spark, path).drop("payload"), "records")
    found = warc.resolved(warc.transactions(records))
    return found.select(
        F.col("metadata.page_id").cast("long").alias("page_id"),
        "payload_bytes",
        F.coalesce("payload_sha256", "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers_page").alias("refers_to"),
    )


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), 8)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_topk": op1_topk,
    "op2_simhash": op2_simhash,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_training_order": op6_training_order,
    "op7_licenses": op7_licenses,
    "op8_langid": op8_langid,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_lexical": op11_lexical,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_whitening": op13_whitening,
    "pipeline": pipeline,
}
ORACLE: dict[str, str] = {
    "op1_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as c
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (
            select q.vec_id as query_id, p.vec_id,
                cast(list_sum(list_transform(list_zip(q.c, p.c), lambda z: z[1] * z[2])) as bigint) as score
            from v q join v p on q.vec_id <> p.vec_id
            where q.vec_id % 50 = 0),
        r as (
            select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank
            from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op10_warc": """
        with p as (
            select page_id, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as digest from pages),
        f as (
            select digest, min(page_id) as first from p where n >= 100 group by digest having count(*) > 1)
        select page_id, n as payload_bytes, p.digest as payload_digest,
            case when first is not null and (page_id is null or page_id > first) then 'revisit' else 'response' end
                as record_type,
            case when first is not null and (page_id is null or page_id > first) then first end as refers_to
        from p left join f on p.digest = f.digest""",
    "op11_lexical": r"""
        with words as (
            select row_number() over () as row, doc_id,
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ts
            from documents where text is not null),
        totals as (select count(*) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from words where len(ts) > 0),
        tf as (
            select row, doc_id, term, cast(count(*) as bigint) as tf,
                100 - 25 + (25 * any_value(n) * any_value(n_docs)) // any_value(n_terms) as m
            from (select row, doc_id, len(ts) as n, unnest(ts) as term from words), totals
            group by row, doc_id, term),
        df as (select term, count(*) as df from tf group by term),
        asked as (
            select item_id, text, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term
            from (select distinct item_id, text from benchmark)),
        weighed as (
            select item_id, text, a.term, count(*) as times,
                cast(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * any_value(df) + 1))) as bigint) as w
            from asked a join df on a.term = df.term, totals group by item_id, text, a.term),
        scores as (
            select item_id, text, doc_id, row,
                cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
            from weighed q join tf on q.term = tf.term group by item_id, text, doc_id, row),
        ranked as (
            select item_id, doc_id, score, cast(row_number() over (
                partition by item_id, text order by score desc, doc_id nulls last) as integer) as rank
            from scores where score > 0)
        select item_id, rank, doc_id, score from ranked where rank <= 20""",
    "op12_exact_dedup": r"""
        with d as (
            select doc_id, coalesce(text, '') as t,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as c, row_number() over () as row
            from documents),
        g as (
            select *, count(*) over (partition by c) as group_size,
                first_value(doc_id) over best as keep_id, row_number() over best as place
            from d window best as (
                partition by c order by length(t) desc, doc_id nulls last, row
                rows between unbounded preceding and unbounded following))
        select doc_id, keep_id, group_size, place = 1 as kept, sha256(c) as text_sha256 from g""",
}
