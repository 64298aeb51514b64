"""Documents to training tokens: language, near-duplicates, test items, personal data, token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last returns the token ids.  Clean documents stay in each:

- language: texts without a letter go (null and empty ones among them); a null ``lang`` takes the
  predicted one;
- near_duplicates: of documents joined by pairs whose 5-word shingle sets are similar to 0.8 or
  more, the least doc_id stays;
- decontaminate: passages of ``benchmark`` are cut out; a document goes when more than half
  of its words are such passages;
- redact: personal data gives way to a placeholder of its kind;
- tokenize: ids of the byte-level BPE, decoded again to show that nothing is lost.

``n_chars`` follows the text.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hitloom.llm import bpe, decontaminate, langid, near_copies, pii, simhash
from hitloom.llm.queries import PATTERN, TOKENIZER
from hitloom.llm.store import saved
from hitloom.session import tune


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text and its number of characters; columns stay in their order."""
    new = docs.withColumn("text", text)
    return new.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learn = docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    found = langid.identify(docs, F.col("text"), langid.fit(learn), "_language_")
    lang = F.coalesce("lang", F.nullif(F.col("_language_")["lang"], F.lit(langid.UNKNOWN)))
    return found.where("_language_.letters").withColumn("lang", lang).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_component(docs, classes=near_copies.near_copies)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(kept, F.col("text"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.with_spans(docs, F.col("text"), pii.fit(docs, F.col("text")), "_pii_")
    return _with_text(found, pii.redacted(F.col("text"), F.col("_pii_")["spans"])).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, lossless)."""
    rows = docs.select("doc_id", "lang", "source", F.col("text").alias("_text_"))
    rows = bpe.encode_checked(rows, F.col("_text_"), TOKENIZER, PATTERN)
    ids = F.col("encoded")["ids"]
    return rows.select("doc_id", "lang", "source", ids.alias("ids"), F.size(ids).alias("n_tokens"), "encoded.lossless")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("redact", redact),
    ("tokenize", tokenize),
]
#: The stages can't be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
