"""A corpus pipeline of five stages, each of which reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and all but the last return the columns of documents:

1. language: documents whose language can't be told, `und` or a posterior under LEAST_SCORE, go.
2. near_duplicates: of each group linked by the n-gram Jaccard join (five words, 0.8) the document
   with the smallest doc_id stays.
3. repeats: bytes of strings of 200 bytes that occur elsewhere go; documents with nothing left go.
   n_chars becomes the length of what is left.  A character of which a byte goes, goes too.
4. decontamination: documents that contain a benchmark item go.
5. tokens: adds the BPE ids of every document, their number, and the decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import bpe, decontam, langid, ngram_join, suffix_dedup
from lumenframe.llm.queries import PIECES, WORD_BPE, small_batches, tokenizer
from lumenframe.llm.tables import cut, table

LEAST_SCORE = 0.5
#: Near duplicates: words of a shingle, and least Jaccard index in per cent.
WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = langid.fit(docs, tokenizer(PIECES))
    told = langid.identify(docs, model, lang="_lang_pred", score="_lang_score")
    return told.filter((F.col("_lang_pred") != langid.UNDETERMINED) & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a doc_id stay; of rows with equal doc_id and text all stay or all go."""
    small_batches(spark)
    groups = ngram_join.join(docs, WORDS, PERCENT, mark="_text")
    extra = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("_extra"), "_text").distinct()
    return docs.join(extra, (F.col("doc_id") == F.col("_extra")) & (F.xxhash64("text") == F.col("_text")), "left_anti")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = suffix_dedup.remove(docs, kept="_kept", spans="_spans", as_text=True)
    cut_out = F.size("_spans") > 0
    rest = done.filter(~cut_out | (F.length("_kept") > 0)).withColumn("n_chars", F.when(cut_out, F.length("_kept").cast("long")).otherwise(F.col("n_chars")))
    return rest.withColumn("text", F.when(cut_out, F.col("_kept")).otherwise(F.col("text"))).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    done = bpe.encode(docs, tokenizer(WORD_BPE), decoded="decoded")
    return done.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: SQL can express neither the models nor the transform; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
