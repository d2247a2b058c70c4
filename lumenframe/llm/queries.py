"""One query for each corpus operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import ann, bpe, decontam, langid, ngram_join, oracles, quality, suffix_dedup, token_counts, urls, warc
from lumenframe.llm.tables import cut, scratch, table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


WORD_BPE = "word_bpe_49k.json"
#: Rows of text that go to Python at once; whole texts can be long.
ROWS_AT_ONCE = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batches to ROWS_AT_ONCE for the queries here, which run when their result is used."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text, decodes the ids, and returns digests of both."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.encode(docs, tokenizer(WORD_BPE), decoded="decoded")
    return done.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked groups of documents whose sets of three-word shingles have a Jaccard index of 0.9."""
    small_batches(spark)
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90)


#: Budget of tokens of the token counts' query.
LIMIT = 2048


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix table of every text, and what it says of the text's count and a budget."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    done = token_counts.prefix_table(docs, tokenizer(WORD_BPE)).withColumn("n_tokens", token_counts.total(F.col("prefix_tokens")))
    return done.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), token_counts.words_within(F.col("prefix_tokens"), LIMIT).alias("words_within"))


#: The rules of the url filter's query.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges every url; a page is labelled by the document whose number its path holds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    number = F.expr("try_cast(regexp_extract(url, '/([0-9]{1,18})', 1) as bigint)")
    labelled = pages.withColumn("n", number).join(marks, F.col("n") == F.col("doc_id"), "left").select("page_id", "url", "bad")
    return urls.judge(labelled, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows to each row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains."""
    small_batches(spark)
    return decontam.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes every repeated string of 200 bytes."""
    small_batches(spark)
    done = suffix_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return done.select("doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every text; a fifth of the labels is held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(langid.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    marks = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.fit(docs.filter(~F.col("held_out")), marks)
    return quality.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page to .warc.gz files in the shared folder, and reads them back."""
    small_batches(spark)
    folder = scratch(spark)
    cut(warc.write_files(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder))
    return warc.read_files(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


PIECES = "piece_bpe_32k.model"


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of every text; a quarter of the rows is held out."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(langid.fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")), tokenizer(PIECES))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_bpe": op2_bpe,
    "op3_ann": op3_ann,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality": op6_quality,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
}

#: Queries that DuckDB can express over whole tables.
ORACLES: dict[str, str] = {
    "op5_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op7_ngram_join": oracles.NGRAM_JOIN,
    "op9_warc": oracles.WARC,
}
