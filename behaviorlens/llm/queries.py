"""One registered query for each operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import chat_windows, decontaminate, embedding_dedup, lexical_search, line_dedup, ngram_join, ordinal, pseudonyms, spelling, substring_dedup, unigram, url_filter, warc
from .common import table


#: Grades of a document: toxic, of low quality, good.
GRADES = 3
#: A deployment passes its own.
PSEUDONYM_KEY = b"behaviorlens"
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grade) from the labels: 0 toxic, else 1 plus the quality."""
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).otherwise(F.col("quality") + 1).alias("grade"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, rated_documents(spark, sf_dir), GRADES)
    return ordinal.grade(docs, model, GRADES).select("doc_id", "expected_grade", "p_top", F.col("selected").alias("kept"))


#: (verdict, host and path) of the url query.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list has every host with a page that is linked with a tracking
    parameter; all hosts of ``pages`` are the key universe."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    keys = pages.select(url_filter.host_of(F.col("url")).alias("key"), F.contains("url", F.lit("utm_")).alias("listed"))
    return url_filter.judge(pages, keys, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat_windows.read_back(chat_windows.windows(turns.unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    targets = F.array_join("targets", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(targets).cast("long").alias("loss_chars"),
        F.sha2(targets, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return out.select("doc_id", "text", F.size("findings").cast("long").alias("n_found"), "findings")


def op6_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it again."""
    model = unigram.read_model(spark, SENTENCEPIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = unigram.decode(unigram.encode(docs, model), model)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.drop_bitmaps(docs, min_docs=10, min_key_chars=1, keep_first=False)
    out = line_dedup.apply_bitmaps(docs, bitmaps)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=10)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), min_chars=7, min_count=2, ratio=10)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.resolved(warc.read_archives(spark, path))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_ordinal_quality,
        op3_url_filter,
        op4_chat_windows,
        op5_pseudonyms,
        op6_unigram,
        op7_ngram_join,
        op8_substring_dedup,
        op9_embedding_dedup,
        op10_line_dedup,
        op11_lexical_search,
        op12_spelling_variants,
        op13_warc,
    )
}
