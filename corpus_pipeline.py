"""The corpus pipeline: stages that each take the documents the stage before
kept, written as Parquet in between.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the columns of ``documents`` (the last one adds its encoding, under
names that no given column has).  Every further column of ``docs`` passes
through unchanged, whatever its name.  Empty inputs give empty outputs; NULL
texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorlens.llm import decontaminate, line_dedup, ngram_join, ordinal, unigram
from behaviorlens.llm.common import table, written
from behaviorlens.llm.queries import GRADES, SENTENCEPIECE_MODEL, rated_documents
from behaviorlens.llm.url_filter import among

#: A line in at least so many documents stays in the first of them only.
LINE_DOCS = 10


#: Columns that stages read or change.
OWN = ("doc_id", "text", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """The documents with every further column under its position, so that no
    name can clash with an operator's."""
    return docs.toDF(*[c if c in OWN else f"column_{i}" for i, c in enumerate(docs.columns)])


def named(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of those of ``plain(docs)``."""
    return out.select(*plain(docs).columns).toDF(*docs.columns)


def free(name: str, taken: list[str]) -> str:
    lower = {c.lower() for c in taken}
    while name in lower:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``gone``, distinct ids.  Only
    rows that a Bloom filter of these lets through are joined, so that not
    every text is shuffled."""
    gone = written(gone)
    some = among(gone, F.col("doc_id"))
    return docs.filter(~some).unionByName(docs.filter(some).join(gone, "doc_id", "left_anti"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the rated documents
    among ``docs``, selects; all of them if none is rated."""
    given = plain(docs)
    model = ordinal.train(given, rated_documents(spark, sf_dir), GRADES)
    if model is None:
        return docs
    return named(ordinal.grade(given, model, GRADES).filter("selected"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line found in ``LINE_DOCS`` documents or more stays at its first
    occurrence; ``n_chars`` follows the text."""
    given = plain(docs)
    bitmaps = line_dedup.drop_bitmaps(given, min_docs=LINE_DOCS, min_key_chars=1, keep_first=True)
    out = line_dedup.apply_bitmaps(given, bitmaps)
    changed = F.col("__n_dropped") > 0
    new = {"text": F.when(changed, F.col("__kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    return named(out.select(*[new[c].alias(c) if c in new else F.col(c) for c in given.columns]), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by
    five-word shingle sets of similarity 0.8 or more."""
    given = plain(docs)
    groups = ngram_join.near_duplicates(given, k=5, num=8, den=10)
    gone = groups.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return named(without(given, gone), docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    given = plain(docs)
    leaks = decontaminate.find_items(given, table(spark, sf_dir, "benchmark"))
    return named(without(given, leaks.select("doc_id").distinct()), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their texts and the number of these."""
    given = plain(docs)
    out = unigram.encode(given, unigram.read_model(spark, SENTENCEPIECE_MODEL)).withColumn("n_tokens", F.size("ids").cast("long"))
    added = ("ids", "n_tokens")
    return out.select(*given.columns, *added).toDF(*docs.columns, *[free(c, docs.columns) for c in added])


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("SentencePiece encoding", encode),
]

#: The classifier's fit is not SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
