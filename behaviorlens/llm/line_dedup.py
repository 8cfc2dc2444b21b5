"""Repeated lines, returned as per-document bitmaps.

Lines are keyed by a 128-bit hash of the folded line.  Hashes are
range-partitioned together with a block of the document id, sorted by
document and position inside the partition, and streamed once: every
(hash, block) run yields its number of documents and its first occurrence.
A line that a third of all documents share is therefore cut at range borders
inside its run.  Only one short row for each run meets in the per-hash total,
and only positions of lines to drop go back to the documents, as 64-line
words in which a set bit drops a line (words without one are left out).

Everything is DataFrame functions.

Defined results: a NULL or empty text is one empty line; an empty key (with
``min_key_chars`` >= 1) never drops; rows with equal ``doc_id`` count as one
document, and each text of it has a bitmap of its own; rows with a NULL id are kept whole.  Columns other
than id and text pass through ``apply_bitmaps`` whatever their names, but for
those that it adds, which are an error; lines and texts may be of any length;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import shuffle_partitions, written

#: Blocks into which the documents of one line are dealt.
BLOCKS = 1024
WHITE = "\t\n\x0b\x0c\r "
#: Characters other than A-Z that ``lower`` changes.
OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Stripped, with A-Z lower-cased.  ``lower`` is that (and much faster)
    unless another character has a lower case."""
    key = F.trim(line, F.lit(WHITE))
    ascii_only = F.octet_length(key) == F.length(key)
    return F.when(ascii_only | ~F.rlike(key, F.lit(OTHER_UPPER)), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def text_mark(text: Column) -> Column:
    """Tells the texts of one document id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_key_chars: int) -> DataFrame:
    """(doc, mark, pos, h1, h2) of every line whose key is long enough."""
    line = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), text_mark(F.col(text_col)).alias("mark"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    key = line.select("doc", "mark", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_key_chars)
    return key.select("doc", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, first) of keys in at least ``min_docs`` documents; first is
    the smallest (doc, pos, mark)."""
    spark = lines.sparkSession
    dealt = lines.withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(BLOCKS)).cast("int")).repartitionByRange(shuffle_partitions(spark), "h1", "h2", "block")
    order = W.partitionBy("h1", "h2", "block").orderBy("doc", "pos")
    stream = dealt.select("h1", "h2", "block", F.struct("doc", "pos", "mark").alias("at"), F.lag("doc").over(order).alias("prev"))
    runs = stream.groupBy("h1", "h2", "block").agg(
        F.sum(F.when(F.col("prev").isNull() | (F.col("prev") != F.col("at.doc")), 1).otherwise(0)).alias("n"),
        F.min("at").alias("first"),
    )
    total = runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return total.filter(F.col("n") >= min_docs).select("h1", "h2", "first")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, min_key_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """One row for each text of a document that loses a line: (id, n_dropped,
    dropped, __mark), ``__mark`` a hash of the text and ``dropped`` a map from word number to 64 bits, bit ``pos % 64`` of word
    ``pos div 64`` set when line ``pos`` goes.  ``keep_first`` keeps the first
    occurrence in (document, position) order; otherwise all go."""
    lines = written(keyed_lines(docs, id_col, text_col, min_key_chars))  # texts are split once
    # a table, so that its size is known and a hot key's lines can be split in the join
    hit = lines.join(written(repeated_keys(lines, min_docs)), ["h1", "h2"])
    if keep_first:
        hit = hit.filter((F.col("doc") != F.col("first.doc")) | (F.col("pos") != F.col("first.pos")) | (F.col("mark") != F.col("first.mark")))
    # a function, since shiftleft takes its distance as a Python integer only
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("pos") % 64).cast("int"))
    word = hit.groupBy("doc", "mark", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    maps = word.groupBy("doc", "mark").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
    )
    return maps.select(F.col("doc").alias(id_col), "n_dropped", "dropped", F.col("mark").alias("__mark"))


def kept_lines(text: Column, dropped: Column) -> Column:
    """Lines of ``text`` whose bit is clear, as an array (NULL map: all)."""
    lines = lines_of(text)
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / 64).cast("int")), lambda w: F.coalesce(F.element_at(dropped, w), F.lit(0).cast("long")))

    def clear(words_: Column, i: Column) -> Column:
        shifted = F.call_function("shiftrightunsigned", F.get(words_, F.floor(i / 64).cast("int")), (i % 64).cast("int"))
        return shifted.bitwiseAND(F.lit(1).cast("long")) == 0

    # the dense words are bound once by a one-element transform
    return F.when(dropped.isNull(), lines).otherwise(F.get(F.transform(F.array(words), lambda ws: F.filter(lines, lambda _, i: clear(ws, i))), 0))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` plus ``__n_lines``, ``__n_dropped``
    and ``__kept``, the text of the lines that stay."""
    added = ["__n_lines", "__n_dropped", "__kept"]
    if taken := sorted(set(added) & set(docs.columns)):
        raise ValueError(f"columns that the result adds: {', '.join(taken)}")
    # given columns travel under positions, so no name can clash
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    maps = bitmaps.select(F.col(id_col).alias("__id"), F.col("n_dropped").alias("__n_dropped"), F.col("dropped").alias("__dropped"), "__mark").hint("shuffle_hash")
    both = own.join(maps, (F.col(key) == F.col("__id")) & (text_mark(F.col(text)) == F.col("__mark")), "left")
    lines = F.size(lines_of(F.col(text))).cast("long")
    kept = F.array_join(kept_lines(F.col(text), F.col("__dropped")), "\n")
    out = both.select(*own.columns, lines.alias("__n_lines"), F.coalesce("__n_dropped", F.lit(0).cast("long")).alias("__n_dropped"), kept.alias("__kept"))
    return out.toDF(*docs.columns, *added)
