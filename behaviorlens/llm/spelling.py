"""Spelling variants: words one edit apart, and the form each one stands for.

Words are counted over all documents (per task first), and near words (exactly
one inserted, deleted or replaced character) are found by scanning sorted word
lists: for each word, rows of a banded edit matrix run along the sorted list,
the rows of the prefix that a word shares with the one before it are used
again, and once every cell of a row is above one edit, all words that share
its prefix are skipped.

The sorted vocabulary is cut so that no task needs all of it.  Two words of
one edit, the shorter of ``n`` characters, share their first or their last
``(n - 1) // 2`` characters, so lists of words with an equal beginning, and of
reversed words with an equal ending, hold all pairs between them; a pair in
both is taken from the first.  Words with one beginning (or ending) that are
more than ``HOT_LIST`` are cut into finer lists by everything but one
character: a list then has a word for each letter at most, and every pair is
in one of them.

A word's form is its most frequent near word (ties: the first in code-point
order) if that is ``ratio`` times as frequent; its root is the end of the
chain of forms, found by pointer jumping: chains are as long as the logarithm
of the largest count at most.

Defined results: NULL and empty texts have no words; without a document id no
word loses a character; a row that is repeated counts again; equal counts go by
code-point order; texts of any length are read in slices; empty tables give no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import shuffle_partitions, utf8, written

LETTER = "A-Za-zÀ-ÿ"
_GAP = re.compile(f"[^{LETTER}]")
#: Characters of a text that are cut into words at once.
SLICE = 1 << 20
#: Different words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Words of one list.
HOT_LIST = 20_000
#: One in so many (document, word) pairs loses a character.
TYPO = 31

COUNT = "word string, n long"
PAIR = "word string, n long, near string, n_of_near long"


def runs_of(raw: bytes, least: int) -> Counter:
    """Maximal runs of at least ``least`` letters, with A-Z lower-cased."""
    pattern = re.compile(f"[{LETTER}]{{{least},}}")
    out: Counter = Counter()
    text = raw.lower().decode()  # of bytes: A-Z only
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + SLICE)
        stop = gap.start() if gap else len(text)
        out.update(pattern.findall(text, start, stop))
        start = stop
    return out


def _counts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # the checksum of "<doc>:" goes on with each word
                head = None if doc is None else zlib.crc32(f"{doc}:".encode())
                for word, n in runs_of(text.as_py(), least).items():
                    if head is not None and not (h := zlib.crc32(word.encode(), head)) % TYPO:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield out()
        yield out()

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): words of at least ``min_chars`` characters that occur
    ``min_count`` times or more."""
    given = docs.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("text")).filter("text is not null")
    counts = given.mapInArrow(_counts(min_chars), COUNT).filter(F.length("word") >= min_chars)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def scan(words: list[str], size: int, after: Callable[[str, str], bool]) -> Iterator[tuple[int, int]]:
    """Places of pairs one edit apart in a sorted list, the first a word of
    ``size`` characters, the second of as many (and later) or one more.

    Row ``i`` of the matrix between a word and a listed one holds the edits
    between the listed one's first ``i`` characters and the word's first
    ``i - 1``, ``i`` and ``i + 1``; more than one edit is 2."""
    n = len(words)
    shared = [len(os.path.commonprefix((a, b))) for a, b in zip(words, words[1:], strict=False)] + [0]
    less = [n] * n  # the next place that shares fewer characters with its successor
    for j in range(n - 2, -1, -1):
        k = j + 1
        while k < n and shared[k] >= shared[j]:
            k = less[k]
        less[j] = k
    for q, word in enumerate(words):
        if len(word) != size:
            continue
        padded = word + "\0\0\0"  # cells past the word match nothing
        rows = [(2, 0, 1)]
        opens: list[str | None] = [None]  # characters that keep a row at one edit; None: any
        depth = 0  # rows that hold for the listed word
        j = 0
        while j < n:
            listed = words[j]
            long = len(listed)
            while depth < long:
                c = listed[depth]
                go_on = opens[depth]
                if go_on is not None and c not in go_on:
                    # lost: the prefix up to here, one character more than
                    # depth, and past the last of these all that share depth
                    lost = depth if not go_on or c > max(go_on) else depth + 1
                    while shared[j] >= lost:
                        j = less[j]
                    break
                left, same, right = rows[depth]
                depth += 1
                i = depth
                if same:  # one edit: only matches go on
                    a = 1 if left == 1 and padded[i - 2] == c else 2
                    b = 1 if same == 1 and padded[i - 1] == c else 2
                    d = 1 if right == 1 and padded[i] == c else 2
                else:  # insertion, match or replacement, deletion
                    a = 1
                    b = 2 if i > size else 1 if c != word[i - 1] else 0
                    d = 1 if i < size and (not b or word[i] == c) else 2
                del rows[depth:], opens[depth:]
                rows.append((a, b, d))
                if b:
                    opens.append((padded[i - 1] if a == 1 else "") + (padded[i] if b == 1 else "") + (padded[i + 1] if d == 1 else ""))
                else:
                    opens.append(None)
            else:
                last = rows[depth]
                if j != q and ((long == size and j > q and last[1] == 1) or (long == size + 1 and last[0] == 1)) and after(word, listed):
                    yield q, j
            depth = min(depth, shared[j])
            j += 1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every list; rows come ordered by list and word."""
    key, words, counts = None, [], []

    def found() -> Iterator[tuple[str, int, str, int]]:
        if len(words) < 2:
            return
        kind, size, half = key[0], key[1], key[2]
        back = kind == "suffix"

        def after(a: str, b: str) -> bool:
            # a pair with an equal beginning is found there
            return not back or a[::-1][:half] != b[::-1][:half]

        for i, j in scan(words, size, after):
            pair = [(words[k][::-1] if back else words[k], counts[k]) for k in (i, j)]
            yield (*min(pair), *max(pair))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["word", "n", "near", "n_of_near"])

    for batch in batches:
        out: list[tuple] = []
        for kind, size, half, part, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (kind, size, half, part) != key:
                out.extend(found())
                key, words, counts = (kind, size, half, part), [], []
            words.append(word)
            counts.append(n)
        yield batch_of(out)
    yield batch_of(list(found()))


def _entry(kind: str, size: Column, half: Column, part: Column, word: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), size.alias("size"), half.alias("half"), part.alias("part"), word.alias("entry"))


def _halves(word: Column) -> Column:
    """The four lists of a word: as the shorter (or equal) of a pair and as the
    longer, by beginning and by ending."""
    out = []
    for less in (0, 1):
        size = F.length(word) - less
        half = F.floor((size - 1) / 2).cast("int")
        back = F.reverse(word)
        out += [_entry("prefix", size, half, F.substr(word, F.lit(1), half), word), _entry("suffix", size, half, F.substr(back, F.lit(1), half), back)]
    return F.array(*out)


def _finer(word: Column) -> Column:
    """Lists of equal words but for one character: the word without each of
    its characters, with its place for words of equal length, and the word
    itself against those that are one longer."""
    size = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(i.alias("i"), F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)).alias("rest")))
    none = F.lit(0)
    equal = F.transform(cut, lambda x: _entry("equal", size, x["i"], x["rest"], word))
    longer = F.transform(F.array_distinct(F.transform(cut, lambda x: x["rest"])), lambda rest: _entry("longer", size - 1, none, rest, word))
    return F.concat(equal, longer, F.array(_entry("longer", size, none, word, word)))


def near_words(counts: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """(word, n, near, n_of_near): every pair of words one edit apart, once in
    each order."""
    listed = counts.select("word", "n", F.explode(_halves(F.col("word"))).alias("x")).select("word", "n", "x.*")
    key = ["kind", "size", "half", "part"]
    listed = written(listed)
    # pairs need a second word, and one as short as the list tells
    sizes = listed.groupBy(*key).agg(F.count("*").alias("words"), F.min(F.length("entry")).alias("least"))
    sizes = written(sizes.filter("words > 1 and least = size"))
    plain = listed.join(sizes.filter(F.col("words") <= hot_list).select(*key), key).select(*key, "entry", "n")
    lists = plain
    if not sizes.filter(F.col("words") > hot_list).isEmpty():
        hot = listed.join(sizes.filter(F.col("words") > hot_list).select(*key), key).select("word", "n").distinct()
        lists = plain.unionByName(hot.select("n", F.explode(_finer(F.col("word"))).alias("x")).select("x.*", "n"))
    dealt = lists.repartition(shuffle_partitions(counts.sparkSession), *key).sortWithinPartitions(*key, "entry")
    pairs = dealt.mapInArrow(_near, PAIR).distinct()
    return written(pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("n_of_near").alias("n"), F.col("word").alias("near"), F.col("n").alias("n_of_near"))))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, ratio: int = 10, hot_list: int = HOT_LIST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    counts = written(word_counts(docs, id_col, text_col, min_chars, min_count))
    near = near_words(counts, hot_list)
    most = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_of_near")).alias("less"), "near")).alias("most"))
    words = counts.join(most, "word", "left")
    frequent = -F.col("most.less") >= ratio * F.col("n")
    words = written(
        words.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("most.near")).alias("form"),
            F.when(frequent, -F.col("most.less")).alias("form_n"),
        )
    )
    up = materialize(words.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:  # a chain is half as long after each round
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        far = materialize(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        up = far.select("word", "root")
        if far.filter("moved").isEmpty():
            break
    return words.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
