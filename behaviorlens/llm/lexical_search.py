"""Ranked lexical search: the best documents of every item.

One pass over the documents builds an inverted index of the items' terms in
shards: a row holds the posting lists of some thousand documents, sorted by
document id.  Nothing is shuffled.  Corpus statistics (number of documents,
terms, document frequencies) are sums over all rows, not over matches.

Each shard is searched by a hybrid of the two classic orders.  An item's short
lists are summed into accumulators at once (term at a time).  The accumulators
then are one more iterator, with the largest sum as its bound, beside the long
lists in a document-at-a-time walk over ranges of documents: a range whose
bounds (largest contribution of each list in it) do not reach the item's
threshold is skipped; in the others the lists that could not reach it together
are only probed for documents that the rest has found.  The threshold is the
k-th best score so far, or the k-th largest accumulator if that is more, and
is carried from shard to shard of a task.  All bounds are exact integers, so
skipping loses nothing.

Items are searched in blocks of about ``BLOCK_TERMS`` different (item, term)
pairs, the only thing that passes through the driver; each block is one pass
over the documents.

Defined results: NULL or empty texts have no terms; documents without a term
count nowhere; documents without an id count in the statistics but are not
returned; rows that share a document id are documents of their own; rows that
share an item id are one item; items without id or terms have no results;
equal scores rank by document id.  Texts of any length are read in slices.
Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import run_starts, utf8, written

#: Letters and digits of ASCII and every byte of other characters.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text that are cut into terms at once.
SLICE = 1 << 20
#: (item, term) pairs of one block of items.
BLOCK_TERMS = 1_000_000
#: A shard ends with so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 1_000_000
#: Documents of a range that is skipped or scored.
RANGE = 512
#: Of an item's postings in a shard, the accumulators take those of its
#: shortest lists up to one for so many documents of the shard.
SHORT = 8

SHARD = "docs array<bigint>, sizes array<bigint>, terms array<int>, df array<int>, at array<int>, tf array<int>, n_docs bigint, n_terms bigint"
HIT = "item_id bigint, doc_id bigint, score bigint"


def term_counts(text: bytes) -> tuple[Counter, int]:
    """How often each term occurs, and all of them."""
    text = text.lower()
    counts: Counter = Counter()
    n = start = 0
    while start < len(text):
        gap = GAP.search(text, start + SLICE)
        stop = gap.start() if gap else len(text)
        words = TERM.findall(text, start, stop)
        counts.update(words)
        n += len(words)
        start = stop
    return counts, n


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(item, term) for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for term in term_counts(text.as_py())[0]]
        ids, terms = zip(*pairs, strict=True) if pairs else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], ["item", "term"])


class _Builder:
    """A shard in the making."""

    def __init__(self) -> None:
        self.docs: list[tuple[int | None, int, list[int], list[int]]] = []
        self.postings = self.n_docs = self.n_terms = 0

    def add(self, doc: int | None, text: bytes, numbers: dict[bytes, int]) -> None:
        counts, n = term_counts(text)
        self.n_docs += n > 0
        self.n_terms += n
        known = [(numbers[t], c) for t, c in counts.items() if t in numbers]
        if known:
            terms, tf = zip(*known, strict=True)
            self.docs.append((doc, n, terms, tf))
            self.postings += len(known)

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def batch(self) -> pa.RecordBatch:
        # documents without an id come last, past what is searched
        self.docs.sort(key=lambda d: (d[0] is None, d[0] or 0))
        term = np.array([t for d in self.docs for t in d[2]], np.int32)
        tf = np.array([c for d in self.docs for c in d[3]], np.int32)
        at = np.repeat(np.arange(len(self.docs), dtype=np.int32), [len(d[2]) for d in self.docs])
        order = np.argsort(term, kind="stable")
        first = run_starts(term[order])
        row = {
            "docs": [d[0] for d in self.docs],
            "sizes": [d[1] for d in self.docs],
            "terms": term[order][first],
            "df": np.diff(np.append(first, len(term))).astype(np.int32),
            "at": at[order],
            "tf": tf[order],
        }
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(row.values(), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*lists, pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64())], [*row, "n_docs", "n_terms"])


def _shards(numbers: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Builder()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc, text.as_py(), numbers)
                if shard.full():
                    yield shard.batch()
                    shard = _Builder()
        if shard.n_docs:
            yield shard.batch()

    return run


class _List:
    """One term's postings in a shard: documents, contributions without the
    term's weight, and for each range its first posting and its largest
    contribution."""

    def __init__(self, at: np.ndarray, part: np.ndarray, edges: np.ndarray) -> None:
        self.at, self.part = at, part
        self.cut = np.searchsorted(at, edges)
        self.most = np.zeros(len(edges) - 1, np.int64)
        some = np.flatnonzero(np.diff(self.cut))
        if len(some):
            self.most[some] = np.maximum.reduceat(part, self.cut[some])


class _Shard:
    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        ids = row["docs"]
        self.n = len(ids) - ids.null_count
        self.ids = ids.slice(0, self.n).to_numpy()
        self.terms, self.at = row["terms"].to_numpy(), row["at"].to_numpy()
        self.start = np.concatenate(([0], np.cumsum(row["df"].to_numpy())))
        tf = row["tf"].to_numpy().astype(np.int64)
        m = 10 + 90 * row["sizes"].to_numpy() * n_docs // n_terms
        self.part = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.at])
        self.edges = np.append(np.arange(0, self.n, RANGE), self.n)
        self.lists: dict[int, _List] = {}

    def list_of(self, k: int) -> _List:
        if k not in self.lists:
            own = slice(self.start[k], self.start[k + 1])
            stop = np.searchsorted(self.at[own], self.n)
            self.lists[k] = _List(self.at[own][:stop], self.part[own][:stop], self.edges)
        return self.lists[k]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids): the ``top`` best of the shard and of ``best``."""
        k = np.searchsorted(self.terms, terms)
        k[k == len(self.terms)] = 0
        here = (self.terms[k] == terms) & (weights > 0) if self.n else np.zeros(len(terms), bool)
        lists = sorted(((self.list_of(i), int(w)) for i, w in zip(k[here].tolist(), weights[here].tolist(), strict=True)), key=lambda x: len(x[0].at))
        if not lists:
            return best
        held = short = 0
        while short < len(lists) and held + len(lists[short][0].at) <= self.n // SHORT:
            held += len(lists[short][0].at)
            short += 1
        iterators = [(x.at, w * x.part, x.cut, w * x.most) for x, w in lists[short:]]
        least = 1  # scores below it are of no use
        if len(best[0]) == top:
            least = max(least, int(best[0][-1]))
        if held:
            at = np.concatenate([x.at for x, _ in lists[:short]])
            part = np.concatenate([w * x.part for x, w in lists[:short]])
            order = np.argsort(at, kind="stable")
            first = run_starts(at[order])
            sums = _List(at[order][first], np.add.reduceat(part[order], first), self.edges)
            if len(first) >= top:
                least = max(least, int(np.partition(sums.part, -top)[-top]))
            iterators.append((sums.at, sums.part, sums.cut, sums.most))
        bound = np.sum([most for *_, most in iterators], axis=0)
        for r in np.flatnonzero(bound >= least).tolist():
            if bound[r] < least:  # it rose meanwhile
                continue
            at, score = self._range(r, iterators, least)
            if len(at):
                best = _best(np.concatenate((best[0], score)), np.concatenate((best[1], self.ids[at])), top)
                if len(best[0]) == top:
                    least = max(least, int(best[0][-1]))
        return best

    def _range(self, r: int, iterators: list[tuple], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a range whose score is ``least`` or more."""
        base, stop = int(self.edges[r]), int(self.edges[r + 1])
        own = sorted(((int(most[r]), at[cut[r] : cut[r + 1]], part[cut[r] : cut[r + 1]]) for at, part, cut, most in iterators if most[r]), key=lambda x: x[0])
        rest, probed = 0, 0  # lists that cannot reach it together
        while probed < len(own) and rest + own[probed][0] < least:
            rest += own[probed][0]
            probed += 1
        sums = np.zeros(stop - base, np.int64)
        for _, at, part in own[probed:]:
            sums[at - base] += part
        found = np.flatnonzero(sums)
        score = sums[found]
        found += base
        for most, at, part in reversed(own[:probed]):
            keep = score + rest >= least
            found, score = found[keep], score[keep]
            rest -= most
            place = np.searchsorted(at, found)
            place[place == len(at)] = 0
            score += np.where(at[place] == found, part[place], 0)
        keep = score >= least
        return found[keep], score[keep]


def _best(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def _search(items: np.ndarray, cut: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none)] * len(items)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].values for name in ("docs", "sizes", "terms", "df", "at", "tf")}
                shard = _Shard(row, n_docs, n_terms)
                for k in range(len(items)):
                    own = slice(cut[k], cut[k + 1])
                    best[k] = shard.search(terms[own], weights[own], best[k], top)
        ids = np.repeat(items, [len(s) for s, _ in best])
        scores, docs = (np.concatenate([none, *x]) for x in zip(*best, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(docs), pa.array(scores)], ["item_id", "doc_id", "score"])

    return run


def weight(n_docs: int, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * df + 1))).cast("long")


def _block(docs: DataFrame, pairs: DataFrame, top: int) -> DataFrame | None:
    """Hits of one block of items, the best of each task."""
    rows = sorted((r["item"], bytes(r["term"])) for r in pairs.collect())
    numbers = {t: i for i, t in enumerate(sorted({t for _, t in rows}))}
    if not rows:
        return None
    index = written(docs.mapInArrow(_shards(numbers), SHARD))
    total = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    if not total[0]:
        return None
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    weights = np.zeros(len(numbers), np.int64)
    for r in df.select("term", weight(total[0], F.col("df")).alias("w")).collect():  # a row for each term of the block
        weights[r["term"]] = r["w"]
    ids = np.array([i for i, _ in rows], np.int64)
    terms = np.array([numbers[t] for _, t in rows], np.int32)
    first = run_starts(ids)
    lists = index.select("docs", "sizes", "terms", "df", "at", "tf")
    return lists.mapInArrow(_search(ids[first], np.append(first, len(ids)), terms, weights[terms], *total, top), HIT)


def search(docs: DataFrame, items: DataFrame, top: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``top`` documents of
    highest score above 0, the highest first."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc"), utf8(text_col).alias("text")).filter("text is not null")
    asked = items.select(F.col(item_col).cast("long").alias("item"), utf8(item_text_col).alias("text")).dropna()
    pairs = written(asked.mapInArrow(_item_terms, "item long, term binary").distinct())
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    hits = spark.createDataFrame([], HIT)
    for block in range(blocks):
        found = _block(given, pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block) if blocks > 1 else pairs, top)
        hits = hits if found is None else hits.unionByName(found)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
