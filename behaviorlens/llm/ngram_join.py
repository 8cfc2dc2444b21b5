"""Near-duplicate groups by Jaccard similarity of word n-gram sets.

Sets are compared exactly, through a prefix filter with token classes.
Tokens (64-bit shingle hashes) are ordered by the frequency of their words, rare
ones first, then by value; word frequencies come from a table of fixed size, and
any order gives the same groups.  Two sets of similarity
``num / den`` can each miss at most ``e = n - ceil(num * n / den)`` of their
own tokens in the other, so ``e + 1`` tokens of a prefix suffice to meet on a
single token.  Tokens that occur in more than ``frequent`` prefixes fall into
one of ``CLASSES`` classes by hash and are indexed as two-token combinations
inside their class; that costs one token a class, so every prefix is extended
by ``CLASSES`` tokens: any ``e`` missing tokens still leave one signature
whole.  Sets too short for that are indexed by single tokens as well, and so
are all sets that can match them.

With ``e`` more tokens in every prefix, two similar sets share at least
``e + 1 + CLASSES`` prefix tokens (or ``n - e``, if the set is that short).
Sets with fewer tokens that any other set of a similar size shares are left
out before signatures are made, so a passage or line that many documents have
in common does not bring them together.

Before that, the same is done with a shorter prefix of ``e + l`` tokens, of which
two similar sets share ``l`` of the smaller one at least; ``l`` is 1 and a quarter
of ``e``.  The sets left, and later those to compare, are picked by a Bloom filter
of their ids, so that prefixes and texts of others are read but never shuffled.

Equal sets are folded into their smallest id first.  Each signature points to
the smallest set that has it (its head) and on to the smallest set that the
head meets; sets sent to the same such block are compared in tiles of bounded
size, every tile pair in a task's turn, with sparse intersection counts and
an exact integer test.  A tile pair returns a spanning forest of its links, so
a group of thousands of near copies yields links linear in its size for each
tile and no list of all pairs.  Groups are the connected components.

Defined results: NULL or word-less text has an empty set, is its own group
and links with nothing; a text shorter than ``k`` words is one shingle; rows
with equal ids are one node; a row with a NULL id has a NULL group; a
similarity equal to the threshold links; texts are read whole, of any length; an
empty table gives an empty one.  Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected, forest, mixed, run_starts, utf8, word_hashes, written
from .url_filter import among

CLASSES = 8
#: Prefixes with a token beyond which it is indexed in combinations.
FREQUENT = 256
#: Sets, and tokens of sets, that a tile holds on average.
TILE_SETS, TILE_TOKENS = 64, 500_000
COLUMNS = 4096
#: A set shares one token more of its first prefix for so many it may miss.
SPARE = 4
#: Slots of the table of word frequencies, a power of two.
SLOTS = 65536
STEP = np.uint64(0x9E3779B97F4A7C15)

KEYED = "id long, n long, h1 long, h2 long, prefix array<long>"


def slots(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def shingles(texts: list[bytes], k: int, levels: np.ndarray | None = None) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``k``-word shingles of each text; hashing
    runs over all texts at once.  With ``levels``, that of a word by its slot,
    they are sorted by the sum of their words' levels first."""
    words, at = word_hashes(b"\n".join(texts))
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    starts = np.searchsorted(at, begins)
    sizes = np.diff(starts)
    widths = np.minimum(sizes, k)
    value = np.repeat(widths.astype(np.uint64), sizes)
    for j in range(k):
        ahead = np.concatenate((words[j:], np.zeros(min(j, len(words)), np.uint64)))
        step = mixed(value * STEP + ahead)
        value = step if widths.min() >= k else np.where(np.repeat(widths, sizes) > j, step, value)
    spans = [(a, a + n - w + 1) if n else (0, 0) for a, n, w in zip(starts[:-1].tolist(), sizes.tolist(), widths.tolist(), strict=True)]
    if levels is None:
        return [np.unique(value[a:b]) for a, b in spans]
    level, total = levels[slots(words)].astype(np.int64), np.zeros(len(words), np.int64)
    for j in range(k):
        ahead = np.concatenate((level[j:], np.zeros(min(j, len(words)), np.int64)))
        total += ahead if widths.min() >= k else np.where(np.repeat(widths, sizes) > j, ahead, 0)
    total = np.minimum(total, 65535).astype(np.uint16)
    out = []
    for a, b in spans:
        tokens, first = np.unique(value[a:b], return_index=True)
        out.append(tokens[np.argsort(total[a:b][first], kind="stable")])
    return out


def missing(n: int, num: int, den: int) -> int:
    """Tokens that a set of ``n`` may lack in a similar set."""
    return n + (-num * n // den)


def short_sets(num: int, den: int) -> int:
    """Size up to which sets are indexed by single tokens too: that of any
    partner of a set whose prefix could be spent by the classes alone."""
    least = max((n for n in range(1, 10 * CLASSES * den // num * den) if n - CLASSES < missing(n, num, den) + 1), default=0)
    return least * den // num


#: Bytes of texts that are hashed at once.
BATCH_BYTES = 1_000_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, lower-cased texts) of rows of (id, text), some at a time."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            ids.append(doc)
            texts.append(text.lower() if text is not None else b"")
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, words) of the slots that words of (id, text) fall into."""
    counts = np.zeros(SLOTS, np.int64)
    for _, texts in _batches(batches):
        counts += np.bincount(slots(word_hashes(b"\n".join(texts))[0]), minlength=SLOTS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["slot", "words"])


def word_levels(given: DataFrame) -> np.ndarray:
    """Level of each slot of words in ``given`` (id, text), the higher the more
    frequent: six for each doubling."""
    counts = given.mapInArrow(_counted, "slot long, words long").groupBy("slot").agg(F.sum("words").alias("words")).toPandas()
    levels = np.zeros(SLOTS, np.uint8)
    levels[counts["slot"].to_numpy(np.int64)] = np.minimum(np.rint(6 * np.log2(counts["words"].to_numpy(np.float64) + 1)), 255)
    return levels


def _keyed(k: int, num: int, den: int, levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            sets = shingles(texts, k, levels)
            sizes = np.array([len(s) for s in sets], np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            tokens = np.concatenate(sets)
            marks = []
            for c in (1, 2):
                upto = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(tokens + np.uint64(c)), dtype=np.uint64)))
                marks.append((upto[ends[1:]] - upto[ends[:-1]]).view(np.int64))
            heads = [s[: 2 * missing(len(s), num, den) + 1 + CLASSES].view(np.int64) for s in sets]
            offsets = np.concatenate(([0], np.cumsum([len(h) for h in heads]))).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(heads)))
            columns = [pa.array(ids, pa.int64()), pa.array(sizes), *map(pa.array, marks), prefix]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "h1", "h2", "prefix"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _batches(batches):
            sets = [s.tobytes() for s in shingles(texts, k)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["rep", "tokens"])

    return run


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of sets with Jaccard similarity of at least
    ``num / den``, by exact intersection counts."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    first = run_starts(tokens[order])
    counts = np.diff(np.append(first, len(order)))
    column = np.repeat(np.where(counts > 1, np.cumsum(counts > 1) - 1, -1), counts)
    shared = column >= 0  # tokens of one set alone meet nothing
    row, column = owner[order][shared], column[shared]
    common = np.zeros((len(left), len(right)), np.float64)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for step, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[a:b], column[a:b] - step * COLUMNS] = 1
        common += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    i, j = np.nonzero((den * common >= num * union) & (left[:, None] != right[None, :]))
    return left[i], right[j]


def _verified(num: int, den: int):
    def links(rows: pd.DataFrame) -> list[tuple[int, int]]:
        rows = rows.drop_duplicates(["rep", "tokens"])
        sets = [np.frombuffer(b, np.uint64) for b in rows["tokens"]]
        side = (rows["tile"] == rows["hi"]).to_numpy()
        right = np.flatnonzero(side)
        left = right if rows["lo"].iloc[0] == rows["hi"].iloc[0] else np.flatnonzero(~side)
        reps, own = rows["rep"].to_numpy(), rows["own"].to_numpy(bool)
        if not (own[left].any() or own[right].any()):
            return []  # of the band below: they meet there
        roots = forest(len(reps), [similar(sets, left, right, num, den)]) if len(left) and len(right) else range(len(reps))
        return [(int(reps[i]), int(reps[r])) for i, r in enumerate(roots) if i != r]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # rows of the last key, which the next batch may go on with
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = rows[["block", "band", "lo", "hi"]].to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
            found = [x for a, b in zip(starts[:-1], starts[1:], strict=True) for x in links(rows.iloc[a:b])]
            rest = rows.iloc[starts[-1] :]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        if rest is not None:
            yield pd.DataFrame(links(rest), columns=["a", "b"], dtype="int64")

    return run


def _met(reps: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct ids of sets that share as many tokens of a first prefix with
    others as they share with any similar set."""

    def spare(n: Column) -> Column:
        return n - F.ceil(n * num / den)

    def least(n: Column) -> Column:
        return F.floor(spare(n) / SPARE) + 1

    tokens = reps.select("id", least(F.ceil(F.col("n") * num / den)).cast("int").alias("need"), F.explode(F.slice("prefix", 1, (spare(F.col("n")) + least(F.col("n"))).cast("int"))).alias("token"))
    common = written(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1").select("token"))
    have = tokens.join(common, "token").groupBy("id", "need").agg(F.count("*").alias("have"))
    return written(have.filter("have >= need").select("id").distinct())


def _representatives(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, n, prefix) of the rows of ``keyed`` that have the smallest id of
    their class.  Only rows that can be in a class with others are joined."""
    several = classes.filter("members > 1")
    equal = among(written(keyed.join(several, ["h1", "h2"]).select("id").distinct()), F.col("id"))
    first = written(keyed.filter(equal).join(classes.select("h1", "h2", F.col("rep").alias("id")), ["id", "h1", "h2"]).select("id", "n", "prefix"))
    return keyed.filter(~equal).select("id", "n", "prefix").unionByName(first)


def _shared(tokens: DataFrame, by: list[str], num: int, den: int) -> DataFrame:
    """``tokens`` that two sets or more have in the same ``by``, with their
    number ``df``, of sets with as many of them as a similar pair shares."""
    again = [c for c in by if c != "token"]
    count = written(tokens.groupBy(*by).agg(F.count("*").alias("df"), F.max("own").alias("own")).filter("df > 1 and own").drop("own"))
    shared = written(tokens.join(count, by).drop(*([] if again else ["df"])))
    similar_size = F.ceil(F.col("n") * num / den)
    need = F.least(similar_size, F.col("n") - similar_size + 1 + CLASSES)
    # by size too: rows with equal ids can have several sets
    enough = written(shared.groupBy("rep", "n", *again).agg(F.count("*").alias("have")).filter(F.col("have") >= need).select("rep", "n", *again))
    return shared.join(enough, ["rep", "n", *again], "left_semi")


def _signatures(tokens: DataFrame, num: int, den: int, frequent: int) -> DataFrame:
    """(sig, band, own, rep): single rare tokens, and pairs of frequent ones
    by class, within a band of sizes.  Similar sets have sizes of the same or
    of neighbouring bands; each set is in its ``own`` band and in the next,
    where it meets that band's own sets only."""
    band = F.floor(F.log("n") / (math.log(den / num) * 1.000001)) if num < den else F.col("n")
    first = _shared(tokens.withColumn("own", F.lit(True)), ["token"], num, den).select("rep", "n", "token", F.explode(F.array(F.lit(0), F.lit(1))).alias("up"))
    banded = first.select("rep", "n", "token", (band + F.col("up")).alias("band"), (F.col("up") == 0).alias("own"))
    shared = written(_shared(banded, ["token", "band"], num, den))
    single = shared.filter((F.col("df") <= frequent) | (F.col("n") <= short_sets(num, den))).select(F.xxhash64("token", "band").alias("sig"), "band", "own", "rep")
    grouped = (
        shared.filter(F.col("df") > frequent)
        .groupBy("rep", "band", "own", F.pmod(F.xxhash64("token"), F.lit(CLASSES)).alias("class"))
        .agg(F.sort_array(F.collect_set("token")).alias("ts"))
    )

    def pairs(ts: Column) -> Column:
        return F.flatten(F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.size(ts)), lambda b: F.xxhash64(F.lit("pair"), a, b, "band"))))

    return single.unionByName(grouped.select(F.explode(pairs(F.col("ts"))).alias("sig"), "band", "own", "rep"))


def _blocks(signatures: DataFrame) -> DataFrame:
    """(block, band, own, rep), distinct: sets with a common signature share a
    block."""
    sig = written(signatures)
    heads = written(sig.groupBy("sig").agg(F.min("rep").alias("head"), F.count("*").alias("c"), F.max("own").alias("own")).filter("c > 1 and own").select("sig", "head"))
    met = written(sig.join(heads, "sig").select("head", "band", "own", "rep").distinct())
    home = written(met.groupBy(F.col("rep").alias("head"), "band").agg(F.min("head").alias("block")))
    blocks = written(met.join(home, ["head", "band"]).select("block", "band", "own", "rep").distinct())
    some = written(blocks.groupBy("block", "band").agg(F.count("*").alias("c"), F.max("own").alias("own")).filter("c > 1 and own").select("block", "band"))
    return written(blocks.join(some, ["block", "band"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 8, den: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``: documents
    whose sets have ``den * intersection >= num * union`` are linked;
    ``component_id`` is the smallest id reachable by links."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    keyed = written(given.mapInArrow(_keyed(k, num, den, word_levels(given)), KEYED))
    sets = keyed.filter("n > 0 and id is not null")
    classes = written(sets.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("members")))
    # equal sizes only reach equal sets, which are one class already
    alone = F.floor(F.col("n") * den / num) == F.col("n")
    reps = _representatives(sets.filter(~alone), classes)
    prefixes = reps.filter(among(_met(reps, num, den), F.col("id")))
    tokens = prefixes.select(F.col("id").alias("rep"), "n", F.explode("prefix").alias("token"))
    blocks = _blocks(_signatures(tokens, num, den, frequent))

    wanted = written(blocks.select("rep").distinct())
    texts = given.filter(F.col("text").isNotNull() & among(wanted, F.col("id"))).mapInArrow(_sets(k), "rep long, tokens binary")
    sized = blocks.join(keyed.select(F.col("id").alias("rep"), "n").distinct(), "rep")
    tiles = written(sized.groupBy("block", "band").agg(F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum("n") / TILE_TOKENS)).cast("int").alias("tiles")))
    member = blocks.join(tiles, ["block", "band"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    other = member.join(texts, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    paired = other.select("block", "band", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "own", "rep", "tokens")
    key = ["block", "band", "lo", "hi"]
    links = paired.repartition(*key).sortWithinPartitions(*key).mapInPandas(_verified(num, den), "a long, b long")

    groups = classes.join(connected(links, "a", "b"), F.col("rep") == F.col("node"), "left")
    named = written(groups.select("h1", "h2", F.coalesce("component", "rep").alias("component_id")))
    joined = keyed.join(named, ["h1", "h2"], "left")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id"))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"))
