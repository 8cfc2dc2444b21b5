"""URL verdicts: path rules first, then exact membership by a Bloom cascade.

The list's keys and all other keys of the corpus (its key universe) are known.
Level 1 is a Bloom filter of the listed keys, level 2 one of the other keys
that level 1 passes by mistake, level 3 one of the listed keys that level 2
passes, and so on until nothing is left.  The first level that a key fails
tells its side, so membership is exact for every key of the universe and is
evaluated as a column expression: urls are never joined with the list.

A level is a dense array of 64-bit words built by an OR aggregation and read
as a scalar subquery.  Its size is bounded: keys are dealt to as many shards
as keep ``shard_keys`` listed keys in each, and every shard has a cascade of its
own.  With several shards the parsed urls are stored once, partitioned by
shard, so that ``pages`` is scanned once and each branch of the union reads its
own partition.

Everything is DataFrame functions.

Defined results: a NULL url and one without ``://`` have an empty host and
path; the empty host is a key like any other; a key listed in one row and not
in another is listed; a NULL list flag is not listed.  Repeated urls get one
row each; a url may be of any length.  Of rules that fit the longest wins, of
equally long ones the last in code-point order.  Empty tables give empty ones.
Other columns pass through whatever their names, but for those named like an
added one, which it replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written, written_by
from .line_dedup import LOWER, UPPER

#: Listed keys that one cascade takes; its first level is then below 64 MB.
SHARD_KEYS = 8_000_000
#: Hash functions of the levels after the first: 1 in 16 passes by mistake.
HASHES = 4
CHUNK_WORDS = 1024
#: Bits for each key of a filter without a cascade, and its words at most.
KEY_BITS, FILTER_WORDS = 12, 4_000_000

Rule = tuple[str, str]
ADDED = ("host", "path", "rule", "listed", "verdict")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_rule(host: Column, path: Column, rules: list[Rule], value: int) -> Column:
    """Item ``value`` (0 verdict, 1 rule) of the longest rule that fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, _, rule_path = rule[1].partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        out = F.when(fits, F.lit(rule[value])).otherwise(out)
    return out


@dataclass
class Level:
    hashes: int
    words: int
    chunks: DataFrame = field(repr=False)


def _bit(key: Column, level: int, k: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.lit(k), key), F.lit(64 * words))


def _one(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def _filter(keys: DataFrame, level: int, hashes: int, words: int) -> DataFrame:
    """(chunk, words) of the Bloom filter of ``keys``; every word is there."""
    bits = keys.select(F.explode(F.array(*[_bit(F.col("key"), level, k, words) for k in range(hashes)])).alias("bit"))
    some = bits.groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(_one(F.col("bit"))).alias("bits"))
    none = keys.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = some.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunk = F.floor(F.col("word") / CHUNK_WORDS).alias("chunk")
    return written(dense.groupBy(chunk).agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")))


def _passes(key: Column, number: int, level: Level) -> Column:
    whole = level.chunks.agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "words"))), lambda x: x["words"]).alias("filter")).scalar()
    tests = []
    for k in range(level.hashes):
        bit = _bit(key, number, k, level.words)
        word = F.floor(bit / 64)
        value = F.get(F.get(whole, F.floor(word / CHUNK_WORDS).cast("int")), (word % CHUNK_WORDS).cast("int"))
        tests.append(value.bitwiseAND(_one(bit)) != 0)
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def among(keys: DataFrame, key: Column) -> Column:
    """True where ``key`` is in the one column of ``keys``, a stored table, and
    for one in 150 of the others (more where the filter is at its largest)."""
    words = min(FILTER_WORDS, max(1, math.ceil(keys.count() * KEY_BITS / 64)))
    return _passes(key.cast(keys.schema[0].dataType), 0, Level(HASHES, words, _filter(keys.toDF("key"), 0, HASHES, words)))


def cascade(keys: DataFrame, n_listed: int, n_other: int) -> list[Level]:
    """Levels for ``keys`` (key, listed), distinct keys."""
    levels: list[Level] = []
    left, todo = keys, n_listed
    while todo:
        number = len(levels)
        # the first level leaves about a quarter as many mistakes as it has keys
        hashes = max(HASHES, math.ceil(math.log2(max(1, 4 * n_other / n_listed)))) if not number else HASHES
        words = max(1, math.ceil(todo * hashes * math.log2(math.e) / 64))
        own = F.col("listed") if number % 2 == 0 else ~F.col("listed")
        levels.append(Level(hashes, words, _filter(left.filter(own), number, hashes, words)))
        left = left.filter(_passes(F.col("key"), number, levels[-1]))
        todo = left.filter(~own).count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, number, levels[number]), out).otherwise(F.lit(number % 2 == 1))
    return out


def judge(pages: DataFrame, keys: DataFrame, rules: list[Rule], url_col: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``pages`` plus (host, path, rule, listed, verdict).  ``keys`` has
    (key, listed): every host of ``pages`` and whether the list has it.
    ``rules`` are (verdict, ``host/path``) pairs; the longest that fits wins,
    else listed hosts are blocked."""
    universe = keys.select(F.coalesce("key", F.lit("")).alias("key"), F.coalesce("listed", F.lit(False)).alias("listed")).groupBy("key").agg(F.max("listed").alias("listed"))
    universe = written(universe)
    shards = max(1, math.ceil(universe.agg(F.count_if("listed")).first()[0] / shard_keys))
    shard = (F.pmod(F.xxhash64(F.lit("shard"), "key"), F.lit(shards))).cast("int").alias("shard")

    kept = [(i, c) for i, c in enumerate(pages.columns) if c.lower() not in ADDED]
    given = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    url = F.col(f"c{[c.lower() for c in pages.columns].index(url_col.lower())}")
    urls = given.select(*[f"c{i}" for i, _ in kept], host_of(url).alias("key"), path_of(url).alias("path"))
    if shards > 1:
        universe, urls = written_by(universe.select("*", shard), "shard"), written_by(urls.select("*", shard), "shard")
    else:
        universe, urls = universe.withColumn("shard", F.lit(0)), urls.withColumn("shard", F.lit(0))
    counts = {r[0]: (r[1], r[2]) for r in universe.groupBy("shard").agg(F.count_if("listed"), F.count_if(~F.col("listed"))).collect()}

    host, path = F.col("key"), F.col("path")
    rule, verdict = (_longest_rule(host, path, rules, value) for value in (1, 0))
    out = None
    for number in range(shards):
        levels = cascade(universe.filter(F.col("shard") == number).drop("shard"), *counts.get(number, (0, 0)))
        part = urls.filter(F.col("shard") == number).withColumn("listed", member(host, levels))
        listed = F.when(F.col("listed"), "block").otherwise("allow")
        part = part.select(*[f"c{i}" for i, _ in kept], host, path, rule, "listed", F.coalesce(verdict, listed))
        out = part if out is None else out.union(part)
    return out.toDF(*[c for _, c in kept], *ADDED)
