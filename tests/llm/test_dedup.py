"""Line, passage and near-duplicate operators against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import line_dedup, ngram_join, substring_dedup
from behaviorlens.llm.common import connected
from behaviorlens.llm.queries import QUERIES

SPACE = "\t\n\x0b\x0c\r "
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n int, block int, sig string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def corpus(seed=5, n=160):
    """Documents with copies, near copies, shared passages and odd rows."""
    r = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["É", "ß", "x y", "a b"]
    passage = [r.choice(vocab) for _ in range(70)]
    base = [r.choice(vocab) for _ in range(80)]
    rows = []
    for i in range(n):
        kind = r.randrange(6)
        words = [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        if kind == 0:
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocab)
        elif kind == 1:
            at = r.randrange(len(words) + 1)
            words = words[:at] + passage + words[at:]
        elif kind == 2:
            words = words[:3]
        rows.append((i * 7 % n, "".join(w + r.choice([" ", " ", "\n", "\t", " \n\n"]) for w in words), i, 1, "s"))
    rows += [(n, None, 0, 0, None), (n + 1, "", 0, 0, "x"), (n + 2, " \n \t", 0, 0, "x"), (n + 3, "same same " * 80, 0, 0, ""), (n + 4, "same same " * 80, 0, 0, "")]
    rows += [(n + 5, " ".join(f"v{i % 977}" for i in range(30000)), 0, 0, ""), (n + 6, "p " * 3 + " ".join(f"v{i % 977}" for i in range(30000)), 0, 0, "")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def brute_lines(rows, min_docs, keep_first):
    where = {}
    for doc, text, *_ in sorted(rows, key=lambda x: x[0]):
        for pos, line in enumerate((text or "").split("\n")):
            key = lower(line.strip(SPACE))
            if key:
                where.setdefault(key, []).append((doc, pos))
    out = {}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = set()
        for pos, line in enumerate(lines):
            at = where.get(lower(line.strip(SPACE)), [])
            if len({d for d, _ in at}) >= min_docs and not (keep_first and at[0] == (doc, pos)):
                gone.add(pos)
        out[doc] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
@pytest.mark.parametrize("min_docs", [2, 4])
def test_lines(rows, docs, keep_first, min_docs):
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, min_docs=min_docs, keep_first=keep_first))
    assert out.columns[:5] == docs.columns
    got = {r.doc_id: (r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in out.collect()}
    assert got == brute_lines(rows, min_docs, keep_first)


@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_of_texts_with_one_id(spark, keep_first):
    given = [(1, "hot\nA"), (1, "B\nhot"), (1, "B\nhot"), (2, "C\nD\nhot"), (3, None), (None, "hot")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, min_docs=2, keep_first=keep_first)).collect()
    got = sorted((r.doc_id or 0, r.text or "", r["__n_dropped"], r["__kept"]) for r in out)
    first = (1, "hot\nA", 0, "hot\nA") if keep_first else (1, "hot\nA", 1, "A")
    assert got == sorted([(0, "hot", 0, "hot"), (1, "B\nhot", 1, "B"), (1, "B\nhot", 1, "B"), first, (2, "C\nD\nhot", 1, "C\nD"), (3, "", 0, "")])


def test_sets_of_different_size_with_one_id(spark):
    rows = []
    for i in range(12):
        small = [f"s{i}x{j}" for j in range(40)]
        large = [f"l{i}x{j}" for j in range(1500)]
        rows += [(i, " ".join(large)), (i, " ".join(small))][:: 1 if i % 2 else -1]
        rows += [(100 + i, " ".join(small + ["more"])), (200 + i, " ".join(large[:300] + [f"o{i}x{j}" for j in range(1200)]))]
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=8, den=10)
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert all(got[100 + i] == i and got[200 + i] == 200 + i for i in range(12)), got


def test_hot_line_is_cut_into_runs(spark):
    """One line that all documents share, in many more documents than blocks."""
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Hot \nown"), F.col("id").cast("string"), F.lit("\nhot")).alias("text"))
    bitmaps = line_dedup.drop_bitmaps(docs, min_docs=10)
    assert bitmaps.count() == 5000
    assert bitmaps.agg(F.sum("n_dropped")).first()[0] == 9999


def brute_passages(rows, window):
    first = {}
    words = {d: WORD.findall(t or "") for d, t, *_ in rows}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("chunk", [substring_dedup.CHUNK, 300])
def test_passages(rows, docs, chunk, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    for window in (50, 7):
        out = substring_dedup.remove_repeats(docs, window=window).collect()
        got = {r.doc_id: (r.n_words, sum(s["to"] - s["from"] for s in r.spans), r.kept) for r in out}
        assert got == brute_passages(rows, window)


def test_passages_repeated_rows(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text), (1, "b " + text), (2, text), (None, text), (None, None)]
    got = sorted((r.doc_id or 0, r.n_words, len(r.spans)) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, 0), (0, 60, 0), (1, 60, 0), (1, 61, 0), (2, 60, 1)]


def brute_groups(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("frequent", [ngram_join.FREQUENT, 2])
@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10), (1, 8, 10), (1, 5, 10)])
def test_near_duplicates(rows, docs, k, num, den, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, k=k, num=num, den=den, frequent=frequent).collect()}
    want = brute_groups(rows, k, num, den)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_short_sets_against_all_small_sets():
    """Two similar small sets are either equal or both indexed by tokens."""
    for num, den in ((90, 100), (8, 10), (5, 10), (1, 1)):
        short = ngram_join.short_sets(num, den)
        for n in range(1, 200):
            slack = n - ngram_join.CLASSES >= ngram_join.missing(n, num, den) + 1
            partner = n * den // num
            assert slack or partner <= short


def frequent_words(n=300, copies=10):
    """Texts mostly of twelve words, so that every set shares most shingles
    with others, each with a few words of its own; the last are near copies."""
    r = random.Random(11)
    rows = []
    for i in range(n):
        words = [r.choice("the of and to in a is that it on or by".split()) for _ in range(200)]
        for j in range(0, 200, 8):
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    return rows + [(n + i, rows[i][1] + " end") for i in range(copies)]


def test_common_shingles_alone_reach_no_signatures(spark, monkeypatch):
    rows, seen = frequent_words(), []
    real = ngram_join._signatures

    def signatures(tokens, *args):
        seen.append({r.rep for r in tokens.select("rep").distinct().collect()})
        return real(tokens, *args)

    monkeypatch.setattr(ngram_join, "_signatures", signatures)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, num=90, den=100).collect()}
    assert got == brute_groups(rows, 3, 90, 100)
    pairs = {i for i in range(10)} | {300 + i for i in range(10)}
    assert pairs <= seen[0] and len(seen[0]) < 30


def test_texts_of_sets_that_are_compared_are_not_picked_by_a_join(spark, monkeypatch):
    plans = []
    real = ngram_join.connected

    def links(edges, *args):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        return real(edges, *args)

    monkeypatch.setattr(ngram_join, "connected", links)
    ngram_join.near_duplicates(spark.createDataFrame(frequent_words(40, 4), "doc_id long, text string"), k=3, num=90, den=100).collect()
    assert "LeftSemi" not in plans[0]


@pytest.mark.parametrize("num,den", [(90, 100), (8, 10), (5, 10), (3, 10)])
def test_similar_sets_meet_in_their_first_prefixes(spark, num, den):
    """Each pair has tokens of its own, in a random order; none is left out."""
    r = random.Random(num)
    rows, similar = [], set()
    for pair in range(400):
        base = r.sample(range(1000), r.randrange(1, 120))
        drop = r.randrange(0, len(base) // 3 + 1)
        both = [set(base[drop:]) | set(r.sample(range(1000, 2000), r.randrange(0, drop + 2))), set(base[r.randrange(0, drop + 1) :])]
        for side, s in enumerate(both):
            size = len(s)
            rows.append((2 * pair + side, size, [1_000_000 * pair + t for t in sorted(s)[: 2 * ngram_join.missing(size, num, den) + 1 + ngram_join.CLASSES]]))
        a, b = both
        if a and b and den * len(a & b) >= num * len(a | b):
            similar |= {2 * pair, 2 * pair + 1}
    met = {x.id for x in ngram_join._met(spark.createDataFrame(rows, "id long, n long, prefix array<long>"), num, den).collect()}
    assert len(similar) > 20 and similar <= met


def test_shingles_by_frequency():
    """The order is one of all texts, and the sets are those in order of value."""
    import numpy as np

    texts = [b"rare the of and", b"of the of and the rare the of and one", b"x", b""]
    levels = np.zeros(ngram_join.SLOTS, np.uint8)
    words, _ = ngram_join.word_hashes(b"the of and")
    levels[ngram_join.slots(words)] = 200
    plain, ordered = ngram_join.shingles(texts, 3), ngram_join.shingles(texts, 3, levels)
    assert [sorted(s.tolist()) for s in ordered] == [s.tolist() for s in plain]
    common = set(ordered[0].tolist()) & set(ordered[1].tolist())
    assert len(common) == 2 and [t for t in ordered[0].tolist() if t in common] == [t for t in ordered[1].tolist() if t in common]
    assert ordered[0][-1] == ngram_join.shingles([b"the of and"], 3)[0][0]


def test_near_duplicates_repeated_rows(spark):
    rows = [(1, "a b c d"), (1, "x y z"), (2, "A b c d"), (None, "a b c d"), (3, "")]
    got = sorted(((r.doc_id or 0), r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1), (3, 3)]


def test_connected(spark):
    pairs = [(i, i + 1) for i in range(100, 130)] + [(7, 3), (3, 9), (9, 9), (50, 40), (40, 50), (60, 7)]
    got = dict(connected(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect())
    assert got == {i: 100 for i in range(101, 131)} | {7: 3, 9: 3, 60: 3, 50: 40}


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert line_dedup.apply_bitmaps(none, line_dedup.drop_bitmaps(none)).collect() == []
    assert substring_dedup.remove_repeats(none).collect() == []
    assert ngram_join.near_duplicates(none).collect() == []


def test_queries_on_whole_texts(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    lines = brute_lines(rows, 10, False)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: (a, b, sha(c)) for d, (a, b, c) in lines.items()}
    words = brute_passages(rows, 50)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op8_substring_dedup"](spark, str(tmp_path)).collect()}
    assert got == {d: (a, b, sha(c)) for d, (a, b, c) in words.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op7_ngram_join"](spark, str(tmp_path)).collect()}
    assert got == brute_groups(rows, 3, 90, 100)


@pytest.mark.parametrize("parts", [1, 6])
def test_permuted_texts_of_one_id(spark, parts):
    """Rows of one id whose texts hold the same words in another order keep and
    lose their own words, however the rows fall into tasks."""
    words = [f"p{i}" for i in range(60)]
    turned = words[30:] + words[:30]
    other = [f"q{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (5, " ".join(words)), (5, " ".join(turned)), (5, " ".join(other[::-1])), (5, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.doc_id, r.n_words, r.kept) for r in substring_dedup.remove_repeats(docs).collect())
    assert got == sorted([(1, 60, " ".join(words)), (5, 60, ""), (5, 60, " ".join(turned)), (5, 60, " ".join(other[::-1])), (5, 60, " ".join(other))])


def test_groups_grow_with_the_text():
    small, large = (substring_dedup.groups(n << 30, 200) for n in (1, 1000))
    assert small == 400 and large == 32_000
    assert substring_dedup.groups(0, 8) == 16
