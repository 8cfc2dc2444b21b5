"""Ranked search, spelling variants and WARC archives against brute force."""

import base64
import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import lexical_search, spelling, warc

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- ranked search ---------------------------------------------------------


def ranked(docs, items, top):
    """Scores of every document by the definition."""
    held = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            asked[item] |= set(TERM.findall(text.translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        found = []
        for d, c, n in held:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0 and d is not None:
                found.append((-score, d))
        out |= {(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:top], 1)}
    return out


def search_rows(seed, n):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "é", "ß1", "A", "a", "日本"]
    odds = [1 / (i + 1) for i in range(len(vocab))]
    return [(i, r.choice([" ", ", ", "\n"]).join(r.choices(vocab, odds, k=r.randrange(0, 30)))) for i in range(n)]


def test_search_against_definition(spark):
    docs = search_rows(1, 700)
    docs += [(900, None), (901, ""), (902, "--- !"), (None, "w1 w2 w3 rare"), (3, docs[3][1]), (5, "w39 w38 w37"), (5, "w39 w38 w37")]
    docs += [(1000 + i, "same text here") for i in range(25)]
    docs += [(2000, "long " * 300_000 + "w39"), (2001, "x" * 3_000_000)]
    items = [(1, "W1 w2, w2 w30"), (2, "same text"), (3, ""), (4, None), (None, "w1"), (5, "rare nowhere"), (6, "w39"), (6, "É w38"), (7, "nowhere"), (8, "日本 long"), (9, "x" * 3_000_000)]
    items += [(i, " ".join(random.Random(i).sample([f"w{k}" for k in range(40)], 12))) for i in range(20, 30)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "a.b": F.lit(1), "item_id": F.lit(7)}).repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).repartition(2)
    want = ranked(docs, items, 10)
    got = [tuple(r) for r in lexical_search.search(table, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r[0] for r in got} >= {1, 2, 6, 8, 9} and not {r[0] for r in got} & {3, 4, 5, 7}
    in_blocks = lexical_search.search(table, bench, top=3, block_terms=20)
    assert {tuple(r) for r in in_blocks.collect()} == ranked(docs, items, 3)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.select("doc_id", F.lit(None).cast("string").alias("text")), items)):
        out = lexical_search.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


@pytest.mark.parametrize("short", [1, 4, 1000])
@pytest.mark.parametrize("width", [2, 7, 512])
def test_skipping_loses_nothing(monkeypatch, short, width):
    """Any cut between accumulators and lists, and any range, give the same."""
    monkeypatch.setattr(lexical_search, "SHORT", short)
    monkeypatch.setattr(lexical_search, "RANGE", width)
    docs = [(d, t) for d, t in search_rows(7, 150) if TERM.search(t)]
    numbers = {t.encode(): i for i, t in enumerate(sorted({t for _, x in docs for t in TERM.findall(x.translate(LOWER))}))}
    builder = lexical_search._Builder()
    for d, t in docs:
        builder.add(d, t.encode(), numbers)
    n_docs, n_terms = builder.n_docs, builder.n_terms
    batch = builder.batch()
    shard = lexical_search._Shard({c: batch.column(c)[0].values for c in ("docs", "sizes", "terms", "df", "at", "tf")}, n_docs, n_terms)
    df = Counter(t for _, x in docs for t in set(TERM.findall(x.translate(LOWER))))
    none = np.zeros(0, np.int64)
    for seed in range(40):
        terms = random.Random(seed).sample(sorted(numbers), 1 + seed % 9)
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t.decode()] + 1))) for t in terms]
        score, ids = shard.search(np.array([numbers[t] for t in terms], np.int32), np.array(w), (none, none), 5)
        want = ranked(docs, [(0, " ".join(t.decode() for t in terms))], 5)
        assert {(0, k, d, s) for k, (s, d) in enumerate(zip(score.tolist(), ids.tolist()), 1)} == want


# --- spelling variants -----------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs, least, often, ratio):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{d}:{run}".encode()) if d is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= often}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None))
    return out


def spelling_docs():
    r = random.Random(3)
    base = ["abcdefg", "abcdefgh", "zbcdefgh", "élanvital", "straßenbahn", "mississippi", "aaaaaaaa", "aaaaaaaaa", "bananasplit", "×÷×÷×÷×÷"]
    words = list(base)
    for w in base:
        for _ in range(60):
            i = r.randrange(len(w) + 1)
            kind = r.randrange(3)
            words.append(w[:i] + r.choice("abxé") + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + r.choice("abxÉ") + w[i + 1 :])
    rows = [(k, " ".join(r.choices(words, [60] * len(base) + [1] * (len(words) - len(base)), k=120)).title() if k % 3 else ", ".join(r.choices(words, k=90))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "1 2 ü"), (None, "abcdefg Abcdefg abcdefx"), (7, rows[7][1]), (103, "chained! chainedd chainedd " + "chaineddd " * 25 + "chainedddd " * 300), (104, "chained " + "q" * 1_500_000 + " " + "q" * 1_500_000)]
    return rows


@pytest.mark.parametrize("hot_list", [3, 20_000])
def test_variants_against_all_pairs(spark, hot_list):
    rows = spelling_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "a.b": F.lit(1), "n": F.lit("n")}).repartition(5)
    want = variants(rows, 7, 2, 10)
    got = [tuple(r) for r in spelling.variants(docs, hot_list=hot_list).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms
    short = [tuple(r) for r in spelling.variants(docs, min_chars=1, min_count=1, ratio=3, hot_list=hot_list).collect()]
    assert set(short) == variants(rows, 1, 1, 3)


@pytest.mark.parametrize("width", [1, 3, 1 << 20])
@pytest.mark.parametrize("least", [1, 2, 4])
def test_runs_of_sliced_texts(monkeypatch, width, least):
    monkeypatch.setattr(spelling, "SLICE", width)
    r = random.Random(11)
    for _ in range(200):
        text = "".join(r.choice("abZÄäßÿŸ×İſK 1\n-é中😀\u0301") for _ in range(r.randrange(60)))
        want = Counter(w.translate(LOWER) for w in re.findall("[A-Za-zÀ-ÿ]+", text) if len(w) >= least)
        assert spelling.runs_of(text.encode(), least) == want


@pytest.mark.parametrize("letters", ["a", "ab", "abé", "aàÿz×÷bc"])
@pytest.mark.parametrize("size", [1, 2, 3, 5, 8])
def test_scan_against_all_pairs(letters, size):
    r = random.Random(9)
    for n in (0, 1, 2, 30, 120):
        words = sorted({"".join(r.choice(letters) for _ in range(r.choice([size, size, size + 1]))) for _ in range(n)})
        got = [frozenset((words[i], words[j])) for i, j in spelling.scan(words, size, lambda a, b: True)]
        assert len(got) == len(set(got))
        assert set(got) == {frozenset((a, b)) for a in words for b in words if len(a) == size and len(b) in (size, size + 1) and one_edit(a, b)}


def test_variants_of_an_empty_table(spark):
    out = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


# --- WARC ------------------------------------------------------------------


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def told(rows, least=0):
    """What comes back, by the definition."""
    first = {}
    for page, html, _ in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, html, _ in rows:
        data = (html or "").encode()
        again = page is not None and data in first and first[data] < page
        out.append((page, len(data), sha(data), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


def embedded(n):
    """A payload that holds whole records."""
    block = "HTTP/1.1 200 OK\r\n\r\n" + "x" * n
    return "before" + f"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: 77\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n" * 3 + "WARC/1.1\r\n" + "WARC/1." * 5


def page_rows():
    rows = [(i, f"<p>page {i % 9}</p>" + "é" * (i % 9), f"http://h/{i}") for i in range(60)]
    rows += [(100 + i, embedded(i * 37), "u") for i in range(12)] + [(200, embedded(37), "u"), (201, None, None), (202, "", "u\r\nX: y"), (203, "WARC/1.1\r\n", "WARC/1.1"), (204, "\r\n\r\n" * 9, "")]
    rows += [(205, "long\r\n" * 200_000 + embedded(5), "u"), (None, "<p>page 1</p>é", "u"), (None, "alone", None), (3, "<p>page 3</p>ééé", "u"), (206, "z WARC/1.", "u")]
    return rows


PAGES = "page_id long, html string, url string"


@pytest.fixture(scope="module")
def archives(spark):
    path = tempfile.mkdtemp(prefix="bl-warc-") + "/a"
    pages = spark.createDataFrame(page_rows(), PAGES).withColumns({"value": F.lit(1), "digest": F.lit("d"), "a.b": F.lit(1)}).repartition(3)
    warc.write_archives(pages, path, file_records=20)
    return path


@pytest.mark.parametrize("split", [60_000, 1 << 27])
def test_archives_read_back_at_any_split(spark, archives, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = warc.resolved(warc.read_archives(spark, archives)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((tuple(r) for r in got), key=repr) == told(page_rows())


def test_splits_of_a_few_bytes(spark):
    rows = [(1, embedded(3), "u")] + [(9, "WARC/1.", "u"), (10, "", None)]
    path = tempfile.mkdtemp(prefix="bl-warc-") + "/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), path)
    whole = warc.read_archives(spark, path, payloads=True).orderBy("file", "at").collect()
    assert [r["at"] for r in whole][0] == 0 and all(r["intact"] for r in whole)
    assert {r["page_id"]: r["payload"].decode() for r in whole} == {p: h for p, h, _ in rows}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (61,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            again = warc.read_archives(spark, path).select("at", "digest", "page_id").orderBy("at").collect()
            assert [tuple(r) for r in again] == [(r["at"], r["digest"], r["page_id"]) for r in whole], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_smaller_payloads_are_all_responses(spark):
    rows = [(1, "abc", "u"), (2, "abc", "u"), (3, "abcd", "u"), (4, "abcd", "u")]
    path = tempfile.mkdtemp(prefix="bl-warc-") + "/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES), path, min_bytes=4)
    assert sorted((tuple(r) for r in warc.resolved(warc.read_archives(spark, path)).collect()), key=repr) == told(rows, 4)


def test_broken_archive(spark):
    """Garbage ends the chain: what follows it is not believed."""
    block = "HTTP/1.1 200 OK\r\n\r\nabc"
    record = f"WARC/1.0\r\nWARC-Type: response\r\nPage-Id: %d\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"
    path = tempfile.mkdtemp(prefix="bl-warc-")
    with open(f"{path}/x.warc", "w", newline="") as f:
        f.write(record % 1 + record % 2 + "junk" + record % 3)
    with open(f"{path}/y.warc", "w", newline="") as f:
        f.write((record % 4 + record % 5)[:-6])
    got = sorted((r["page_id"], r["intact"], r["n"]) for r in warc.read_archives(spark, path).collect())
    assert got == [(1, True, 3), (2, False, 3), (4, True, 3), (5, False, 1)]


def test_no_pages(spark):
    path = tempfile.mkdtemp(prefix="bl-warc-") + "/a"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.resolved(warc.read_archives(spark, path)).count() == 0
