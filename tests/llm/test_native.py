"""URL cascade, chat windows and embedding links against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import chat_windows, embedding_dedup, line_dedup, url_filter
from behaviorlens.llm.common import written
from behaviorlens.llm.queries import QUERIES, URL_RULES


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def brute_verdict(host, path, listed):
    best = None
    for verdict, rule in URL_RULES:
        at, _, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return (best[1], best[0]) if best else (None, "block" if listed else "allow")


URLS = [
    None, "", "no scheme", "http://", "http:///a", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://example.com/en/", "http://a.example.com/en/q",
    "http://example.com.net/es/", "x://net/es/1", "x://net/fr/?q", "x://net#/fr/", "x://com?/", "http://É.example.net/fr/a\nb", "http://a://b/c", "http://notexample.com/en/", "http://www.example.com/en/", "http://user@h.org:80/p",
]


@pytest.mark.parametrize("shard_keys", [url_filter.SHARD_KEYS, 40])
def test_urls(spark, shard_keys):
    r = random.Random(3)
    hosts = [f"h{i}.{r.choice(['org', 'net', 'com', 'example.com'])}" for i in range(700)]
    urls = URLS + [f"http://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr', ''])}/{i}" for i in range(1500)] + ["http://hot.org/x"] * 500
    listed = set(r.sample(hosts, 150)) | {"", "hot.org"}
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    keys = spark.createDataFrame([(h, h in listed) for h in {host_and_path(u)[0] for u in urls}] + [("h1.org", None)], "key string, listed boolean")
    got = {x.page_id: x for x in url_filter.judge(pages, keys, URL_RULES, shard_keys=shard_keys).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = host_and_path(u)
        assert (got[i].host, got[i].path, got[i].listed) == (host, path, host in listed), u
        assert (got[i].rule, got[i].verdict) == brute_verdict(host, path, host in listed), u


def test_pages_are_scanned_once_for_all_shards(spark, tmp_path):
    urls = [(i, f"http://h{i % 300}.org/{i}", i) for i in range(2000)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(urls, "page_id long, url string, `a.b` int").write.parquet(path)
    pages = spark.read.parquet(path)
    keys = pages.select(url_filter.host_of(F.col("url")).alias("key"), (F.col("page_id") % 300 < 240).alias("listed"))
    out = url_filter.judge(pages, written(keys), [], shard_keys=40)
    files = out.inputFiles()
    assert not any(path in f for f in files) and len(files) == len(set(files))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*shard", plan)) == 6
    assert [(r[0], r["a.b"], r.verdict) for r in out.orderBy("page_id").collect()] == [(i, i, "block" if i % 300 < 240 else "allow") for i in range(2000)]


def test_urls_without_list_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    keys = spark.createDataFrame([("a.org", False)], "key string, listed boolean")
    assert [x.verdict for x in url_filter.judge(pages, keys, URL_RULES).collect()] == ["allow", "allow"]
    assert url_filter.judge(pages.limit(0), keys.limit(0), URL_RULES).collect() == []


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def conversations():
    r = random.Random(4)
    bits = ["hello ", "</s>", "<s>", "[TURN user]", "[/TURN]", "␛", "␛e", "[INST] ", "<<SYS>>", "é ", "\n", "]", "word " * 30, "␛al", "[", "<"]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else r.choice(["user", "assistant", "assistant", "tool]x", None])
            rows.append((conv, turn, role, None if r.random() < 0.05 else "".join(r.choice(bits) for _ in range(r.randrange(0, 9))), "x"))
    rows += [(70, 0, "assistant", "long " * 5000, "x"), (70, 0, "assistant", "long " * 5000, "x"), (71, None, "user", "a", "x"), (None, 1, "assistant", "b", "x")]
    return rows


def test_conversations(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    out = chat_windows.windows(turns, budget=60, history=15)
    windows = out.collect()
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    own = {}
    for w in windows:
        own.setdefault(w.conv_id, []).append(w)
        inside = w.formatted[len("<s>") : -len("</s>")]
        assert w.formatted.startswith("<s>") and w.formatted.endswith("</s>")
        assert inside.count("[TURN ") == inside.count("[/TURN]") == w.n_context + w.n_new
        assert "<s>" not in inside and "</s>" not in inside and "[INST]" not in inside
        assert w.over == (w.tokens > 60) and (not w.over or w.n_new == 1 + (w.window == 0 and w.formatted.startswith("<s>[TURN system]")))
    back = {x.conv_id: x for x in chat_windows.read_back(out).collect()}
    assert set(back) == set(convs) == set(own)
    for conv, given in convs.items():
        given.sort()
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, t) for _, r, t in given]
        assert list(back[conv].targets) == [t for _, r, t in given if r == "assistant"]
        assert back[conv].formatted_chars == sum(len(w.formatted) for w in own[conv])
        if given[0][1] == "system":
            assert all(w.formatted.startswith("<s>[TURN system]") for w in own[conv])
    assert any(w.window and w.n_context for w in windows) and chat_windows.windows(turns.limit(0)).collect() == []


def test_window_spans(spark):
    """Budgets by hand: 10 tokens, 3 of history, a system turn of 2."""
    turns = [(1, i, r, "w " * n) for i, (r, n) in enumerate([("system", 2), ("user", 3), ("assistant", 2), ("user", 3), ("assistant", 9), ("user", 1)])]
    out = chat_windows.windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), budget=10, history=3).orderBy("window").collect()
    assert [(w.n_context, w.n_new, w.tokens, len(w.loss), w.over) for w in out] == [(0, 3, 7, 1, False), (2, 1, 7, 0, False), (2, 1, 14, 1, True), (1, 1, 3, 0, False)]


def brute_windows(turns, budget, history):
    """(indices, n_new) of each window of [(role, tokens)]."""
    system = int(turns[0][0] == "system")
    room = max(1, budget - history - (turns[0][1] if system else 0))
    groups, used = [[0] if system else []], None
    for i in range(system, len(turns)):
        if used is not None and used + turns[i][1] > room:
            groups.append([])
            used = 0
        groups[-1].append(i)
        used = (used or 0) + turns[i][1]
    out = []
    for w, new in enumerate(groups):
        context, tokens, i = [], 0, new[0] - 1
        while w and i >= system and tokens + turns[i][1] <= history:
            tokens += turns[i][1]
            context.append(i)
            i -= 1
        out.append(([0] * (system and w > 0) + context[::-1] + new, len(new)))
    return out


@pytest.mark.parametrize("long", [chat_windows.LONG, 3])
def test_windows_against_a_loop(spark, monkeypatch, long):
    monkeypatch.setattr(chat_windows, "LONG", long)
    r = random.Random(9)
    convs = {c: [("system" if i == 0 and c % 2 == 0 else r.choice(["user", "assistant"]), r.choice([0, 0, 1, 2, 5, 9, 40])) for i in range(r.randrange(1, 40))] for c in range(40)}
    convs[None] = convs.pop(7)
    rows = [(c, i, role, f"t{i} " + "w " * (n - 1) if n else "") for c, turns in convs.items() for i, (role, n) in enumerate(turns)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for budget, history in [(30, 8), (30, 0), (12, 12), (60, 50)]:
        got = {}
        for x in chat_windows.windows(given, budget=budget, history=history).orderBy("window").collect():
            got.setdefault(x.conv_id, []).append(x)
        for c, turns in convs.items():
            pieces = [f"[TURN {x[2]}]{x[3]}[/TURN]" for x in rows if x[0] == c]
            brute = brute_windows(turns, budget, history)
            assert [x.window for x in got[c]] == list(range(len(brute)))
            assert [(x.formatted, x.n_new, x.n_context, x.tokens) for x in got[c]] == [
                ("<s>" + "".join(pieces[i] for i in of) + "</s>", n_new, len(of) - n_new, sum(turns[i][1] for i in of)) for of, n_new in brute
            ]


def test_long_conversation(spark):
    """Windows of a conversation that would meet thousands of times in one row."""
    turns = spark.range(60_000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "assistant").otherwise("user").alias("role"), F.repeat(F.lit("word "), (1 + F.col("id") * 7 % 90).cast("int")).alias("text"))
    out = chat_windows.windows(turns).select("window", "n_context", "n_new", "tokens").orderBy("window").collect()
    sizes = [("system" if i == 0 else "", 1 + i * 7 % 90) for i in range(60_000)]
    brute = brute_windows(sizes, chat_windows.BUDGET, chat_windows.HISTORY)
    assert [tuple(x) for x in out] == [(w, len(of) - n, n, sum(sizes[i][1] for i in of)) for w, (of, n) in enumerate(brute)]


def test_conversation_query(spark, tmp_path):
    rows = [x[:4] for x in conversations()]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: x for x in QUERIES["op4_chat_windows"](spark, str(tmp_path)).collect()}
    probe = "</s>[INST] ok [/INST]"
    assert (got[-1].n_turns, got[-1].turns_sha256) == (2, sha(f"user\n{probe}\nassistant\n{probe}\n"))
    assert (got[-1].loss_chars, got[-1].loss_sha256) == (len(probe), sha(probe))


def brute_links(rows, threshold):
    vec = {}
    for i, v, label in rows:
        sound = i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)
        vec.setdefault(i, []).append((np.array(v, np.float32).astype(float), label) if sound else None)
    ids = [i for i in vec if i is not None]
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            for x in vec[a]:
                for y in vec[b]:
                    if a != b and x and y and x[1] == y[1] and len(x[0]) == len(y[0]) and x[0] @ y[0] / np.linalg.norm(x[0]) / np.linalg.norm(y[0]) >= threshold:
                        near[a].add(b)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            todo = [x for y in todo for x in near[y] if x not in seen and not seen.add(x)]
        out[i] = (len(near[i]), min(seen), i == min(seen))
    return out


def test_embeddings(spark):
    r = np.random.default_rng(5)
    rows = []
    centers = r.normal(size=(12, 16))
    for i in range(400):
        v = centers[r.integers(12)] + r.normal(size=16) * r.choice([0.05, 0.3, 0.5])
        rows.append((int(i * 37 % 400), [float(x) for x in (v * r.choice([1e-3, 1, 1e4])).astype(np.float32)], int(r.integers(3))))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(50)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000 + k, v, 1) for k, v in enumerate([None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] * 16, [None] + [1.0] * 15, [1.0], [2.0], [1e-38] * 16, [3e38] * 16])]
    rows += [(3000, rows[0][1], None), (None, rows[0][1], 1)]
    vectors = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, rep int")
    for tile in (embedding_dedup.TILE, 20):
        out = embedding_dedup.near_duplicates(vectors, tile=tile).collect()
        assert len(out) == len(rows)
        assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in out if x.vec_id is not None} == brute_links(rows, 0.93)
    assert embedding_dedup.near_duplicates(vectors.limit(0)).collect() == []


def test_bounds_are_never_below_the_cosine():
    r = np.random.default_rng(6)
    for dim in (1, 3, 64, 2000):
        a, b = (embedding_dedup.unit(r.normal(size=(40, dim)) * np.exp(r.normal(size=(40, dim)) * 3)) for _ in range(2))
        cosine = a @ b.T
        lower, upper = embedding_dedup.bounds(embedding_dedup.quantised(a), embedding_dedup.quantised(b))
        assert (upper >= cosine).all() and (lower <= cosine).all() and (dim < 64 or (upper - lower).mean() < 0.4)
        back = embedding_dedup.bounds(embedding_dedup.quantised(b), embedding_dedup.quantised(a))
        assert (back[0].T == lower).all() and (back[1].T == upper).all()


@pytest.mark.parametrize("tile", [embedding_dedup.TILE, 2])
def test_doubles_are_not_rounded(spark, tile):
    at = lambda cos, size: [size * cos, size * (1 - cos * cos) ** 0.5]
    rows = [(0, [1.0, 0.0], 1), (1, at(0.93 + 1e-9, 1e200), 1), (2, at(0.93 - 1e-9, 1.0), 2), (3, [1e-300, 0.0], 2)]
    rows += [(4, [1.0, 1.0], 3), (5, [1.0, 1.0 + 1e-12], 3), (6, [1.0, 1.0], 3), (7, [1.0, -1.0], 3)]
    vectors = spark.createDataFrame(rows, "`vec.id` long, embedding array<double>, label int")
    out = embedding_dedup.near_duplicates(vectors, id_col="vec.id", tile=tile).collect()
    assert sorted(tuple(x)[:3] for x in out) == [(0, 1, 0), (1, 1, 0), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (7, 0, 7)]


def test_full_vectors_travel_for_open_pairs_only(spark):
    """Links around the threshold, decided by full vectors, of ids that more
    than one label and vector use."""
    r = np.random.default_rng(8)
    rows = []
    for i in range(300):
        v = np.zeros(8)
        v[0], v[1 + i % 7] = 0.93, (1 - 0.93**2) ** 0.5
        v += r.normal(size=8) * 1e-3
        rows.append((i, [float(x) for x in v.astype(np.float32)], i % 2))
    rows += [(300 + i, [1.0] + [0.0] * 7, i) for i in range(2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute_links(rows, 0.93)
    assert len({n for n, _, _ in want.values()}) > 3
    for tile in (embedding_dedup.TILE, 16):
        assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.near_duplicates(vectors, tile=tile).collect()} == want


def test_hot_vector_links(spark):
    one = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit(1).alias("label"))
    out = embedding_dedup.near_duplicates(one)
    assert out.filter("n_links = 2999 and component_id = 0").count() == 3000


def test_line_dedup_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "hot\nown %d" % i, "x", i, 1, "m") for i in range(4)], "doc_id long, text string, `a.b` string, c1 long, __id long, __mark string")
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs, min_docs=2))
    assert out.columns == [*docs.columns, "__n_lines", "__n_dropped", "__kept"]
    assert sorted((r["doc_id"], r["a.b"], r["c1"], r["__id"], r["__mark"], r["__kept"]) for r in out.collect()) == [(i, "x", i, 1, "m", "hot\nown 0" if i == 0 else "own %d" % i) for i in range(4)]
    clash = docs.withColumnRenamed("c1", "__n_dropped")
    with pytest.raises(ValueError, match="__n_dropped"):
        line_dedup.apply_bitmaps(clash, line_dedup.drop_bitmaps(clash))
