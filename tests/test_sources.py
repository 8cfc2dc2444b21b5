"""File sources and sinks round trips."""

import json
import os

import pytest
from pyspark.sql import functions as F

from behaviorlens.operators import activity
from behaviorlens.sources import files, fixtures
from behaviorlens.schema import ACTIVITY_RAW


def test_id_list_exact(spark, tmpdir_path):
    ids = [10333162, 1530101424356347904, 2**62 + 7]
    p = os.path.join(tmpdir_path, "ids.json")
    with open(p, "w") as f:
        f.write(json.dumps(ids, indent=2))
    got = sorted(r["id"] for r in files.read_id_list(spark, p).collect())
    assert got == sorted(ids)


def test_word_lists_and_stance_tokens(spark, tmpdir_path):
    from behaviorlens.operators.stance import stance_tokens

    for name, words in (("top_words_a.txt", ["war", "peace"]), ("top_words_b.txt", ["peace", "..."])):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write("\n".join(words) + "\n")
    w = files.read_word_lists(spark, os.path.join(tmpdir_path, "top_words*"))
    toks = sorted(r["token"] for r in stance_tokens(w).collect())
    assert toks == sorted(["war", "peace", "...", "@user", "httpurl"])


def test_results_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("a", [0.0, 1.5, -2.25e-3], [1.0, 2.0])], "entity string, r array<double>, w array<double>")
    out = os.path.join(tmpdir_path, "res")
    files.write_results(df.withColumnRenamed("entity", "screen_name"), out, fmt="csv")
    back = files.read_results_csv(spark, out).first()
    assert back["r"] == [0.0, 1.5, -2.25e-3] and back["w"] == [1.0, 2.0]


def test_top_words_name():
    assert files.top_words_name("..\\data\\stance\\data_odds_support.csv") == "support"


def _post(**kw):
    base = {f.name: None for f in ACTIVITY_RAW.fields}
    base.update(kw)
    return tuple(base[f.name] for f in ACTIVITY_RAW.fields)


def test_route_posts_and_timeline(spark):
    posts = spark.createDataFrame(
        [
            _post(screen_name="a", id_str=1, created_at="Wed Oct 10 20:19:24 +0000 2018", user_statuses_count=5),
            _post(screen_name="a", id_str=2, created_at="2018-10-10 20:20:00", user_retweeted="b", retweet_id_str=9),
            _post(screen_name="x", id_str=3, created_at="2018-10-10 20:21:00", user_retweeted="a", retweet_id_str=1),
            _post(screen_name="y", id_str=4, created_at="2018-10-10 20:22:00", in_reply_to_screen_name="a", in_reply_to_status_id_str=1),
            _post(screen_name="z", id_str=5, created_at="2018-10-10 20:23:00", mention="a"),
        ],
        ACTIVITY_RAW,
    ).withColumn("stance", F.when(F.col("id_str") == 4, 2))
    tables = files.route_posts(posts, spark.createDataFrame([("a",)], "name string"))
    counts = {k: v.count() for k, v in tables.items()}
    assert counts == {"tw_a": 1, "rt_a": 1, "rp_a": 0, "m_a": 0, "rt_s": 1, "rp_pro_s": 0, "rp_con_s": 1, "m_s": 1}
    tl = activity.build_timeline(tables).orderBy("time").collect()
    assert [r["activity"] for r in tl] == [1, 2, 5, 7, 8]
    assert tl[0]["time"].isoformat() == "2018-10-10T20:19:24"
    assert [r["tweet_id"] for r in tl] == [1, 2, 1, 1, 0]


def test_count_and_word_sinks(spark, tmpdir_path):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "token string, n long")
    out = os.path.join(tmpdir_path, "vocab")
    files.write_counts(counts, out)
    back = spark.read.csv(out).collect()
    assert sorted((r[0], int(r[1])) for r in back) == [("a", 2), ("b", 2), ("c", 5)]
    words = os.path.join(tmpdir_path, "words")
    files.write_words(counts, words, single_file=True)
    assert sorted(r["value"] for r in spark.read.text(words).collect()) == ["a", "b", "c"]


def test_activity_csv_tables(spark, tmpdir_path):
    """Eight role tables as CSV files (multi-line quoted text) read with
    the explicit raw schema give the same timeline as the in-memory tables."""
    from behaviorlens.sources import fixtures

    events = fixtures.table(spark, "/root/testdata/sf0.001", "events")
    tables = fixtures.role_tables_from_events(events)
    base = os.path.join(tmpdir_path, "activity")
    for name, df in tables.items():
        df = df.withColumn("text", F.concat(F.lit('line one, "quoted"\nline two #'), F.col("id_str").cast("string")))
        df.coalesce(1).write.option("header", True).option("escape", '"').csv(
            os.path.join(base, "users", f"df_{name}_users.csv")
        )
    read = files.read_activity_tables(spark, base, "users")
    assert read["tw_a"].where(F.col("text").contains("\nline two")).count() == tables["tw_a"].count()
    got = activity.build_timeline(read)
    want = activity.build_timeline(tables)
    assert got.count() == events.count()
    assert got.exceptAll(want).count() == 0


def test_corpus_and_labelled_readers(spark, tmpdir_path):
    """S3 strips whitespace like Python's str.strip and drops missing texts;
    S4 keeps the two used columns."""
    p = os.path.join(tmpdir_path, "corpus.csv")
    with open(p, "w") as f:
        f.write('id,text_normalized,other\n1,"  peace now\t",x\n2,,y\n3,"\n war \n",z\n')
    texts = sorted(r["text"] for r in files.read_corpus(spark, p).collect())
    assert texts == ["peace now", "war"]
    q = os.path.join(tmpdir_path, "labelled.csv")
    with open(q, "w") as f:
        f.write('labels,text,extra\n1,"a, b",u\n3,c,v\n')
    rows = files.read_labelled_posts(spark, q).collect()
    assert [tuple(r) for r in rows] == [(1, "a, b"), (3, "c")]


def _activity_csv(path, header, rows):
    with open(path, "w") as f:
        f.write("\n".join([",".join(header), *(",".join(r) for r in rows)]) + "\n")


def test_activity_csv_by_name_with_float_text(spark, tmpdir_path):
    """Another column order, an extra column, integers as a data-frame library
    writes them beside missing values."""
    names = ["extra", *reversed(ACTIVITY_RAW.fieldNames())]
    cells = {"screen_name": "a", "created_at": "2020-01-01 00:00:00", "extra": "z"}
    counts = ["77.0", "1.53e+18", "", "nan", " 5 ", "1530101424356347904"]
    p = os.path.join(tmpdir_path, "a.csv")
    _activity_csv(p, names, [[{**cells, "id_str": str(i), "user_statuses_count": c}.get(n, "") for n in names] for i, c in enumerate(counts)])
    df = files.read_activity_csv(spark, p)
    assert df.schema == ACTIVITY_RAW
    got = [(r["screen_name"], r["id_str"], r["user_statuses_count"]) for r in df.orderBy("id_str").collect()]
    assert got == [("a", i, c) for i, c in enumerate([77, 1530000000000000000, None, None, 5, 1530101424356347904])]
    assert files.bad_cells(files.read_text_csv(spark, p)).where("n > 0").count() == 0


def test_activity_csv_rejects(spark, tmpdir_path):
    names = ACTIVITY_RAW.fieldNames()
    p = os.path.join(tmpdir_path, "bad.csv")
    _activity_csv(p, names, [["7.5" if n == "id_str" else "" for n in names], ["many" if n == "retweet_count" else "" for n in names]])
    with pytest.raises(Exception, match="not an integer"):
        files.read_activity_csv(spark, p).collect()
    bad = {r["column"]: r["n"] for r in files.bad_cells(files.read_text_csv(spark, p)).where("n > 0").collect()}
    assert bad == {"id_str": 1, "retweet_count": 1}
    q = os.path.join(tmpdir_path, "lacking.csv")
    _activity_csv(q, names[1:], [])
    with pytest.raises(ValueError, match="screen_name"):
        files.read_activity_csv(spark, q)


def test_corpus_counts_what_it_drops(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "corpus.csv")
    with open(p, "w") as f:
        f.write("id,text_normalized\n1,a\n2,\n3,b\n")
    assert tuple(files.corpus_rows(spark, p).first()) == (3, 1)
    with pytest.raises(ValueError, match="no_such"):
        files.read_corpus(spark, p, column="no_such")


def test_routed_timeline_is_the_union_of_role_tables(spark):
    """A post that plays several roles, for several accounts, in one pass."""
    posts = spark.createDataFrame(
        [
            _post(screen_name="a", id_str=1, created_at="2018-10-10 20:19:24", user_retweeted="b", retweet_id_str=7, mention="a", in_reply_to_screen_name="b", user_statuses_count=3, retweet_count=2),
            _post(screen_name="b", id_str=2, created_at="2018-10-10 20:20:00", user_statuses_count=4),
            _post(screen_name="x", id_str=3, created_at=None, in_reply_to_screen_name="a"),
            _post(screen_name=None, id_str=4, created_at="2018-10-10 20:20:00", mention="x"),
        ],
        ACTIVITY_RAW,
    ).withColumn("stance", F.when(F.col("id_str") == 1, 1))
    accounts = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    one = files.routed_timeline(posts, accounts)
    each = activity.build_timeline(files.route_posts(posts, accounts))
    assert one.columns == each.columns and one.count() == 7
    assert one.exceptAll(each).count() == 0 and each.exceptAll(one).count() == 0


def test_times_do_not_depend_on_the_session_zone(spark):
    """Across the change to winter time: order and values are those in UTC."""
    texts = ["2018-10-28 00:30:00+00:00", "2018-10-28T01:10:00Z", "Sun Oct 28 01:20:00 +0000 2018", "2018-10-28 02:30:00", "2018-10-28 03:30:00 +0100", "2018-10-28", "when", None]
    want = ["2018-10-28 00:30:00", "2018-10-28 01:10:00", "2018-10-28 01:20:00", "2018-10-28 02:30:00", "2018-10-28 02:30:00", "2018-10-28 00:00:00", None, None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, created_at string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Europe/Zurich", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            out = df.select("i", activity.parse_time("created_at").cast("string").alias("t"), activity.parse_time("created_at", "Europe/Zurich").cast("string").alias("z"))
            rows = out.orderBy("i").collect()
            assert [r["t"] for r in rows] == want, zone
            assert [r["z"] for r in rows][:6] == [*want[:3], "2018-10-28 00:30:00", want[4], "2018-10-27 22:00:00"], zone
            instant = spark.range(1).select(F.timestamp_micros(F.lit(1540685400000000)).alias("time"))
            assert instant.select(activity.utc_time(instant, "time").cast("string")).first()[0] == "2018-10-28 00:10:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(activity.unparsed_times(df).first()) == (1, 7)


def test_time_forms(spark):
    """Each form by the first that reads it, in UTC."""
    import datetime as dt

    from behaviorlens.operators import activity

    t = dt.datetime
    cases = [
        ("2020-01-02 03:04:05.123456", "iso", t(2020, 1, 2, 3, 4, 5, 123456)),
        ("2020-01-02T03:04:05Z", "iso", t(2020, 1, 2, 3, 4, 5)),
        ("2020-01-02 03:04:05+02:00", "iso", t(2020, 1, 2, 1, 4, 5)),
        ("Thu Jan 02 03:04:05 +0100 2020", "classic", t(2020, 1, 2, 2, 4, 5)),
        ("Thu, 2 Jan 2020 03:04:05 +0100", "mail", t(2020, 1, 2, 2, 4, 5)),
        ("2 Jan 2020 03:04 -0500", "mail", t(2020, 1, 2, 8, 4)),
        ("Thu, 02 Jan 2020 03:04:05 GMT", "mail", t(2020, 1, 2, 3, 4, 5)),
        ("Thu, 2 Jan 2020 03:04:05 PDT", "mail", t(2020, 1, 2, 10, 4, 5)),
        ("1/2/2020 3:04", "slashed", t(2020, 1, 2, 3, 4)),
        ("12/31/2020 11:59:58 PM", "slashed", t(2020, 12, 31, 23, 59, 58)),
        ("01/02/2020", "slashed", t(2020, 1, 2)),
        ("1577934245", "epoch", t(2020, 1, 2, 3, 4, 5)),
        ("1577934245123", "epoch", t(2020, 1, 2, 3, 4, 5, 123000)),
        ("1577934245123456", "epoch", t(2020, 1, 2, 3, 4, 5, 123456)),
        ("13/13/2020", None, None),
        ("Thu, 32 Jan 2020 03:04:05 GMT", None, None),
        ("Thu, 2 Jan 2020 03:04:05 XYZ", None, None),
        ("soon", None, None),
        ("", None, None),
        (None, None, None),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _, _) in enumerate(cases)], "i int, created_at string")
    got = {r["i"]: r for r in df.select("i", activity.time_format("created_at").alias("f"), activity.parse_time("created_at").alias("t")).collect()}
    for i, (text, form, time) in enumerate(cases):
        assert (got[i]["f"], got[i]["t"]) == (form, time), text
    counts = {r["format"]: r["n"] for r in activity.time_formats(df).collect()}
    assert counts["mail"] == 4 and counts[None] == 5
    local = df.select(activity.parse_time("created_at", "Europe/Berlin").alias("t")).collect()
    assert local[8]["t"] == t(2020, 1, 2, 2, 4) and local[6]["t"] == t(2020, 1, 2, 3, 4, 5)


def test_stance_by_score(spark):
    """Replies take the stance of their score, in one pass with routing."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    posts = fixtures.posts_from_events(e)
    replies = posts.where("in_reply_to_screen_name IS NOT NULL")
    scores = replies.select("id_str", F.when(F.col("id_str") % 3 == 0, 0.9).when(F.col("id_str") % 3 == 1, 0.5).alias("stance_propaganda"))
    scores = scores.where("stance_propaganda IS NOT NULL").unionByName(scores.limit(0)).unionByName(spark.createDataFrame([(None, 0.9)], "id_str long, stance_propaganda double"))
    out = files.stance_by_score(posts, scores)
    assert sorted(out.columns) == sorted(posts.columns) and out.count() == posts.count()
    got = {(r["id_str"] % 3, r["stance"]) for r in out.where("in_reply_to_screen_name IS NOT NULL").select("id_str", "stance").collect()}
    assert got == {(0, 1), (1, 2), (2, None)}
    assert out.where("in_reply_to_screen_name IS NULL AND stance IS NOT NULL").count() == 0
