"""Text preparation rules."""

from pyspark.sql import functions as F

from behaviorlens.functions import text as T


def one(spark, col_fn, value):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(col_fn(F.col("t")).alias("x")).first()["x"]


def test_decontract_order(spark):
    assert one(spark, T.decontract, "I won’t, can't, isn't, we're, it's, I'd, you'll, they've, I'm") == (
        "I will not, can not, is not, we are, it is, I would, you will, they have, I am"
    )


def test_punctuation_substring_rule(spark):
    toks = one(spark, lambda c: T.remove_punctuations(F.split(c, " ")), "() ./ '' ... ?! ok , #")
    assert toks == ["''", "...", "?!", "ok"]  # two quotes are not a substring


def test_preprocess_drops_placeholders_and_stopwords(spark):
    toks = one(spark, T.preprocess, "The @USER said HTTPURL that we can't stop #Peace... 12.5 e-mail")
    assert toks == ["said", "stop", "#peace", "...", "12.5", "e-mail"]


def test_tokenizer_units(spark):
    toks = one(spark, T.tokenize, "see http://x.org/a?b=1 :) @bob #tag a.b@c.org don't 3.14 ...")
    assert toks == ["see", "http://x.org/a?b=1", ":)", "@bob", "#tag", "a.b@c.org", "don't", "3.14", "..."]


def test_normalize_post(spark):
    out = one(spark, T.normalize_post, "I can’t   believe @bob   posted https://t.co/x at 5 p . m . 🇷 🇺")
    # "n't " is split off and "ca n't" joined back, so "can't" survives
    assert out == "I can't believe @USER posted HTTPURL at 5 p.m. :Russia:"


def test_user_supplied_predictor(spark):
    import numpy as np

    from behaviorlens.operators.stance import author_mean, score_with_predictor

    def make_predict_fn():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([1.0 if "peace" in t else 0.0 for t in texts])

        return predict

    posts = spark.createDataFrame([("a", "peace now"), ("a", "war"), ("b", "peace")], "author_id string, body string")
    got = {r["author_id"]: r["stance_propaganda"] for r in author_mean(score_with_predictor(posts, make_predict_fn)).collect()}
    assert got == {"a": 0.5, "b": 1.0}


def test_emoji_names_map(spark):
    """A one-character token is replaced by its name from a user map."""
    names = F.create_map(F.lit("🙂"), F.lit(":slightly_smiling_face:"))
    df = spark.createDataFrame([("ok 🙂 @bob",)], "t string")
    out = df.select(T.normalize_post(F.col("t"), emoji_names=names).alias("x")).first()["x"]
    assert out == "ok :slightly_smiling_face: @USER"


def test_shipped_emoji_names(spark):
    out = one(spark, T.normalize_post, "🔥 👍 ❤ 😀😂 🙏🏻 ⚠️ © é ? 🇺 🫠 語")
    assert out == ":fire: :thumbs_up: :red_heart: :grinning_face: :face_with_tears_of_joy: :folded_hands: :emoji_modifier_fitzpatrick_type-1-2: :warning: \ufe0f :copyright: é ? 🇺 :melting_face: 語"
    assert len(T.EMOJI_NAMES) > 1300 and all(len(c) == 1 and n[0] == n[-1] == ":" and " " not in n for c, n in T.EMOJI_NAMES.items())


def test_emoji_of_unusual_rows(spark):
    assert one(spark, T.normalize_post, None) is None
    assert one(spark, T.normalize_post, "") == ""


def test_html_entities_decoded_once(spark):
    toks = one(spark, T.tokenize, "salt &amp; pepper &lt;3 &amp;lt;")
    assert toks == ["salt", "&", "pepper", "<3", "&", "lt", ";"]


def test_phone_numbers_one_token(spark):
    toks = one(spark, T.tokenize, "call +1 (555) 123-4567 or 555.1234 now 42")
    assert toks == ["call", "+1 (555) 123-4567", "or", "555.1234", "now", "42"]


def test_random_split_is_seeded_and_complete(spark):
    from behaviorlens.operators.stance import random_split

    df = spark.range(2000)
    train, test = random_split(df, 0.3, seed=7)
    train2, test2 = random_split(df, 0.3, seed=7)
    assert train.count() + test.count() == 2000
    assert 450 < test.count() < 750
    assert sorted(r.id for r in test.collect()) == sorted(r.id for r in test2.collect())


def test_long_runs_are_shortened(spark):
    toks = one(spark, T.tokenize, "no!!!!!!! aaaaa 11111 wow??? ..... 😀😀😀😀😀😀 -----")
    assert toks == ["no", "!", "!", "!", "aaaaa", "11111", "wow", "?", "?", "?", "...", "😀", "😀", "😀", "-", "-", "-"]


# --- tokenizer at any length -------------------------------------------------

# the pattern's parts as they read with group loops, for texts of usual length
GROUP_LOOPS = {
    r"\p{L}[\p{L}'\-_]+\p{L}": r"\p{L}(?:\p{L}|['\-_])+\p{L}",
    rf"\.[{T._WS}.]*\.": rf"\.(?:[{T._WS}]*\.)+",
    "{1,256}>": "+>",
    "{1,64}@": "+@",
    "{1,255}": "+",
}


def group_loops():
    old = T.TOKEN_PATTERN
    for new, was in GROUP_LOOPS.items():
        assert new in old
        old = old.replace(new, was)
    return old


def test_class_loops_read_as_group_loops(spark):
    """Random texts over the symbols that the changed parts tell apart, and the
    given tables, give equal tokens."""
    import random

    r = random.Random(11)
    symbols = list("aZé語_1.-'@+ \t<>#:/,") + [" . ", "a.b@c.d", "..", "don't", "<b>", "www.", "\U0001d400"]
    rows = [("".join(r.choice(symbols) for _ in range(r.randrange(60))),) for _ in range(4000)]
    texts = spark.createDataFrame(rows, "text string")
    texts = texts.unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    texts = texts.unionByName(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("text"))
    assert texts.filter(~T.tokenize(F.col("text")).eqNullSafe(T.tokenize(F.col("text"), group_loops()))).count() == 0


def test_long_words_and_runs_are_read_in_linear_time(spark):
    """What used to end the executor or to take minutes."""
    import time

    n = 100_000
    texts = {
        "letters": "ab" * n,
        "wide": "語文" * n,
        "mixed": "a\U0001d400" * n,
        "quotes": "a'-_" * n,
        "spaced dots": ". \t" * n,
        "dotted": "a." * n,
        "dotted address": "x@" + "a." * n,
        "address": "a.b-" * n + "@x.org",
        "tags": "<a" * n,
        "handles": "@a#b" * n,
        "digits": "0 1-2.3)" * n,
        "entities": "&#38;&amp;" * n,
        "blanks": " \t" * n + "x" + " \t" * n + ". ' " * n,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string").repartition(4)
    start = time.perf_counter()
    got = {r["name"]: (r["n"], r["words"], r["bare"]) for r in df.select("name", F.size(T.tokenize(F.col("text"))).alias("n"), F.size(T.preprocess(F.col("text"), tokenizer=T.tokenize_words)).alias("words"), F.length(T.strip_text(F.col("text"))).alias("bare")).collect()}
    assert time.perf_counter() - start < 60
    assert got["letters"][0] == got["wide"][0] == got["mixed"][0] == got["spaced dots"][0] == 1
    assert got["letters"][1] == 1 and got["blanks"][2] == len(texts["blanks"].strip())


# --- default word tokenizer ----------------------------------------------------

WORDS = [
    ("Good muffins cost $3.88 in New York.  Please buy me two of them.", "Good|muffins|cost|$|3.88|in|New|York.|Please|buy|me|two|of|them|."),
    ("They'll save and invest more.", "They|'ll|save|and|invest|more|."),
    ("hi, my name can't hello,", "hi|,|my|name|ca|n't|hello|,"),
    ('He said "stop" (twice): go!', "He|said|``|stop|''|(|twice|)|:|go|!"),
    ("\"Quoted\" ''old'' 'x' rock 'n roll", "``|Quoted|''|``|old|''|'|x|'|rock|'n|roll"),
    ("I cannot, gonna wanna gimme lemme gotta; d'ye more'n", "I|can|not|,|gon|na|wan|na|gim|me|lem|me|got|ta|;|d|'ye|more|'n"),
    ("'Tis the cat's, dogs' 'twas", "'T|is|the|cat|'s|,|dogs|'|'t|was"),
    ("a--b 50%... [x] {y} <z> a@b #c & 1,000 10:30 a:b *", "a|--|b|50|%|...|[|x|]|{|y|}|<|z|>|a|@|b|#|c|&|1,000|10:30|a|:|b|*"),
    ("«Été» “deux” c'est l'été.", "«|Été|»|“|deux|”|c'est|l'été|."),
    ("it's\nI'm we've he'd DON'T", "it|'s|I|'m|we|'ve|he|'d|DO|N'T"),
    ("end.) ", "end|.|)"),
    ("cannot cannot 'a'b' é'à'", "can|not|can|not|'|a|'|b|'|é|'|à|'"),
    ("", ""),
    ("  \t ", ""),
]


def test_word_tokenizer(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS)], "i int, t string")
    got = {r["i"]: "|".join(r["x"]) for r in df.select("i", T.tokenize_words(F.col("t")).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(WORDS)}
    assert one(spark, T.tokenize_words, None) is None


# --- entities --------------------------------------------------------------------


def test_entities(spark):
    cases = {
        "a &#65;&#x42;&#x63;&#0068;e": "a ABcDe",
        "&#128512; &#x1F600; &#x1f600;": "😀 😀 😀",
        "&eacute;&Eacute;&lt;&nbsp;&copy;": "éÉ< ©",
        "&#38;lt; &amp;#65; &#x26;amp;": "&lt; &#65; &amp;",  # decoded once
        "[&#55296;&#xDFFF;&#1114112;&#xFFFFFFFFF;&#99999999999999999999;]": "[]",
        "&#xD7FF;&#xE000;&#x10FFFF;": "퟿\U0010ffff",
        "&#146;&#x80;|&#129;": "’€|",
        "AT&T; x &unknown; &;": "AT x  &;",
        "a & b && &# 65; &lt &": "a & b && &# 65; &lt &",
        "&#6x5;&#xZZ;&#;&#x;": "",
        "&": "&",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    bad = df.select("t", "want", T.decode_entities(F.col("t")).alias("got")).filter("NOT got <=> want").collect()
    assert bad == []
    assert one(spark, T.decode_entities, None) is None


def test_fast_patterns_give_the_same_tokens(spark):
    """The faster forms against the plain ones, on joined odd pieces."""
    import random

    pieces = ["a", "the", "do", "can", "not", "cannot", "GIMME", "lemme", "'tis", "'Twas", "more'n", "wanna", "d'ye", "d:", "p=", "e@x.org", "a.b@c.org", "x" * 70 + "@c.org", "don't", "re-do", "3.14", "!!!!", "----", "éééé", "😀😀😀😀", "{{{{{", "K", "İ", "ß", "#a", "@b", "http://x.y", "www.z", "\n", "\t", " ", " ", " ", ",", ".", "..", "'", '"', "\x85", " ", "555 1234", "ab_c"]
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 25)))) for i in range(3000)] + [(-1, ""), (-2, None)]
    df = spark.createDataFrame(rows, "i long, t string")
    t = F.col("t")
    assert df.filter(~T.tokenize(t).eqNullSafe(T.tokenize(t, T.TOKEN_PATTERN))).count() == 0
    assert df.filter(~T.shorten_runs(t).eqNullSafe(F.regexp_replace(t, r"([^a-zA-Z0-9])\1{3,}", "$1$1$1"))).count() == 0
    padded = F.concat(F.lit(" "), T._rewrite(t, T.WORD_PASSES), F.lit(" "))
    plain = F.filter(F.split(T._rewrite(padded, T.WORD_PASSES_PADDED), T.SQUEEZE_PATTERN, -1), lambda x: x != "")
    assert df.filter(~T.tokenize_words(t).eqNullSafe(plain)).count() == 0
