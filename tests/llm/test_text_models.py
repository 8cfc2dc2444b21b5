"""Decontamination, quality, pseudonyms and SentencePiece against brute force,
exact round trips and held-out accuracy."""

import datetime
import ipaddress
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from behaviorlens.llm import decontaminate, ordinal, pseudonyms, unigram
from behaviorlens.llm.queries import QUERIES, SENTENCEPIECE_MODEL, rated_documents
from behaviorlens.llm.common import table

SF = "/root/testdata/sf0.01"


def substring_distance(pattern, text):
    """Smallest edit distance of a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    r = random.Random(1)
    for _ in range(150):
        a = "".join(r.choice("abc") for _ in range(r.randrange(1, 90)))
        b = "".join(r.choice("abc") for _ in range(r.randrange(0, 120)))
        distance, end = decontaminate.myers(decontaminate.peq(a), len(a), b)
        assert distance == substring_distance(a, b)
        assert substring_distance(a, b[:end]) == distance


def test_items_within_the_budget(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    items = [" ".join(word() for _ in range(20)) for _ in range(6)] + ["short", None, ""]
    rows = []
    for doc in range(60):
        text = list(" ".join(word() for _ in range(30)))
        copy = list(items[doc % 6])
        for _ in range(r.randrange(0, 14)):
            at = r.randrange(len(copy))
            copy[at : at + 1] = r.choice([[], ["x"], ["y", "z"]])
        at = r.randrange(len(text))
        rows.append((doc, "".join(text[:at] + [" "] + copy + [" "] + text[at:]).replace(" ", r.choice([" ", " \n", ", "])).title(), "s"))
    rows += [(100, None, "s"), (101, "", "s"), (102, "clean text only " * 500, "s"), (None, items[0], "s"), (7, items[1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = set()
    for doc, text, _ in rows:
        for item_id, item in enumerate(items):
            item = decontaminate.folded(item or "")
            if text and len(item) >= decontaminate.MIN_CHARS:
                d = substring_distance(item, decontaminate.folded(text))
                if d <= int(decontaminate.RATE * len(item)):
                    want.add((doc, item_id, d))
    for block in (decontaminate.BLOCK_CHARS, 200):
        got = decontaminate.find_items(docs, bench, block_chars=block).collect()
        assert {(x.doc_id, x.item_id, x.distance) for x in got} == want and len(got) == len(want)
    texts = {d: decontaminate.folded(t or "") for d, t, _ in rows if d != 7}
    for x in got:
        if x.doc_id in texts:
            span = texts[x.doc_id][x.start : x.start + x.length]
            assert substring_distance(decontaminate.folded(items[x.item_id]), span) == x.distance
    assert 10 < len(want) < 65
    none = docs.limit(0)
    assert decontaminate.find_items(none, bench).count() == 0
    assert decontaminate.find_items(docs, bench.limit(0)).count() == 0


def test_items_of_any_length_anywhere(spark):
    """Items of 1 to 100 characters at the start, in the middle and at the end
    of a text, whole or cut at the text's edge within their budget."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("klmnopqr") for _ in range(r.randrange(1, 8)))
    items = {}
    for n in [*range(1, 30), 40, 60, 86, 100]:
        text = word()
        while len(text) < n:
            text += " " + word()
        items[n] = text[:n].strip() or "z"
    rows = []
    for i, item in items.items():
        k = int(decontaminate.RATE * len(item)) if len(item) >= decontaminate.MIN_CHARS else 0
        for cut in {0, min(1, k), k}:
            for text in (item[cut:] + " xx yy", "xx yy " + item[: len(item) - cut], item[cut:], f"xx {item} yy", f"xx{item}yy", f"xx{item} yy", f"{item} {item[cut:]}"):
                rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    want = set()
    for doc, text in rows:
        text = decontaminate.folded(text)
        for i, item in items.items():
            if len(item) < decontaminate.MIN_CHARS:
                if f" {item} " in f" {text} ":
                    want.add((doc, i, 0))
            elif (d := substring_distance(item, text)) <= int(decontaminate.RATE * len(item)):
                want.add((doc, i, d))
    got = [(x.doc_id, x.item_id, x.distance) for x in decontaminate.find_items(docs, bench).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {i for _, i, _ in want} == set(items)


def test_a_very_long_text_and_item_copies_side_by_side(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    near = item.replace("quick", "quack").replace("lazy", "lasy")
    texts = [(1, "w" * 2_000_000), (2, "x " * 500_000 + near), (3, " ".join([near[1:]] * 300)), (4, near[: len(near) // 2] * 300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    got = {x.doc_id: x.distance for x in decontaminate.find_items(docs, bench).collect()}
    assert got == {2: 2, 3: 3}


def test_every_planted_item_is_found(spark):
    got = {(x.doc_id, x.item_id) for x in QUERIES["op1_decontaminate"](spark, SF).collect()}
    items = [(x.item_id, decontaminate.folded(x.text)) for x in table(spark, SF, "benchmark").collect()]
    want = {(d.doc_id, i) for d in table(spark, SF, "documents").collect() for i, t in items if t in decontaminate.folded(d.text)}
    assert want <= got and want


def test_quality_on_documents_it_has_not_seen(spark):
    sf = "/root/testdata/sf0.1"
    rated = rated_documents(spark, sf).orderBy("doc_id").toPandas()
    seen = rated.iloc[::2]
    docs = table(spark, sf, "documents").repartition(8)
    model = ordinal.train(docs, spark.createDataFrame(seen), 3)
    assert (np.diff(model.thresholds) >= 0).all()
    got = ordinal.grade(docs, model, 3).select("doc_id", "expected_grade", "p_top", "selected").toPandas().set_index("doc_id")
    rest = rated.iloc[1::2].join(got, "doc_id")
    kept = rest.groupby("grade")["selected"].mean()
    assert kept[2] > 0.95 and kept[0] < 0.5 and kept[1] < 0.5, kept
    assert rest["expected_grade"].between(0, 2).all()


def plain_grades(text, model):
    """(expected grade, probability of each grade or a higher one) by the
    definitions, a token at a time."""
    counts = {}
    tokens = re.findall(r"\w+|[^\w\s]+", (text or "").lower())
    for t in tokens:
        counts[t] = counts.get(t, 0) + 1
    value = {t: 1 + math.log(c) for t, c in counts.items()}
    length = max(1.0, sum(x * x for x in value.values())) ** 0.25
    score = sum(float(model.weights[zlib.crc32(t.encode()) % 2**model.bits]) * x / length for t, x in value.items())
    n = max(1, len(tokens))
    shape = [
        len(counts) / n,
        max(counts.values(), default=0) / n,
        min(len(text or "") / n, 20) / 20,
        sum(not t[0].isalnum() for t in tokens) / n,
        sum(t[0].isdigit() for t in tokens) / n,
        min(n, 1000) / 1000,
        math.log1p(n) / 12,
    ]
    score += sum(float(w) * x for w, x in zip(model.weights[2**model.bits :], shape, strict=True))
    above = [1 / (1 + math.exp(cut - score)) for cut in model.thresholds]
    return sum(above), above


def test_grades_by_their_definitions(spark):
    docs = table(spark, SF, "documents")
    model = ordinal.train(docs, rated_documents(spark, SF), 3)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "é 漢字 __ !! 12 ²" * 2000)], "doc_id long, text string")
    given = docs.select("doc_id", "text", F.lit("own").alias("a.b"), F.lit(7).alias("score")).unionByName(odd.select("*", F.lit("own").alias("a.b"), F.lit(7).alias("score")))
    out = ordinal.grade(given, model, 3).collect()
    assert len(out) == docs.count() + 3 and all(r["a.b"] == "own" and r.score == 7 for r in out)
    for r in out:
        expected, above = plain_grades(r.text, model)
        assert abs(r.expected_grade - expected) < 1e-4 and abs(r.p_top - above[-1]) < 1e-4
        assert r.selected == (r.p_top >= ordinal.MIN_TOP)
    for known in (model, None):
        replaced = ordinal.grade(given.withColumn("Selected", F.lit("x")), known, 3)
        assert replaced.columns == [*given.columns, "expected_grade", "p_top", "selected"]


def test_gradient_by_differences():
    r = np.random.default_rng(0)
    index, begins = r.integers(0, 6, 40), np.arange(0, 41, 4)
    value, grades = r.normal(size=40), r.integers(0, 4, 10)

    def loss(w, cuts):
        score = np.add.reduceat(value * w[index], begins[:-1])
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-(edges[grades + 1] - score))) - 1 / (1 + np.exp(-(edges[grades] - score)))
        return -np.log(p).mean() + 0.05 * (w**2).sum()

    w, cuts = ordinal.fit(index, value, begins, grades, 4, 6, epochs=3000, rate=0.01, ridge=0.1)
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-5
        up, down = (loss(w + s[:6], cuts + s[6:]) for s in (step, -step))
        assert abs(up - down) / 2e-5 < 1e-3


def test_quality_of_odd_rows(spark):
    rows = [(1, "good words here", 5), (2, None, 5), (3, "", 5), (1, "bad | | |", 6), (None, "x", 7), (4, "bad " * 50000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    rated = spark.createDataFrame([(1, 2), (2, 0), (3, None), (9, 1), (4, 0)], "doc_id long, grade int")
    out = ordinal.grade(docs, ordinal.train(docs, rated, 3), 3)
    assert out.columns[:3] == docs.columns and out.count() == 6 and out.filter("p_top is null").count() == 0
    assert ordinal.train(docs, rated.limit(0), 3) is None
    assert ordinal.grade(docs, None, 3).filter("selected").count() == 0
    assert ordinal.grade(docs.limit(0), ordinal.train(docs, rated, 3), 3).count() == 0


TEXT = (
    "mail bosbt.42@mail8.example.com, ip 42.144.35.254 tel +1 (988) 555-2485 card 4041894974608795 and 4532-0151-1283-0366 "
    "ssn 123-45-6789 on 2024-02-29, 31/12/1999 12/31/1999 1.5.2020 GB82 WEST 1234 5698 7654 32 or 456-555-2186"
)
PLAIN = "v1.2.3.4.5 10.0.0.999 4137166598464392 2024-13-01 31.2.2020 000-12-3456 12345678901234567890 a@b (156) 555-2186 GB82 WEST 1234 5698 7654 33 x1y2 É"


def test_pseudonyms_of_each_format():
    own = pseudonyms.Pseudonyms(b"k")
    new, found = own.replace(TEXT)
    assert [f for f, _, _ in found] == ["email", "ip", "phone", "card", "card", "ssn", "date", "date", "date", "date", "iban", "phone"]
    assert pseudonyms.decrypt(new, b"k") == TEXT
    assert not any(TEXT[a : a + n] in new for _, a, n in found)
    again, found_again = own.replace(new)  # pseudonyms are valid in the same formats
    assert [f for f, _, _ in found_again] == [f for f, _, _ in found]
    assert pseudonyms.Pseudonyms(b"other").replace(TEXT)[0] != new
    assert own.replace(PLAIN) == (PLAIN, [])
    linked = own.replace("a 4041894974608795 b")[0].split()[1]
    assert linked in new


@pytest.mark.parametrize("value, name", [("4111111111111111", "card"), ("4111 1111 1111 1111", "card"), ("3782-822463-10005", "card"), ("4222222222222", "card"), ("6304 1234 5678 9012 37", "card"), ("ES91 2100 0418 4502 0005 1332", "iban"), ("BE68 5390 0754 7034", "iban"), ("AT611904300234573201", "iban"), ("DE89 3704 0044 0532 0130 00", "iban")])
def test_values_before_numbers_and_capital_words(value, name):
    own = pseudonyms.Pseudonyms(b"k")
    alone, found = own.replace(value)
    assert found == [(name, 0, len(value))] and alone != value
    numbers = [f"{sep}{i}" for sep in " -" for i in range(1000)] if name == "card" else []
    for after in [" 123", " 12/27", "-1", " 7 8", " EUR", " BIC", " EURO", " BIC GEBABEBB", " IN 2024", " 12@example.com", *numbers]:
        new, found = own.replace(value + after)
        if name == "card" or after[:1] == " ":
            # only the groups of odd layouts leave it open where the card ends
            assert found[0][1] == 0 and (found[0][2] == len(value) or value.startswith("6304"))
            assert new.startswith(alone) or value.startswith("6304")
        assert pseudonyms.decrypt(new, b"k") == value + after


def test_phones_with_other_area_codes():
    own = pseudonyms.Pseudonyms(b"k")
    text = "+1 (017) 555-7713, +1 (156) 055-2186 and +1 (017) 555-7713, not (017) 555-7713"
    new, found = own.replace(text)
    assert [f for f, _, _ in found] == ["phone"] * 3 and pseudonyms.decrypt(new, b"k") == text
    assert new[:17] == new[41:58] != text[:17] and new.endswith(", not (017) 555-7713")
    again, found_again = own.replace(new)
    assert found_again == found
    assert own.replace("+1 (212) 555-7713")[0][4] in "23456789"


def test_card_behind_a_number():
    own = pseudonyms.Pseudonyms(b"k")
    for value in ("4111 1111 1111 1111", "4111111111111111"):
        alone = own.replace(value)[0]
        for i in range(1000):
            new = own.replace(f"{i} {value}")[0]
            assert new == f"{i} {alone}" and pseudonyms.decrypt(new, b"k") == f"{i} {value}"


def test_permutations_are_bijections():
    f = pseudonyms.Feistel(b"k")
    for size in (1, 2, 10, 97, 1000):
        image = [f.permute(x, size, "t") for x in range(size)]
        assert sorted(image) == list(range(size))
        assert [f.permute(y, size, "t", back=True) for y in image] == list(range(size))
    odd = [x for x in range(200) if x % 2]
    assert sorted(f.permute(x, 200, "t", lambda x: x % 2 == 1) for x in odd) == odd


def test_addresses_against_a_plain_search():
    """The search from each @ finds what a search from each start finds."""
    plain = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
    rng = random.Random(5)
    n = 0
    for _ in range(20000):
        text = "".join(rng.choice(["a", "B", "7", ".", "-", "%", "@", "@", ".com", " ", "é", "x@y.de"]) for _ in range(rng.randrange(1, 14)))
        want = [m.span() for m in plain.finditer(text)]
        assert list(pseudonyms._mails(text)) == want, text
        n += len(want)
    assert n > 5000


def test_hostile_texts_take_linear_time():
    own = pseudonyms.Pseudonyms(b"k")
    for unit in ("%E3", "a.", "a-", "1.1.1.1..", "@", "@a.", "a@", "1 ", "4 ", "AB12 ", "(", "12-"):
        text = "x@ " + unit * (1_000_000 // len(unit)) + " y@z"
        began = time.process_time()
        own.replace(text)
        assert time.process_time() - began < 30, unit
    text = "ab" * 100_000 + "@example.com"
    new, found = own.replace(text)
    assert found == [("email", 0, len(text))] and pseudonyms.decrypt(new, b"k") == text


def _luhn_holds(digits):
    doubled = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(doubled[int(d)] if i % 2 else int(d) for i, d in enumerate(digits[::-1])) % 10 == 0


def _mod97_holds(iban):
    rest = 0
    for c in iban[4:] + iban[:4]:
        for d in str(ord(c) - 55) if c.isalpha() else c:
            rest = (rest * 10 + int(d)) % 97
    return rest == 1 and iban[2:4] not in ("00", "01", "99")


def _holds(name, value):
    """Validity by other means than the module's."""
    digits = re.sub("[^0-9]", "", value)
    if name == "card":
        return 13 <= len(digits) <= 19 and _luhn_holds(digits)
    if name == "iban":
        return _mod97_holds(value.replace(" ", ""))
    if name == "ip":
        ipaddress.ip_address(".".join(str(int(x)) for x in value.split(".")))
        return True
    if name == "ssn":
        return value[:3] not in ("000", "666") and value[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if name == "phone":
        return len(digits) in (10, 11)
    if name == "date":
        forms = ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d")
        for form in forms:
            try:
                return 1900 <= datetime.datetime.strptime(value, form).year < 2100
            except ValueError:
                continue
        return False
    return value.count("@") == 1


def _shape(text):
    return re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", text)))


def test_planted_values_are_found_and_stay_in_their_format():
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while not _luhn_holds(d := rng.choice("3456") + digits(15)):
            pass
        return rng.choice([d, " ".join(re.findall("....", d)), "-".join(re.findall("....", d))])

    def iban():
        while not _mod97_holds(d := f"DE{rng.randrange(2, 99):02d}" + digits(18)):
            pass
        return d

    def date():
        d = datetime.date.fromordinal(datetime.date(1900, 1, 1).toordinal() + rng.randrange(73049))
        m, day = rng.choice([f"{d.month}", f"{d.month:02d}"]), rng.choice([f"{d.day}", f"{d.day:02d}"])
        return rng.choice([f"{d.year}-{m}-{day}", f"{day}.{m}.{d.year}", f"{day}/{m}/{d.year}", f"{m}/{day}/{d.year}", f"{d.year}/{m}/{day}"])

    make = {
        "card": card,
        "iban": iban,
        "date": date,
        "ip": lambda: ".".join(rng.choice([str(x), f"{x:02d}", f"{x:03d}"]) for x in (rng.randrange(256) for _ in range(4))),
        "ssn": lambda: f"{rng.randrange(1, 666):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}",
        "phone": lambda: f"({rng.randrange(200, 1000)}) {rng.randrange(200, 1000)}-{digits(4)}",
        "email": lambda: f"{rng.choice('abZ9')}{rng.choice(['.', '_', 'x'])}{digits(3)}q@mail.example.org",
    }
    own = pseudonyms.Pseudonyms(b"k")
    for _ in range(300):
        planted = [(name, make[name]()) for name in rng.choices(list(make), k=6)]
        text, spans = "", []
        for name, value in planted:
            text += rng.choice(["see ", "no: ", "é, ", "by\n"])
            spans.append((name, len(text), len(value)))
            text += value + rng.choice([", ", "; ", " and "])
        new, found = own.replace(text)
        assert found == spans, text
        assert pseudonyms.decrypt(new, b"k") == text
        again, found_again = own.replace(new)
        assert [f for f, _, _ in found_again] == [f for f, _, _ in found]
        for (name, a, n), (_, b, m) in zip(found, found_again, strict=True):
            assert _holds(name, new[b : b + m]), (name, new[b : b + m])
            if name not in ("date", "ip"):  # whose unpadded parts may get another width
                assert _shape(new[b : b + m]) == _shape(text[a : a + n])


@pytest.mark.parametrize("text", ["010.001.002.003", "10.01.2.003", "00.0.00.255", "2020-1-05", "1/2/2020", "1/25/2020", "05.1.2020", "5.01.2020", "31.1.1999", "01/02/2020"])
def test_leading_zeros_stay(text):
    for key in range(50):
        new, found = pseudonyms.Pseudonyms(b"%d" % key).replace(text)
        assert len(found) == 1 and pseudonyms.decrypt(new, b"%d" % key) == text
        zeros = lambda t: [len(x) > 1 and x[0] == "0" for x in re.split("[./-]", t)]
        assert zeros(new) == zeros(text) or text == "01/02/2020"


def test_other_digits_are_left_alone():
    text = "４１１１１１１１１１１１１１１１ ١٢٣-٤٥-٦٧٨٩ １０.0.0.1 ２０20-01-02 (２12) 555-1234 GB８２WEST12345698765432"
    assert pseudonyms.Pseudonyms(b"k").replace(text) == (text, [])


def test_pseudonyms_of_odd_rows(spark):
    rows = [(1, TEXT, 1, "c"), (2, None, 2, "c"), (3, "", 3, None), (4, PLAIN + " w" * 100000, 4, "c"), (1, TEXT, 1, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c0 int, found string")
    out = pseudonyms.pseudonymise(docs, b"k")
    assert out.columns == ["doc_id", "text", "c0", "found", "findings"]
    got = out.collect()
    assert [r.text for r in got[1:4]] == [None, "", rows[3][1]] and got[0] == got[4]
    assert [len(r.findings) for r in got] == [12, 0, 0, 0, 12]
    assert pseudonyms.pseudonymise(docs.limit(0), b"k").collect() == []


@pytest.fixture(scope="module")
def model(spark):
    return unigram.read_model(spark, SENTENCEPIECE_MODEL)


def slow_best(model, text):
    """Highest score of any segmentation, by trying every piece everywhere."""
    score = {p: s for p, s, k in zip(model.pieces, model.weight, model.kinds, strict=True) if k in (unigram.NORMAL, unigram.USER)}
    longest = max(map(len, score))
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        options = [best[at] + score[text[at:end]] for at in range(max(0, end - longest), end) if text[at:end] in score]
        if text[end - 1] not in score:
            options.append(best[end - 1] + model.lowest - unigram.PENALTY)
        best[end] = max(options)
    return best[-1]


def score_of(model, ids, text):
    known = set(zip(model.pieces, model.kinds, strict=True))
    total = sum(model.weight[i] for i in ids if model.kinds[i] != unigram.BYTE)
    return total + sum(model.lowest - unigram.PENALTY for c in text if (c, unigram.NORMAL) not in known)


def test_viterbi_against_all_segmentations(model):
    encoder = unigram.Encoder(model)
    texts = ["the quick brown  fox", "unbelievable", "a\nb\tc", "日本語の文章です", "ÉÈ ß x😀y", "   lead", "aaaaaaaaaaaaaaaaaaaaa", "Ouwhea the of rend"]
    for text in texts:
        marked = unigram.MARK + text.replace(" ", unigram.MARK)
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert score_of(model, ids, marked) == slow_best(model, marked), text


def test_same_scores_as_the_library(model):
    """The library's lattice search over the same pieces as a unigram model."""
    sentencepiece = pytest.importorskip("sentencepiece")
    with open(SENTENCEPIECE_MODEL, "rb") as f:
        data = f.read()

    def number(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    proto = b""
    for field, value in unigram._fields(data):
        if field == 2:  # the trainer's settings: only the kind of model is set anew
            value = number(3 << 3) + number(1) + b"".join(number(k << 3) + number(v) for k, v in unigram._fields(value) if isinstance(v, int) and k != 3)
        proto += number(field << 3 | 2) + number(len(value)) + value
    library = sentencepiece.SentencePieceProcessor(model_proto=proto)
    encoder = unigram.Encoder(model)
    for text in ["the quick brown fox", "Ouwhea the of rend and threlyes", "reconstruction of words", "schließlich über"]:
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        best = library.nbest_encode_as_ids(text, 2)[0]
        assert sum(model.weight[i] for i in ids) == sum(model.weight[i] for i in best)


def test_encoding_round_trip(spark, model):
    texts = ["", " ", "a", " a  b ", "▁", "a▁ b▁▁", "日本 語😀", "\n\n\t", "<s> </s> <0x0A> <unk>", "x" * 50000, "  é", None]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = unigram.decode(unigram.encode(docs, model, ids_col="tokens"), model, ids_col="tokens").orderBy("doc_id")
    assert out.columns == ["doc_id", "text", "ids", "tokens", "decoded"]
    rows = out.collect()
    assert [r.decoded for r in rows] == texts
    assert rows[0].tokens == [] and rows[-1].tokens is None
    odd = spark.createDataFrame([([1, 0, -5, 10**6, None, model.bytes[0xFF]],)], "ids array<int>")
    assert unigram.decode(odd, model).first().decoded == "⁇ �"
    assert unigram.encode(docs.limit(0), model).collect() == []


def test_round_trip_of_all_documents(spark):
    out = QUERIES["op6_unigram"](spark, SF)
    assert out.filter("not round_trip or n_tokens = 0").count() == 0


def test_clean_documents_keep_their_text(spark):
    out = QUERIES["op5_pseudonyms"](spark, SF)
    both = out.withColumnRenamed("text", "new").join(table(spark, SF, "documents"), "doc_id")
    assert both.filter("n_found = 0 and new <> text").count() == 0
    found = both.filter("n_found > 0").collect()
    assert found and all(re.sub(r"[0-9A-Za-z]", "0", r.new) != "" and r.new != r.text for r in found)


def test_models_without_a_name_are_told_apart():
    """One worker, two models built in code: each has its own encoder."""
    kinds = [unigram.UNKNOWN] + [unigram.NORMAL] * 4
    small = unigram.Model(["<unk>", "▁", "a", "b", "ab"], [0.0, -1.0, -1.0, -1.0, -9.0], kinds)
    large = unigram.Model(["<unk>", "▁", "a", "b", "ab"], [0.0, -1.0, -9.0, -9.0, -1.0], kinds)
    got = [np.frombuffer(unigram.encoder_of(m).encode("ab"), np.int32).tolist() for m in (small, large, small)]
    assert got == [[1, 2, 3], [1, 4], [1, 2, 3]]
