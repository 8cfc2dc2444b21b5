"""Personal numbers, dates and addresses replaced by pseudonyms of the same
format.

A value is validated (checksums, ranges, calendar), read as a number of its
format's domain and permuted there by a keyed Feistel network: domain
``[0, a * b)`` split into two halves, rounds that add a keyed hash of one half
to the other, walked on until the result is inside the domain and valid
again.  That is a bijection for each key and format, so equal values get equal
pseudonyms in every document and different ones stay different, without a
table of values; with the key it is reversible (``decrypt``).

Formats: payment cards (13 to 19 digits, Luhn; the check digit is set anew),
IBANs (mod 97, country kept, check digits set anew), social security numbers,
North American phone numbers (area code and exchange from 200 on; written as
``+1 (ddd) ddd-dddd`` any, the others among themselves), IPv4 addresses, dates (ISO, dotted and slashed;
the day number 1900 to 2099 is permuted, the notation kept) and e-mail
addresses (letters and digits of the local part, class by class).

Digits are the ASCII ones.  Leading zeros stay where they are: a padded part of
an address or a date gets a padded one again.

A card or an IBAN may be followed by numbers or capital words: the digits or
characters that belong to it are those in its usual groups or of its country's
length, else the longest valid ones up to a separator; the choice is the same
for the pseudonym, so it stays reversible.

Separators and all other text stay byte for byte.  Defined results: NULL text
stays NULL with no findings; empty text has none; repeated rows and equal values
get equal results; an empty table gives an empty one; other columns pass through
under their names, but for one with the name of the findings.  Work is one pass
over each text, without a shuffle, in time linear in its length whatever it
holds.  Of formats that begin at one place the first of ``FORMATS`` that
validates is taken.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


class Feistel:
    """Keyed permutations of ``[0, size)``."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key).digest()

    def _add(self, tag: str, step: int, half: int, size: int) -> int:
        text = f"{tag}|{step}|{half}|{size}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    def _once(self, x: int, size: int, tag: str, back: bool) -> int:
        a = math.isqrt(size - 1) + 1 if size > 1 else 1
        b = -(-size // a)
        left, right = divmod(x, b)
        for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if step % 2:
                right = (right + sign * self._add(tag, step, left, size)) % b
            else:
                left = (left + sign * self._add(tag, step, right, size)) % a
        return left * b + right

    def permute(self, x: int, size: int, tag: str, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Walks on until the value is in the domain and ``valid``; a bijection
        of the valid values."""
        while True:
            x = self._once(x, size, tag, back)
            if x < size and valid(x):
                return x


def luhn(digits: str) -> int:
    """Check digit that ``digits`` need."""
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _placed(new: str, old: str) -> str:
    """``new`` letters and digits in the places of those of ``old``."""
    it = iter(new)
    return "".join(next(it) if c.isalnum() else c for c in old)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
_CARD = re.compile(CARD, re.ASCII)
#: The groups that cards are usually written in; at most one way fits a place.
_CARD_USUAL = re.compile(r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)", re.ASCII)


def _card_valid(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits[:-1]) == int(digits[-1])


def _card_end(text: str, begin: int, stop: int) -> int | None:
    """End of the card at ``begin``: one in the usual groups, else the longest
    valid one that ends at a separator and has none in the usual groups begin
    inside it."""

    def usual(at: int) -> int | None:
        m = _CARD_USUAL.match(text, at, stop)
        return m.end() if m and _card_valid(_only_digits(m.group())) else None

    m = _CARD.match(text, begin, stop)
    if not m or (end := usual(begin)):
        return end if m else None
    for end in range(m.end(), begin + 12, -1):
        whole = text[end - 1] not in " -" and (end == m.end() or text[end] in " -")
        if whole and _card_valid(_only_digits(text[begin:end])) and not any(text[at - 1] in " -" and usual(at) for at in range(begin + 1, end)):
            return end
    return None


def _card(f: Feistel, text: str, back: bool, rest: str) -> str:
    """``rest`` is what follows; a card stays one that is found at the same
    place, and one of more than 16 digits stays with or without a card in
    its first 16."""
    digits = _only_digits(text)
    n = len(digits) - 1
    usual = _CARD_USUAL.fullmatch(text)

    def valid(x: int) -> bool:
        body = str(x).zfill(n)
        new = body + str(luhn(body))
        if len(set(new)) == 1 or n > 15 and _card_valid(new[:16]) != _card_valid(digits[:16]):
            return False
        return bool(usual) or _card_end(_placed(new, text) + rest, 0, len(text) + len(rest)) == len(text)

    body = str(f.permute(int(digits[:-1]), 10**n, f"card{n}", valid, back)).zfill(n)
    return _placed(body + str(luhn(body)), text)


def _iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


def _classes(f: Feistel, text: str, tag: str, back: bool, valid: Callable[[str], bool] | None = None) -> str:
    """Letters and digits permuted together, each within its class."""
    sets = ["0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text]
    value, size = 0, 1
    for c, s in zip(text, sets, strict=True):
        value, size = value * len(s) + s.index(c), size * len(s)
    shape = "".join(s[0] for s in sets)

    def spelled(value: int) -> str:
        out = []
        for s in reversed(sets):
            value, at = divmod(value, len(s))
            out.append(s[at])
        return "".join(reversed(out))

    return spelled(f.permute(value, size, tag + shape, lambda x: valid is None or valid(spelled(x)), back))


IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IBAN = re.compile(IBAN, re.ASCII)
#: Characters of a country's IBANs.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}


def _iban_end(text: str, begin: int, stop: int) -> int | None:
    """End of the IBAN at ``begin``: of the country's length, else the longest
    valid one that ends at a separator."""
    m = _IBAN.match(text, begin, stop)
    if not m:
        return None
    ends = [e for e in range(m.end(), begin + 14, -1) if e == m.end() or text[e] == " "]
    length = IBAN_LENGTHS.get(text[begin : begin + 2])
    for end in sorted(ends, key=lambda e: len(text[begin:e].replace(" ", "")) != length):
        plain = text[begin:end].replace(" ", "")
        if 15 <= len(plain) <= 34 and "02" <= plain[2:4] <= "98" and _iban_number(plain) % 97 == 1:
            return end
    return None


def _iban(f: Feistel, text: str, back: bool, rest: str) -> str:
    """``rest`` is what follows; an IBAN stays one that is found at the same
    place."""
    plain = text.replace(" ", "")

    def made(body: str) -> str:
        check = 98 - _iban_number(plain[:2] + "00" + body) % 97
        return _placed(f"{plain[:2]}{check:02d}{body}", text)

    usual = len(plain) == IBAN_LENGTHS.get(plain[:2])
    return made(_classes(f, plain[4:], "iban" + plain[:2], back, lambda body: usual or _iban_end(made(body) + rest, 0, len(text) + len(rest)) == len(text)))


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(f: Feistel, text: str, back: bool) -> str | None:
    x = int(_only_digits(text))
    return _placed(str(f.permute(x, 10**9, "ssn", _ssn_valid, back)).zfill(9), text) if _ssn_valid(x) else None


def _phone_valid(x: int) -> bool:
    return x // 10**9 > 1 and x // 10**6 % 10 > 1


#: Told to be a phone number by its notation, whatever its digits.
_PHONE_FULL = re.compile(r"\+1 \(\d{3}\) \d{3}-\d{4}", re.ASCII)


def _phone(f: Feistel, text: str, back: bool) -> str | None:
    digits = _only_digits(text)
    x = int(digits[-10:])
    valid = _phone_valid(x)
    if not valid and not _PHONE_FULL.fullmatch(text):
        return None
    new = f.permute(x, 10**10, "phone", lambda y: _phone_valid(y) == valid, back)
    return _placed(digits[:-10] + str(new).zfill(10), text)


def _ip(f: Feistel, text: str, back: bool) -> str | None:
    octets = text.split(".")
    if max(map(int, octets)) > 255:
        return None
    # an octet with a leading zero gets one of its width that has one too
    sizes = [10 ** (len(o) - 1) if len(o) > 1 and o[0] == "0" else 256 for o in octets]
    value = 0
    for o, size in zip(octets, sizes, strict=True):
        value = value * size + int(o)
    shape = "" if set(sizes) == {256} else ".".join(map(str, sizes))
    x = f.permute(value, math.prod(sizes), "ip" + shape, back=back)
    out = []
    for o, size in zip(reversed(octets), reversed(sizes), strict=True):
        x, new = divmod(x, size)
        out.append(str(new) if size == 256 else str(new).zfill(len(o)))
    return ".".join(reversed(out))


def _padded(month: str, day: str) -> tuple[bool, ...]:
    """How month and day are written: both in two digits, or which of them
    has a leading zero."""
    return (True,) if len(month) == len(day) == 2 else (month[0] == "0", day[0] == "0")


def _date(f: Feistel, text: str, back: bool) -> str | None:
    sign = next(c for c in text if c in "-./")
    parts = text.split(sign)
    if len(parts[0]) == 4:
        order = (0, 1, 2)
    elif sign == "/" and int(parts[1]) > 12:
        order = (2, 0, 1)
    else:
        order = (2, 1, 0)
    year, month, day = (parts[i] for i in order)
    try:
        number = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= number < DAYS:
        return None
    padded = _padded(month, day)

    def spelled(x: int) -> list[str]:
        new = datetime.date.fromordinal(x + FIRST_DAY)
        zeros = padded * (3 - len(padded))
        return [str(new.year), str(new.month).zfill(1 + zeros[0]), str(new.day).zfill(1 + zeros[1])]

    # a slashed date whose second part is a day must get one that says so again
    us = order == (2, 0, 1)

    def valid(x: int) -> bool:
        _, m, d = spelled(x)
        return _padded(m, d) == padded and (not us or int(d) > 12)

    values = dict(zip(order, spelled(f.permute(number, DAYS, "date" + "us" * us, valid, back)), strict=True))
    return sign.join(values[i] for i in range(3))


_SIGNS = "._%+-"
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
#: Letters and digits of a local part that are permuted together.
_MAIL_PIECE = 64


def _mails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every e-mail address, from its ``@`` outwards.  What lies
    between two of them is looked at twice at most."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        local = before[len(before.rstrip(_SIGNS + _LETTERS)) :]
        if done and len(local) == len(before) and text[done - 1] in _LETTERS:
            local = local.lstrip(_LETTERS)  # these go on from the address before
        local = local.lstrip(_SIGNS)
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - len(local), domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _email(f: Feistel, text: str, back: bool) -> str:
    local, at, domain = text.partition("@")
    plain = "".join(c for c in local if c in _LETTERS)
    new = [_classes(f, plain[i : i + _MAIL_PIECE], f"mail{i or ''}", back) for i in range(0, len(plain), _MAIL_PIECE)]
    return _placed("".join(new), local) + at + domain


#: Name, pattern and rule of the numbers; an earlier one wins where two begin
#: together, and an e-mail address before all of them.
FORMATS: list[tuple[str, str, Callable]] = [
    ("iban", IBAN, _iban),
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?!\.*+\d)", _ip),
    ("date", r"(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}/\d{1,2}/\d{1,2})(?![\d])", _date),
    ("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("card", CARD, _card),
    ("phone", r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", _phone),
]
_NUMBERS = [(name, re.compile(pattern, re.ASCII), rule) for name, pattern, rule in FORMATS]
#: Formats whose matches can hold what follows a value: where the value ends.
_ENDS = {"iban": _iban_end, "card": _card_end}
#: What follows a value, as far as it can tell where the value ends.
_REST = 50
#: Where a number format may begin: a digit run's start, with what may lead it.
_START = re.compile(r"(?<![0-9A-Za-z])(?<![0-9][.])(?:[A-Z]{2}(?=\d{2})|[+(]?(?=\d))", re.ASCII)


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        self.feistel = Feistel(key)

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """(new text, findings as (format, start, length) in the old text)."""
        found: list[tuple[int, int, str, str]] = []
        for begin, end in _mails(text):
            found.append((begin, end, "email", _email(self.feistel, text[begin:end], back)))
        mails = iter([*found, (len(text) + 1, len(text) + 1, "", "")])
        mail = next(mails)
        at = 0
        while start := _START.search(text, at):
            begin = start.start()
            while mail[1] <= begin:
                mail = next(mails)
            if begin >= mail[0]:
                at = mail[1]
                continue
            at = max(start.end(), begin + 1)
            for name, pattern, rule in _NUMBERS:
                stop = min(mail[0], len(text))
                if name in _ENDS:
                    end = _ENDS[name](text, begin, stop)
                    new = rule(self.feistel, text[begin:end], back, text[end : min(end + _REST, stop)]) if end else None
                else:
                    m = pattern.match(text, begin)
                    end = m.end() if m else 0
                    new = rule(self.feistel, m.group(), back) if m and end <= stop else None
                if new is not None:
                    found.append((begin, end, name, new))
                    at = end
                    break
        found.sort()
        out, done = [], 0
        for a, b, _, new in found:
            out += [text[done:a], new]
            done = b
        return "".join([*out, text[done:]]) if found else text, [(name, a, b - a) for a, b, name, _ in found]


def decrypt(text: str, key: bytes) -> str:
    """The text that ``key`` made this one of."""
    return Pseudonyms(key).replace(text, back=True)[0]


def _replaced(key: bytes, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        kind = pa.list_(pa.struct([("format", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
        for batch in batches:
            texts, findings = [], []
            for text in batch.column(batch.num_columns - 1):
                new, found = own.replace(text.as_py()) if text.is_valid else (None, [])
                texts.append(new)
                findings.append([{"format": n, "start": a, "length": b} for n, a, b in found])
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(findings, kind)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", found_col: str = "findings") -> DataFrame:
    """``df`` with its texts rewritten, plus the findings: an array of
    (format, start, length) in characters of the old text."""
    kept = [f for f in df.schema.fields if f.name.lower() not in (text_col.lower(), found_col.lower())]
    plain = df.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(kept)], F.col(f"`{text_col}`").alias("text"))
    finding = T.StructType([T.StructField("format", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField("text", T.StringType()), T.StructField("found", T.ArrayType(finding))])
    out = plain.mapInArrow(_replaced(key, schema), schema)
    back = {f.name: F.col(f"c{i}") for i, f in enumerate(kept)} | {text_col: F.col("text")}
    names = [f.name for f in df.schema.fields if f.name.lower() != found_col.lower()]
    return out.select(*[back[n].alias(n) for n in names], F.col("found").alias(found_col))
