"""Column functions for text preparation.

All of them are built-in Spark expressions (``replace``, ``regexp_extract_all``,
higher-order ``filter``/``transform``), so they run inside whole-stage codegen
on the JVM and never ship text to Python.
"""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: English stop words (the common NLP stop-word list) -------
STOPWORDS_EN = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're",
    "you've", "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he",
    "him", "his", "himself", "she", "she's", "her", "hers", "herself", "it", "it's",
    "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "that'll", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because",
    "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below",
    "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no",
    "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't",
    "didn", "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't",
    "haven", "haven't", "isn", "isn't", "ma", "mightn", "mightn't", "mustn",
    "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't",
    "wasn", "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
]

# --- fixed values: ASCII punctuation; a token that is a substring of it is dropped
PUNCTUATION = string.punctuation

# --- fixed values: contraction expansion, applied in this order, case-sensitive
DECONTRACTIONS = [
    ("’", "'"),
    ("won't", "will not"),
    ("can't", "can not"),
    ("n't", " not"),
    ("'re", " are"),
    ("'s", " is"),
    ("'d", " would"),
    ("'ll", " will"),
    ("'t", " not"),
    ("'ve", " have"),
    ("'m", " am"),
]

# Named HTML entities, from the standard library's table; of the numbers 128 to
# 159 those that stand for a character of code page 1252 (browsers' reading).
ENTITY_NAMES = {name: chr(code) for name, code in sorted(name2codepoint.items())}
CODE_PAGE = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}
MAX_CODE_POINT, SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)

# --- fixed values: Unicode's emoji of one code point, as ranges
EMOJI_RANGES = (
    "00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 "
    "25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A "
    "262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 "
    "2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 "
    "26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 "
    "2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 "
    "2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E "
    "1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 "
    "1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 "
    "1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 "
    "1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 "
    "1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A "
    "1F93C-1F945 1F947-1F9FF 1FA70-1FAFF"
)
# --- fixed values: short names that are not the character's Unicode name
EMOJI_SHORT_NAMES = {
    "©": "copyright", "®": "registered", "™": "trade_mark",
    "❤": "red_heart", "☺": "smiling_face", "✊": "raised_fist", "✅": "check_mark_button",
    "⚠": "warning", "⭐": "star", "✨": "sparkles", "☀": "sun", "☕": "hot_beverage",
    "⚡": "high_voltage", "⚽": "soccer_ball", "✈": "airplane", "✔": "check_mark",
    "🌍": "globe_showing_Europe-Africa", "🌎": "globe_showing_Americas",
    "🌏": "globe_showing_Asia-Australia", "🌙": "crescent_moon", "🌹": "rose",
    "🎂": "birthday_cake", "🎉": "party_popper", "🏆": "trophy", "🐷": "pig_face",
    "🐶": "dog_face", "🐱": "cat_face", "🐻": "bear", "👆": "backhand_index_pointing_up",
    "👇": "backhand_index_pointing_down", "👈": "backhand_index_pointing_left",
    "👉": "backhand_index_pointing_right", "👊": "oncoming_fist", "👋": "waving_hand",
    "👌": "OK_hand", "👍": "thumbs_up", "👎": "thumbs_down", "👏": "clapping_hands",
    "💀": "skull", "💋": "kiss_mark", "💜": "purple_heart", "💡": "light_bulb",
    "💥": "collision", "💦": "sweat_droplets", "💩": "pile_of_poo", "💪": "flexed_biceps",
    "💯": "hundred_points", "📢": "loudspeaker", "🔞": "no_one_under_eighteen",
    "🕊": "dove", "😁": "beaming_face_with_smiling_eyes", "😃": "grinning_face_with_big_eyes",
    "😄": "grinning_face_with_smiling_eyes", "😅": "grinning_face_with_sweat",
    "😆": "grinning_squinting_face", "😋": "face_savoring_food",
    "😍": "smiling_face_with_heart-eyes", "😓": "downcast_face_with_sweat",
    "😘": "face_blowing_a_kiss", "😛": "face_with_tongue", "😜": "winking_face_with_tongue",
    "😝": "squinting_face_with_tongue", "😡": "enraged_face",
    "😤": "face_with_steam_from_nose", "😥": "sad_but_relieved_face",
    "😰": "anxious_face_with_sweat", "😵": "face_with_crossed-out_eyes",
    "🙊": "speak-no-evil_monkey", "🙌": "raising_hands", "🙏": "folded_hands",
    "🚀": "rocket", "🚨": "police_car_light", "🤗": "smiling_face_with_open_hands",
}


def emoji_names() -> dict[str, str]:
    """``:name:`` of every emoji of one code point: its short name if listed,
    else its Unicode name."""
    out = {}
    for part in EMOJI_RANGES.split():
        first, _, last = part.partition("-")
        for c in map(chr, range(int(first, 16), int(last or first, 16) + 1)):
            if name := unicodedata.name(c, ""):
                out[c] = f":{EMOJI_SHORT_NAMES.get(c, name.lower().replace(' ', '_'))}:"
    return out


EMOJI_NAMES = emoji_names()

# --- fixed values: placeholder tokens dropped after tokenising
PLACEHOLDERS = ["@user", "httpurl"]

# --- fixed values: post normalisation (applied in this order, literal text)
NORMALIZE_PRE = [
    ("’", "'"),
    ("…", "..."),
    ("🏻‍♂", ""),
    ("“|”", "''"),
    ("–|—", "-"),
]
NORMALIZE_POST = [
    ("cannot ", "can not "),
    ("n't ", " n't "),
    ("n 't ", " n't "),
    ("ca n't", "can't"),
    ("ai n't", "ain't"),
    ("'m ", " 'm "),
    ("'re ", " 're "),
    ("'s ", " 's "),
    ("'ll ", " 'll "),
    ("'d ", " 'd "),
    ("'ve ", " 've "),
    (" p . m .", "  p.m."),
    (" p . m ", " p.m "),
    (" a . m .", " a.m."),
    (" a . m ", " a.m "),
    ("🇷 🇺", ":Russia:"),
    ("🇺 🇦", ":Ukraine:"),
    ("🇺 🇸", ":United_States:"),
    ("🇺 🇳", ":United_Nations:"),
    ("🇬 🇧", ":United_Kingdom:"),
    ("🇹 🇷", ":Turkey:"),
    ("🇵 🇰", ":Pakistan:"),
]

# Whitespace as Python's str.split sees it (ASCII space class, Unicode
# separators, information separators, next-line).
_WS = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
_NS = f"[^{_WS}]"
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_W = r"[\p{L}\p{N}_]"
_LABEL = r"[\p{L}\p{N}_\-]"  # of a domain name
_EMOTICON = (
    r"(?:[<>]?[:;=8][\-o\*']?[\)\]\(\[dDpP/:\}\{@\|\\]"
    r"|[\)\]\(\[dDpP/:\}\{@\|\\][\-o\*']?[:;=8][<>]?|<3)"
)

# phone number: optional country code and area code, 3 + 4 digits
_PHONE = r"(?:(?:\+?[01][ *\-.\)]*)?(?:[\(]?\p{Nd}{3}[ *\-.\)]*)?\p{Nd}{3}[ *\-.\)]*\p{Nd}{4})"

# Social-media tokenizer as one ordered alternation; leftmost-first matching
# behaves the same in Java regex (Spark) and RE2.  Java's matcher recurses once
# for each repetition of a group, so what may be long is a loop over one class;
# what would be read again from every place (tags, e-mail addresses) is bounded.
TOKEN_PATTERN = "|".join(
    [
        rf"(?:[hH][tT][tT][pP][sS]?://|[wW][wW][wW]\.){_NS}+",  # URL
        _PHONE,  # phone number
        _EMOTICON,  # emoticon
        rf"<[^>{_WS}]{{1,256}}>",  # HTML-like tag
        r"[\-]+>|<[\-]+",  # ASCII arrow
        rf"@{_W}+",  # handle
        rf"#+{_W}+[\p{{L}}\p{{N}}_'\-]*{_W}+",  # hashtag
        rf"[\p{{L}}\p{{N}}_.+\-]{{1,64}}@{_LABEL}{{1,255}}\.(?:{_LABEL}\.?){{1,255}}{_LABEL}",  # e-mail
        r"\p{L}[\p{L}'\-_]+\p{L}",  # word with apostrophes or dashes
        r"[+\-]?\p{Nd}+[,/.:\-]\p{Nd}+[+\-]?",  # number with separator
        rf"{_W}+",  # other word
        rf"\.[{_WS}.]*\.",  # ellipsis
        _NS,  # any other visible character
    ]
)

#: The same tokens as ``TOKEN_PATTERN`` by Java's matcher in fewer steps: no
#: alternative begins with white space; a word of a-z before a blank, a comma
#: or the end is one token whichever alternative takes it; an e-mail's name can
#: only end before its @, so what it took is not given back.
FAST_TOKEN_PATTERN = rf"(?=[^{_WS}])(?:[a-z]++(?=[ \n,]|\z)|" + TOKEN_PATTERN.replace("{1,64}@", "{1,64}+@") + ")"

SQUEEZE_PATTERN = f"[{_WS}]+"


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# Default word tokenizer: ordered rewriting passes after the Penn Treebank
# convention, then a split at white space.  Replacements name groups as $1.
# The patterns are regular expressions of both Java and RE2; where a pass has to
# look at the character before or behind, it takes it and runs twice, since one
# character can be behind one match and before the next.
_NO_WORD_BEFORE, _NO_WORD_BEHIND = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|\z)"
# --- fixed values: closing marks that may follow a text's last full stop
_CLOSING = r"[\]\)}>\"'»”’ ]"
# --- fixed values: contractions that become two tokens
CONTRACTIONS_TWO = ["can|not", "d|'ye", "gim|me", "gon|na", "got|ta", "lem|me", "more|'n"]
CONTRACTION_WANNA = "wan|na"  # before white space only
CONTRACTIONS_BLANK = ["'t|is", "'t|was"]  # behind a blank only
# --- fixed values: opening quotes, punctuation, brackets, dashes
OPENING_PASSES = [
    ("([«“‘„]|`+)", " $1 "),
    (r'^"', "``"),
    ("(``)", " $1 "),
    (r"([ (\[{<])(\"|'')", "$1 `` "),
]
# a quote leaves a lone letter, but for those of 'm, 't, 's, 'd and 'n
LONE_LETTER = (r"(')([abce-lo-ru-zABCE-LO-RU-Z0-9_À-ÖØ-öø-ɏ\x{370}-\x{52F}\p{Lo}\p{Lm}\p{Nd}])" + _NO_WORD_BEHIND, "$1 $2$3")
PUNCTUATION_PASSES = [
    (rf"([^.])(\.)({_CLOSING}*)[{_WS}]*\z", "$1 $2 $3 "),
    (r"([:,])([^\p{Nd}])", " $1 $2"),
    (r"([:,])\z", " $1 "),
    (r"(\.\.+)", " $1 "),
    ("([;@#$%&])", " $1 "),
    ("([?!])", " $1 "),
    ("([^'])' ", "$1 ' "),
    (r"(\*)", " $1 "),
    (r"([\]\[(){}<>])", " $1 "),
    ("--", " -- "),
]
# --- fixed values: closing quotes and endings, on the text between two blanks
ENDING_PASSES = [
    ("([»”’])", " $1 "),
    ("''", " '' "),
    ('"', " '' "),
    (SQUEEZE_PATTERN, " "),
    ("([^' ])('[sSmMdD]|') ", "$1 $2 "),
    ("([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
]


def _contractions() -> list[tuple[str, list[tuple[str, str]]]]:
    """Each contraction in lower case with its passes."""
    out = []
    for pair in CONTRACTIONS_TWO:
        a, b = map(_any_case, pair.split("|"))
        out.append((pair, [(f"{_NO_WORD_BEFORE}({a})({b}){_NO_WORD_BEHIND}", "$1 $2 $3 $4")] * 2))
    a, b = map(_any_case, CONTRACTION_WANNA.split("|"))
    out.append((CONTRACTION_WANNA, [(f"{_NO_WORD_BEFORE}({a})({b})([{_WS}])", "$1 $2 $3 $4")] * 2))
    for pair in CONTRACTIONS_BLANK:
        a, b = map(_any_case, pair.split("|"))
        out.append((pair, [(f" ({a})({b}){_NO_WORD_BEHIND}", " $1 $2 $3")] * 2))
    return [(pair.replace("|", ""), passes) for pair, passes in out]


#: All passes up to the blanks around the text, and those after.
WORD_PASSES = [(" {2,}", " "), *OPENING_PASSES, LONE_LETTER, LONE_LETTER, *PUNCTUATION_PASSES]
WORD_PASSES_PADDED = [*ENDING_PASSES, *(step for _, passes in _contractions() for step in passes)]


def fold_replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements applied left to right."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def decontract(c: Column) -> Column:
    """Expand English contractions."""
    return fold_replace(c, DECONTRACTIONS)


def shorten_runs(c: Column) -> Column:
    """Four or more of one symbol (other than ASCII letters and digits)
    become three.  Java looks the named class up at once, where it would walk
    the ranges of [^a-zA-Z0-9] at every character."""
    return F.regexp_replace(c, r"(\P{Alnum})\1{3,}", "$1$1$1")


def literal_map(values: dict) -> Column:
    """A constant map of texts, as one literal that the optimiser folds."""
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in values.items())), F.lit("\n"), F.lit("\t"))


def code_point(code: Column) -> Column:
    """The character of a code point; empty for surrogates and numbers that
    are none."""
    none = (code > MAX_CODE_POINT) | code.between(*SURROGATES) | (code < 0)
    # a space stands in, since an undecodable value would fail the job
    digits = F.lpad(F.hex(F.when(none, 32).otherwise(code)), 8, "0")
    return F.when(none, "").otherwise(F.decode(F.unhex(digits), "UTF-32"))


#: An entity behind its ampersand: number sign, x of a hexadecimal number, body.
ENTITY = rf"^(#?)(x?)([^&;{_WS}]+);"


def _entity(piece: Column) -> Column:
    """What a piece of text behind an ampersand stands for."""
    number, hexadecimal, body = (F.regexp_extract(piece, ENTITY, i) for i in (1, 2, 3))
    rest = F.substr(piece, F.length(number) + F.length(hexadecimal) + F.length(body) + 2)
    digits = F.when(hexadecimal == "x", F.rlike(body, F.lit("^[0-9a-fA-F]{1,15}$"))).otherwise(F.rlike(body, F.lit("^[0-9]{1,15}$")))
    code = F.when(digits, F.when(hexadecimal == "x", F.conv(body, 16, 10)).otherwise(body)).cast("long")
    numeric = F.coalesce(F.element_at(literal_map(CODE_PAGE), code.cast("string")), code_point(code), F.lit(""))
    named = F.coalesce(F.element_at(literal_map(ENTITY_NAMES), body), F.lit(""))
    decoded = F.when((number == "#") | (hexadecimal == "x"), numeric).otherwise(named)
    return F.when(body == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(decoded, rest))


def decode_entities(c: Column) -> Column:
    """Named, decimal and hexadecimal HTML entities as their characters, in one
    pass: what an entity decodes to is not decoded again.  Unknown names and
    numbers without a character are removed."""
    pieces = F.split(c, "&", -1)
    decoded = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_entity(p)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(decoded, "")).otherwise(c)


def tokenize(c: Column, pattern: str = FAST_TOKEN_PATTERN) -> Column:
    """Tokens of a text as ``array<string>`` (T3), after decoding HTML entities
    and shortening long runs of one symbol."""
    return F.regexp_extract_all(shorten_runs(decode_entities(c)), F.lit(pattern), 0)


def _rewrite(c: Column, passes: list[tuple[str, str]]) -> Column:
    for pattern, new in passes:
        c = F.regexp_replace(c, pattern, new)
    return c


#: A literal without which a pass of the word tokenizer changes nothing.
NEEDED = {
    " {2,}": "  ", r'^"': '"', "(``)": "``", LONE_LETTER[0]: "'", r"(\.\.+)": "..", "([^'])' ": "' ", r"(\*)": "*", "--": "--",
    "''": "''", '"': '"', "([^' ])('[sSmMdD]|') ": "'", "([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ": "'",
}


def _rewrite_found(c: Column, passes: list[tuple[str, str]]) -> Column:
    """``_rewrite`` without the passes whose literal a text lacks."""
    for pattern, new in passes:
        if pattern in NEEDED:
            c = F.transform(F.array(c), lambda t: F.when(F.contains(t, F.lit(NEEDED[pattern])), F.regexp_replace(t, pattern, new)).otherwise(t))[0]  # noqa: B023
        else:
            c = F.regexp_replace(c, pattern, new)
    return c


def tokenize_words(c: Column) -> Column:
    """Words and punctuation of a text as ``array<string>`` by the Penn
    Treebank convention (T3's default tokenizer): quotes, punctuation, brackets
    and contractions become tokens of their own; of full stops only the text's
    last one."""
    out = _rewrite_found(F.concat(F.lit(" "), _rewrite_found(c, WORD_PASSES), F.lit(" ")), ENDING_PASSES)
    for word, passes in _contractions():  # few texts have one
        out = F.transform(F.array(out), lambda t: F.when(F.contains(F.lower(t), F.lit(word)), _rewrite(t, passes)).otherwise(t))[0]  # noqa: B023
    return F.filter(F.split(out, SQUEEZE_PATTERN, -1), lambda t: t != "")


def drop_tokens(tokens: Column, words: list[str]) -> Column:
    """Drop tokens found in ``words`` (an IN list, planned as a hash set)."""
    words = list(words)
    if not words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(words))


def remove_stopwords(tokens: Column, stopwords: list[str] | None = None) -> Column:
    """Drop stop words (T4)."""
    return drop_tokens(tokens, STOPWORDS_EN if stopwords is None else stopwords)


def remove_punctuations(tokens: Column) -> Column:
    """Drop tokens that are a substring of the ASCII punctuation string (T5)."""
    return F.filter(tokens, lambda t: ~F.lit(PUNCTUATION).contains(t))


def preprocess(
    text: Column,
    lower_case: bool = True,
    rm_stopwords: bool = True,
    rm_punctuations: bool = True,
    tokenizer: Callable[[Column], Column] | None = None,
    stopwords: list[str] | None = None,
) -> Column:
    """Lower-case, expand contractions, tokenise, drop placeholders, stop words
    and punctuation (T1-T5).  ``tokenizer`` maps a text column to an
    ``array<string>`` column and replaces the built-in pattern."""
    if lower_case:
        text = F.lower(text)
    text = decontract(text)
    tokens = tokenizer(text) if tokenizer else tokenize(text)
    tokens = drop_tokens(tokens, PLACEHOLDERS)
    if rm_stopwords:
        tokens = remove_stopwords(tokens, stopwords)
    if rm_punctuations:
        tokens = remove_punctuations(tokens)
    return tokens


def strip_text(c: Column) -> Column:
    """Python ``str.strip``: cut leading and trailing whitespace (S3)."""
    return F.trim(c, F.lit(WHITESPACE))


def normalize_token(t: Column, emoji_names: Column | None = None) -> Column:
    """Placeholder tokens for handles and links; a one-character token becomes
    its emoji name when ``emoji_names`` (a map column, the shipped names if
    none is given) knows it (T7)."""
    names = literal_map(EMOJI_NAMES) if emoji_names is None else emoji_names
    # every emoji is past ASCII, as few other tokens are
    single = F.when(F.octet_length(t) > 1, F.coalesce(F.element_at(names, t), t)).otherwise(t)
    low = F.lower(t)
    return (
        F.when(t.startswith("@"), F.lit("@USER"))
        .when(low.startswith("http") | low.startswith("www"), F.lit("HTTPURL"))
        .when(F.char_length(t) == 1, single)
        .when(t == "’", F.lit("'"))
        .when(t == "…", F.lit("..."))
        .otherwise(t)
    )


def normalize_post(text: Column, emoji_names: Column | None = None) -> Column:
    """Normalised post text (T8): replacements, tokenise, normalise tokens,
    re-join, contraction spacing, time and flag fixes, squeeze spaces."""
    pre = fold_replace(text, NORMALIZE_PRE)
    tokens = F.transform(tokenize(pre), lambda t: normalize_token(t, emoji_names))
    joined = F.array_join(tokens, " ")
    post = fold_replace(joined, NORMALIZE_POST)
    return F.trim(F.regexp_replace(post, SQUEEZE_PATTERN, " "))
