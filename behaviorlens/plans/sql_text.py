"""Oracle SQL for the text-stage queries (DuckDB; RE2 regular expressions)."""

from __future__ import annotations

import re

from ..functions.text import (
    CODE_PAGE,
    DECONTRACTIONS,
    EMOJI_NAMES,
    ENTITY,
    ENTITY_NAMES,
    NORMALIZE_POST,
    NORMALIZE_PRE,
    PLACEHOLDERS,
    PUNCTUATION,
    SQUEEZE_PATTERN,
    STOPWORDS_EN,
    TOKEN_PATTERN,
    WHITESPACE,
    WORD_PASSES,
    WORD_PASSES_PADDED,
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def replace_chain(expr: str, pairs) -> str:
    for old, new in pairs:
        expr = f"replace({expr}, {q(old)}, {q(new)})"
    return expr


# DuckDB's regular expressions have no back references: runs of these symbols.
RUN_SYMBOLS = "!?.,-_=*+#~$%&@:;/|()<> " + "ñéèêçáàíóúüöäßôîûâï"


def shortened(expr: str) -> str:
    for c in RUN_SYMBOLS:
        expr = f"regexp_replace({expr}, '[{c}]{{4,}}', '{c * 3}', 'g')"
    return expr


def map_sql(values: dict, key) -> str:
    return f"map([{', '.join(map(key, values))}], {sql_list(list(values.values()))})"


def entities_decoded(text: str) -> str:
    part = [f"regexp_extract(p, {q(ENTITY)}, {i})" for i in range(4)]
    code = f"TRY_CAST(CASE WHEN {part[2]} = 'x' THEN '0x' || {part[3]} ELSE {part[3]} END AS BIGINT)"
    point = f"CASE WHEN {code} NOT BETWEEN 0 AND 1114111 OR {code} BETWEEN 55296 AND 57343 THEN '' ELSE chr({code}::INT) END"
    number = f"coalesce({map_sql(CODE_PAGE, str)}[{code}], {point}, '')"
    name = f"coalesce({map_sql(ENTITY_NAMES, q)}[{part[3]}], '')"
    entity = f"CASE WHEN {part[3]} = '' THEN '&' || p ELSE (CASE WHEN {part[1]} = '#' OR {part[2]} = 'x' THEN {number} ELSE {name} END) || substr(p, length({part[0]}) + 1) END"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {entity} END), '')"


# RE2 is linear at any length; its programs are too small for the bounds.
UNBOUNDED = re.sub(r"\{1,\d+\}", "+", TOKEN_PATTERN)


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({shortened(entities_decoded(text))}, {q(UNBOUNDED)}, 0)"


def rewritten(text: str, passes) -> str:
    for pattern, new in passes:
        new = re.sub(r"\$(\d)", r"\\\1", new)
        text = f"regexp_replace({text}, {q(pattern)}, {q(new)}, 'g')"
    return text


def words_sql(text: str) -> str:
    padded = f"' ' || {rewritten(text, WORD_PASSES)} || ' '"
    return f"list_filter(string_split_regex({rewritten(padded, WORD_PASSES_PADDED)}, {q(SQUEEZE_PATTERN)}), lambda x: x <> '')"


def preprocess_sql(text: str, tokens=tokens_sql) -> str:
    toks = tokens(replace_chain(f"lower({text})", DECONTRACTIONS))
    toks = f"list_filter({toks}, lambda x: NOT list_contains({sql_list(PLACEHOLDERS)}, x))"
    toks = f"list_filter({toks}, lambda x: NOT list_contains({sql_list(STOPWORDS_EN)}, x))"
    toks = f"list_filter({toks}, lambda x: NOT contains({q(PUNCTUATION)}, x))"
    return toks


DOCS = "docs AS (SELECT d.doc_id, d.text, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def scores_ctes(prefix: str, flags_select: str, background: bool) -> str:
    alpha = "CASE WHEN (SELECT count(*) FILTER (WHERE in_bg) FROM {p}flags) > 0 THEN y_bg ELSE y_i + y_j END" if background else "y_i + y_j"
    alpha = alpha.format(p=prefix)
    return f"""{prefix}flags AS ({flags_select}),
{prefix}tok AS (SELECT in_i, in_j, in_bg, unnest({preprocess_sql('text')}) AS token
         FROM {prefix}flags WHERE in_i OR in_j OR in_bg),
{prefix}counts AS (SELECT token, count(*) FILTER (WHERE in_i) AS y_i, count(*) FILTER (WHERE in_j) AS y_j,
                 count(*) FILTER (WHERE in_bg) AS y_bg FROM {prefix}tok GROUP BY token),
{prefix}c2 AS (SELECT *, {alpha} AS alpha FROM {prefix}counts),
{prefix}tot AS (SELECT sum(y_i) AS n_i, sum(y_j) AS n_j, sum(alpha) AS a0 FROM {prefix}c2),
{prefix}sc AS (
  SELECT token, y_i, y_j, alpha,
         CASE WHEN defined THEN log10((y_i + alpha) / (n_i + a0 - y_i - alpha)) - log10((y_j + alpha) / (n_j + a0 - y_j - alpha)) END AS delta,
         CASE WHEN defined THEN 1.0 / (y_i + alpha) + 1.0 / (y_j + alpha) END AS sigma_2,
         CASE WHEN defined THEN (log10((y_i + alpha) / (n_i + a0 - y_i - alpha)) - log10((y_j + alpha) / (n_j + a0 - y_j - alpha)))
           / sqrt(1.0 / (y_i + alpha) + 1.0 / (y_j + alpha)) END AS z
  FROM (SELECT *, y_i + alpha > 0 AND y_j + alpha > 0 AND n_i + a0 - y_i - alpha > 0 AND n_j + a0 - y_j - alpha > 0 AS defined
        FROM {prefix}c2, {prefix}tot) WHERE y_i > 0 OR y_j > 0)"""


def toxic_flags_select(background: bool | str) -> str:
    bg = background if isinstance(background, str) else "TRUE" if background else "FALSE"
    return f"SELECT text, coalesce(toxic = 1, FALSE) AS in_i, coalesce(toxic = 0, FALSE) AS in_j, {bg} AS in_bg FROM docs"


def stance_flags_select(side: int) -> str:
    others = ", ".join(str(s) for s in (1, 2, 3) if s != side)
    return (
        f"SELECT text, coalesce(quality + 2 * toxic = {side}, FALSE) AS in_i, "
        f"coalesce(quality + 2 * toxic IN ({others}), FALSE) AS in_j, FALSE AS in_bg FROM docs"
    )


DECONTRACT_TOKENS = f"""WITH {DOCS}, p AS (SELECT doc_id, {preprocess_sql('text')} AS toks FROM docs)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM p"""

WORD_TOKENS = f"""WITH p AS (SELECT doc_id, {preprocess_sql('text', words_sql)} AS toks FROM documents)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS tokens FROM p"""

TOKEN_COUNTS = f"""WITH {DOCS}, {scores_ctes('', toxic_flags_select(True), True)}
SELECT token, y_i, y_j, y_bg FROM counts"""


def _normalize_sql(text: str) -> str:
    pre = replace_chain(text, NORMALIZE_PRE)
    case = (
        "CASE WHEN starts_with(t, '@') THEN '@USER' "
        "WHEN starts_with(lower(t), 'http') OR starts_with(lower(t), 'www') THEN 'HTTPURL' "
        f"WHEN length(t) = 1 THEN coalesce({map_sql(EMOJI_NAMES, q)}[t], t) "
        "WHEN t = '’' THEN '''' WHEN t = '…' THEN '...' ELSE t END"
    )
    joined = f"array_to_string(list_transform({tokens_sql(pre)}, lambda t: {case}), ' ')"
    post = replace_chain(joined, NORMALIZE_POST)
    return f"trim(regexp_replace({post}, {q(SQUEEZE_PATTERN)}, ' ', 'g'))"


NORMALIZED_POSTS = f"SELECT conv_id, turn, {_normalize_sql('text')} AS text_normalized FROM conversations"

ROUNDED = "token, y_i, y_j, alpha, round(delta, 6) AS delta, round(sigma_2, 6) AS sigma_2, round(z, 6) AS z"

LOG_ODDS = f"WITH {DOCS}, {scores_ctes('', toxic_flags_select(False), False)} SELECT {ROUNDED} FROM sc"
# Documents of one source as background: tokens it lacks may be undefined.
LOG_ODDS_UNDEFINED = f"WITH {DOCS}, {scores_ctes('', toxic_flags_select("source = 'src1'"), True)} SELECT {ROUNDED} FROM sc"
LOG_ODDS_BACKGROUND = f"WITH {DOCS}, {scores_ctes('', toxic_flags_select(True), True)} SELECT {ROUNDED} FROM sc"


def _top_sql(bottom: bool) -> str:
    order = "z ASC, token ASC" if bottom else "z DESC, token ASC"
    return f"""WITH {DOCS}, {scores_ctes('', toxic_flags_select(False), False)}
SELECT CAST(row_number() OVER (ORDER BY {order}) AS BIGINT) AS rank, token, round(z, 6) AS z
FROM sc ORDER BY {order} LIMIT 10"""


def _stance_tokens_sql() -> str:
    ctes = ",\n".join(
        [DOCS, scores_ctes("a_", stance_flags_select(1), False), scores_ctes("b_", stance_flags_select(2), False)]
    )
    picks = []
    for p in ("a_", "b_"):
        for order in ("z DESC, token ASC", "z ASC, token ASC"):
            picks.append(f"(SELECT token FROM {p}sc ORDER BY {order} LIMIT 10)")
    picks += [f"(SELECT {q(w)} AS token)" for w in PLACEHOLDERS]
    return f"WITH {ctes}\nSELECT DISTINCT token FROM (\n" + "\nUNION ALL\n".join(picks) + "\n) u"


LABELLED = f"""{DOCS}, lab AS (
  SELECT *, CAST(quality + 2 * toxic AS BIGINT) AS labels,
         CAST(CASE WHEN quality + 2 * toxic IN (2, 3) THEN 0 ELSE quality + 2 * toxic END AS BIGINT) AS label,
         CASE WHEN ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4))::INTEGER % 10 < 3 THEN 'test' ELSE 'train' END AS split
  FROM docs WHERE quality IS NOT NULL AND toxic IS NOT NULL)"""

STANCE_LABEL_REMAP = f"WITH {LABELLED} SELECT doc_id, labels, label FROM lab"
STANCE_SPLIT = f"WITH {LABELLED} SELECT doc_id, label, split FROM lab"
STANCE_AUTHOR_MEAN = f"""WITH {LABELLED}
SELECT source AS author_id, avg(CAST(quality AS DOUBLE)) AS stance_propaganda FROM lab
WHERE source IS NOT NULL GROUP BY source"""
STANCE_ACCURACY = f"""WITH {LABELLED}
SELECT split, count(*) AS n,
       round(avg(CASE WHEN (CASE WHEN CAST(quality AS DOUBLE) > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM lab GROUP BY split"""

def _post_tokens(text: str) -> str:
    whole = f"coalesce({text}, '')"
    return tokens_sql(f"lower(trim({whole}, {q(WHITESPACE)}))")


# The exact-vocabulary model: tokens of the training posts and the stance words.
TABLE_MODEL = f"""words AS MATERIALIZED ({_stance_tokens_sql()}), {LABELLED},
train AS MATERIALIZED (SELECT doc_id AS post, label, {_post_tokens("text")} AS toks FROM lab WHERE split = 'train'),
counts AS (
  SELECT token, count(*) FILTER (WHERE label = 1) AS n_1, count(*) FILTER (WHERE label <> 1) AS n_0
  FROM (SELECT label, unnest(toks) AS token FROM train) GROUP BY token),
vocabulary AS MATERIALIZED (
  SELECT coalesce(c.token, w.token) AS token, coalesce(n_1, 0) AS n_1, coalesce(n_0, 0) AS n_0,
         (c.token IS NOT NULL)::INT + (w.token IS NOT NULL)::INT AS copies
  FROM counts c FULL JOIN words w ON c.token = w.token),
feature_totals AS (SELECT sum(n_1 * copies) + sum(copies) AS all_1, sum(n_0 * copies) + sum(copies) AS all_0 FROM vocabulary),
model AS MATERIALIZED (
  SELECT token, copies * (ln((n_1 + 1) / all_1) - ln((n_0 + 1) / all_0)) AS weight FROM vocabulary, feature_totals),
prior AS (SELECT ln(count(*) FILTER (WHERE label = 1) + 1) - ln(count(*) FILTER (WHERE label <> 1) + 1) AS intercept FROM train)"""


def scored(posts: str) -> str:
    """Rows of ``posts`` (post, text, ...) with ``score``."""
    return f"""{TABLE_MODEL},
post AS MATERIALIZED ({posts}),
margin AS (
  SELECT post, sum(weight) AS margin FROM (SELECT post, unnest({_post_tokens("text")}) AS token FROM post) JOIN model USING (token) GROUP BY post),
scored AS (
  SELECT post.*, 1 / (1 + exp(-(intercept + coalesce(margin, 0)))) AS score FROM post LEFT JOIN margin USING (post), prior)"""


STANCE_TABLE_SCORES = f"""WITH {scored("SELECT row_number() OVER () AS post, conv_id, turn, text FROM conversations")}
SELECT conv_id, turn, round(score, 6) AS stance_propaganda FROM scored"""
STANCE_TABLE_AUTHORS = f"""WITH {scored("SELECT row_number() OVER () AS post, source AS author_id, text FROM documents")}
SELECT author_id, round(avg(score), 6) AS stance_propaganda FROM scored WHERE author_id IS NOT NULL GROUP BY author_id"""
STANCE_TABLE_ACCURACY = f"""WITH {scored("SELECT doc_id AS post, label, text FROM lab WHERE split = 'test'")}
SELECT count(*) AS n, round(avg(((score > 0.5)::INT = label)::INT), 9) AS accuracy FROM scored"""


def _epochs_sql(epochs: int, rate: float) -> str:
    """Gradient steps written out one after the other."""

    def margins(k: int, of: str) -> str:
        return f"""SELECT p.post, label, coalesce(sum(x * weight), 0) + (SELECT b FROM bias{k}) AS margin
  FROM {of}_post p LEFT JOIN (SELECT post, x, weight FROM {of}_feature JOIN weight{k} USING (token)) f ON f.post = p.post GROUP BY p.post, label"""

    def feature(of: str) -> str:
        return f"""{of}_feature AS MATERIALIZED (
  SELECT post, token, count(*) / any_value(size)::DOUBLE AS x FROM (SELECT post, len(toks) AS size, unnest(toks) AS token FROM {of}_post) GROUP BY post, token)"""

    ctes = [
        TABLE_MODEL,
        "train_post AS (SELECT * FROM train)",
        f"test_post AS MATERIALIZED (SELECT doc_id AS post, label, {_post_tokens('text')} AS toks FROM lab WHERE split = 'test')",
        feature("train"),
        feature("test"),
        "weight0 AS (SELECT token, copies, 0::DOUBLE AS weight FROM vocabulary)",
        "bias0 AS (SELECT 0::DOUBLE AS b)",
    ]
    for k in range(epochs):
        ctes += [
            f"error{k} AS MATERIALIZED (SELECT post, (label = 1)::INT - 1 / (1 + exp(-margin)) AS error FROM ({margins(k, 'train')}))",
            f"step{k} AS (SELECT token, sum(x * error) * ({rate}::DOUBLE / (SELECT count(*) FROM train)) AS step FROM train_feature JOIN error{k} USING (post) GROUP BY token)",
            f"weight{k + 1} AS MATERIALIZED (SELECT token, copies, weight + coalesce(step, 0) * copies * copies AS weight FROM weight{k} LEFT JOIN step{k} USING (token))",
            f"bias{k + 1} AS MATERIALIZED (SELECT (SELECT b FROM bias{k}) + {rate}::DOUBLE / (SELECT count(*) FROM train) * sum(error) AS b FROM error{k})",
        ]
    parts = [
        f"""SELECT {k} AS epoch, count(*) AS n, round(avg(((score > 0.5)::INT = label)::INT), 9) AS accuracy,
       round(-avg(ln(CASE WHEN label = 1 THEN score ELSE 1 - score END)), 6) AS log_loss
FROM (SELECT label, 1 / (1 + exp(-margin)) AS score FROM ({margins(k, 'test')}))"""
        for k in range(1, epochs + 1)
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


SQL = {
    "decontract_tokens": DECONTRACT_TOKENS,
    "word_tokens": WORD_TOKENS,
    "post_tokens": f"SELECT conv_id, turn, array_to_string({_post_tokens('text')}, ' ') AS tokens FROM conversations",
    "token_counts": TOKEN_COUNTS,
    "normalized_posts": NORMALIZED_POSTS,
    "log_odds": LOG_ODDS,
    "log_odds_background": LOG_ODDS_BACKGROUND,
    "log_odds_undefined": LOG_ODDS_UNDEFINED,
    "log_odds_top": _top_sql(False),
    "log_odds_bottom": _top_sql(True),
    "stance_tokens": _stance_tokens_sql(),
    "stance_label_remap": STANCE_LABEL_REMAP,
    "stance_split": STANCE_SPLIT,
    "stance_author_mean": STANCE_AUTHOR_MEAN,
    "stance_accuracy": STANCE_ACCURACY,
    "stance_table_scores": STANCE_TABLE_SCORES,
    "stance_table_authors": STANCE_TABLE_AUTHORS,
    "stance_table_accuracy": STANCE_TABLE_ACCURACY,
    "stance_epochs": _epochs_sql(3, 50.0),
}
