"""Oracle SQL of the round trips: that of what is written."""

from __future__ import annotations

from . import sql_behavior, sql_report, sql_text

SQL = {
    "activity_csv_roundtrip": sql_behavior.SQL["event_timeline"],
    "results_roundtrip": sql_report.SQL["array_text_parse"],
    "vocabulary_roundtrip": f"SELECT token, y_bg FROM ({sql_text.SQL['token_counts']}) WHERE y_bg > 0",
    "top_words_roundtrip": f"SELECT token AS word FROM ({sql_text.SQL['log_odds_top']})",
    "corpus_roundtrip": f"SELECT md5(trim(text, {sql_text.q(sql_text.WHITESPACE)})) AS digest, length(trim(text, {sql_text.q(sql_text.WHITESPACE)})) AS chars FROM documents WHERE text IS NOT NULL",
    "labelled_roundtrip": f"WITH {sql_text.LABELLED} SELECT labels::INTEGER AS labels, md5(text) AS text FROM lab",
    "id_list_roundtrip": "SELECT event_id + 1530101424356347904 AS id FROM events",
    "scores_file_roundtrip": f"SELECT token, z FROM ({sql_text.SQL['log_odds']})",
    "stance_tokens_roundtrip": f"SELECT token AS word FROM ({sql_text.SQL['stance_tokens']})",
    "scores_roundtrip": sql_text.SQL["stance_author_mean"],
}
