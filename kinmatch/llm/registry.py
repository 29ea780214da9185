"""Queries and SQL of this subpackage."""

from __future__ import annotations

from kinmatch.llm import chat_format, decontaminate, language_id, line_dedup, mpeg_audio, ngram_join, packing, suffix_dedup, token_records, url_filter

QUERIES = {
    "op1_mpeg_audio": mpeg_audio.op1_mpeg_audio,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_packing": packing.op4_packing,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_chat_format": chat_format.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_language_id": language_id.op9_language_id,
    "op10_token_records": token_records.op10_token_records,
}
ORACLE_SQL = {**chat_format.ORACLE_SQL, **line_dedup.ORACLE_SQL, **url_filter.ORACLE_SQL}
