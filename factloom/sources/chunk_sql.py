"""Chunks of whole texts as SQL for the oracles: a recursive walk over each text."""

from __future__ import annotations

_CHUNKS = """(WITH RECURSIVE c(id, text, position, char_start, char_end) AS (
 SELECT id, text, 0, 0, e FROM (SELECT id, text, 0 AS s FROM {source}) d, LATERAL (SELECT {end} AS e) z WHERE length(text) > 0
 UNION ALL SELECT id, text, position + 1, s, e FROM (SELECT id, text, position, CASE WHEN char_end - 100 > char_start THEN char_end - 100 ELSE char_end END AS s FROM c WHERE char_end < length(text)) d, LATERAL (SELECT {end} AS e) z)
 SELECT id, position, char_start, char_end, substr(text, char_start + 1, char_end - char_start) AS text, sha256(substr(text, char_start + 1, char_end - char_start)) AS sha256 FROM c)"""
_W = "substr(text, s + 501, 500)"
_LAST = "s + 500 + length({w}) - strpos(reverse({w}), {m}) + 1"
_SOFT = f"CASE WHEN strpos({_W}, chr(10) || chr(10)) > 0 THEN {_LAST.format(w=_W, m='chr(10) || chr(10)')} WHEN strpos({_W}, chr(10)) > 0 THEN {_LAST.format(w=_W, m='chr(10)')} WHEN strpos({_W}, ' ') > 0 THEN {_LAST.format(w=_W, m=chr(39) + ' ' + chr(39))} ELSE s + 1000 END"
_END = f"CASE WHEN s + 1000 >= length(text) THEN length(text) WHEN NOT regexp_matches(substr(text, s + 1, ({_SOFT}) - s), '[^\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]') THEN s + 1000 ELSE {_SOFT} END"


def chunk_sql(source: str) -> str:
    """id, position, char_start, char_end, text and sha256 of the chunks of source (id, text)."""
    return _CHUNKS.replace("{source}", source).replace("{end}", _END)
