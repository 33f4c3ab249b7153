"""The functions by their SQL names, for spark.sql."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from factloom.functions.exprs import FOLD_FROM, FOLD_LONG, FOLD_TO

_STRIP = r"regexp_replace(x, r'(?U)^\s+|\s+\z', '')"
_ENCODED = "replace(replace(url_encode({v}), '*', '%2A'), '%7E', '~')"
_FIELD = "coalesce(try_url_decode({v}), {v})"
_IP = r"(x RLIKE r'^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$' OR contains(x, ':'))"

_FOLDED = f"CASE WHEN NOT x RLIKE r'[^\\x00-\\x7F]' THEN lower(x) ELSE {reduce(lambda x, item: f"replace({x}, '{item[0]}', '{item[1]}')", FOLD_LONG.items(), f"translate(x, '{FOLD_FROM}', '{FOLD_TO}')")} END"

#: SQL functions as expressions of their parameters; each comes after those that it uses.
SQL_FUNCTIONS = {
    "fl_sha256": ("x STRING", "STRING", "sha2(x, 256)"),
    "fl_base64": ("x STRING", "BINARY", "CASE WHEN length(x) % 4 = 0 AND x RLIKE r'^[A-Za-z0-9+/]*={0,2}\\z' THEN try_to_binary(x, 'base64') END"),
    "fl_strip": ("x STRING", "STRING", _STRIP),
    "fl_media_type": ("x STRING", "STRING", "lower(fl_strip(split_part(x, ';', 1)))"),
    "fl_authority": ("x STRING", "STRING", "regexp_extract(x, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"),
    "fl_host": ("x STRING", "STRING", "lower(regexp_replace(regexp_replace(regexp_replace(fl_authority(x), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''))"),
    "fl_valid_hostname": ("x STRING", "BOOLEAN", rf"length(x) <= 253 AND contains(x, '.') AND forall(split(x, '[.]'), l -> l RLIKE r'^[\p{{L}}\p{{N}}]([\p{{L}}\p{{N}}-]{{0,61}}[\p{{L}}\p{{N}}])?$') AND NOT {_IP}"),
    "fl_plain_url": ("x STRING", "BOOLEAN", r"length(x) BETWEEN 1 AND 2048 AND NOT x RLIKE r'(?U)[\s\x00-\x1f\x7f-\x9f]'"),
    "fl_port_ok": ("x STRING", "BOOLEAN", "regexp_extract(fl_authority(x), ':([0-9]*)$', 1) IN ('', '443')"),
    "fl_canonical_origin": ("x STRING", "STRING", "CASE WHEN x RLIKE '^(?i:https)://[^/?#@]+/?$' AND fl_plain_url(x) AND fl_port_ok(x) AND fl_valid_hostname(fl_host(x)) AND fl_host(x) <> 'localhost' THEN concat('https://', fl_host(x)) END"),
    "fl_canonical_query": (
        "x STRING", "STRING",
        f"array_join(transform(array_sort(transform(filter(split(x, '&'), f -> f <> ''), f -> named_struct('k', {_FIELD.format(v='split_part(f, chr(61), 1)')}, 'v', {_FIELD.format(v='substring(f, length(split_part(f, chr(61), 1)) + 2, length(f))')}))), p -> concat({_ENCODED.format(v='p.k')}, '=', {_ENCODED.format(v='p.v')})), '&')",
    ),
    "fl_url_path": ("x STRING", "STRING", "coalesce(nullif(regexp_extract(x, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/')"),
    "fl_joined_url": ("x STRING, q STRING", "STRING", "concat('https://', fl_host(x), fl_url_path(x), CASE WHEN q = '' THEN '' ELSE concat('?', q) END)"),
    "fl_canonical_url": (
        "x STRING", "STRING",
        r"CASE WHEN fl_plain_url(x) AND x RLIKE '^(?i:https)://' AND fl_valid_hostname(fl_host(x)) AND NOT contains(fl_authority(x), '@') AND fl_port_ok(x) AND fl_plain_url(fl_joined_url(x, fl_canonical_query(regexp_extract(x, r'^[^?#]*\?([^#]*)', 1)))) THEN fl_joined_url(x, fl_canonical_query(regexp_extract(x, r'^[^?#]*\?([^#]*)', 1))) END",
    ),
    "fl_casefold": ("x STRING", "STRING", _FOLDED),
    "fl_tokens": ("x STRING", "ARRAY<STRING>", "array_distinct(regexp_extract_all(fl_casefold(x), '[a-z0-9]+', 0))"),
    "fl_relevance": ("q STRING, u STRING", "INT", "size(filter(fl_tokens(q), t -> contains(fl_casefold(u), t)))"),
    "fl_slice": ("x STRING, a INT, b INT", "STRING", "substring(x, a + 1, b - a)"),
    "fl_non_blank": ("x STRING", "BOOLEAN", "fl_strip(x) <> ''"),
    "fl_hex64": ("x STRING", "BOOLEAN", "x RLIKE '^[0-9a-f]{64}$'"),
    "fl_provider_key": ("x STRING", "BOOLEAN", "x RLIKE '^[a-z][a-z0-9_.-]*$' AND length(x) <= 100"),
    "fl_error_code": ("x STRING", "BOOLEAN", "x RLIKE '^[A-Z][A-Z0-9_]*$' AND length(x) <= 100"),
    "fl_currency": ("x STRING", "BOOLEAN", "x RLIKE '^[A-Z]{3}$'"),
    "fl_cost": ("x STRING", "DECIMAL(18,6)", "CASE WHEN x RLIKE '^(0|[1-9][0-9]{0,11})([.][0-9]{1,6})?$' THEN try_cast(x AS DECIMAL(18,6)) END"),
    "fl_bounded": ("x STRING, n INT", "STRING", "nullif(substring(trim(regexp_replace(x, '[^ -~]', '')), 1, n), '')"),
    "fl_location": ("s BIGINT, c BIGINT, a INT, b INT", "STRING", "format_string('source-snapshot:%d#chunk=%d&chars=%d-%d', s, c, a, b)"),
    "fl_option_label": ("i INT", "STRING", "chr(65 + i)"),
    "fl_duration_ms": ("a TIMESTAMP, b TIMESTAMP", "BIGINT", "greatest(0L, timestampdiff(MILLISECOND, a, b))"),
    "fl_token_total": (
        "i BIGINT, o BIGINT, n BIGINT", "BOOLEAN",
        "coalesce(i BETWEEN 0 AND 2147483647, TRUE) AND coalesce(o BETWEEN 0 AND 2147483647, TRUE) AND coalesce(n BETWEEN 0 AND 2147483647, TRUE) AND coalesce(n = i + o, TRUE)",
    ),
    "fl_request_id_valid": ("x STRING", "BOOLEAN", r"length(x) BETWEEN 1 AND 100 AND fl_strip(x) = x AND NOT x RLIKE r'(?U)[\x00-\x1f\x7f-\x9f]|[\s&&[^ ]]'"),
    "fl_artifact_name": ("i BIGINT", "STRING", "concat('content-document-', i, '.pdf')"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions, and the Arrow functions for NFC and chunk offsets, callable from SQL in this session."""
    from factloom.functions.exprs import nfc
    from factloom.operators.text import chunk_offsets

    spark.udf.register("fl_nfc", nfc)
    spark.udf.register("fl_chunk_offsets", chunk_offsets)
    for name, (parameters, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [*SQL_FUNCTIONS, "fl_nfc", "fl_chunk_offsets"]
