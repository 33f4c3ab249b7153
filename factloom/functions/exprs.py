"""Scalar functions as column expressions. Python appears only where Spark has no such function (NFC)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_URL = 2048
MAX_INT = 2_147_483_647

#: Provider error codes that are kept as they are.
PROVIDER_CODES = [
    "AI_PROVIDER_AUTHENTICATION",
    "AI_PROVIDER_DISABLED",
    "AI_PROVIDER_ERROR",
    "AI_PROVIDER_INVALID_RESPONSE",
    "AI_PROVIDER_RATE_LIMITED",
    "AI_PROVIDER_RESPONSE_INVALID",
    "AI_PROVIDER_SAFETY_BLOCKED",
    "AI_PROVIDER_TIMEOUT",
    "AI_PROVIDER_TRANSPORT",
    "AI_PROVIDER_UNAVAILABLE",
]


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def decoded_base64(c: Column) -> Column:
    """Bytes of strictly padded base64, else null."""
    whole = (F.length(c) % 4 == 0) & c.rlike(r"^[A-Za-z0-9+/]*={0,2}\z")
    return F.when(whole, F.try_to_binary(c, F.lit("base64")))


def encoded_base64(c: Column) -> Column:
    """Base64 of bytes in one line."""
    return F.translate(F.base64(c), "\r\n", "")


def media_type(c: Column) -> Column:
    return F.lower(strip(F.split_part(c, F.lit(";"), F.lit(1))))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host in lower case, without user, port and trailing dots; empty where there is none."""
    bare = F.regexp_replace(F.regexp_replace(_authority(url), "^.*@", ""), ":[0-9]*$", "")
    return F.lower(F.regexp_replace(bare, "[.]+$", ""))


def is_ip(name: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return name.rlike(rf"^{octet}(\.{octet}){{3}}$") | name.contains(":")


def valid_hostname(name: Column) -> Column:
    labels = F.forall(F.split(name, "[.]"), lambda x: x.rlike(r"^[\p{L}\p{N}]([\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?$"))
    return (F.length(name) <= 253) & name.contains(".") & labels & ~is_ip(name)


def plain_url_text(url: Column) -> Column:
    """Short enough, and without white space or control characters."""
    return (F.length(url) <= MAX_URL) & (F.length(url) > 0) & ~url.rlike(r"(?U)[\s\x00-\x1f\x7f-\x9f]")


def _port_ok(url: Column) -> Column:
    return F.regexp_extract(_authority(url), ":([0-9]*)$", 1).isin("", "443")


def canonical_origin(url: Column) -> Column:
    """https://host of a valid site root, else null."""
    root = url.rlike(r"^(?i:https)://[^/?#@]+/?$") & plain_url_text(url) & _port_ok(url)
    return F.when(root & valid_hostname(host(url)) & (host(url) != "localhost"), F.concat(F.lit("https://"), host(url)))


def canonical_query(query: Column) -> Column:
    fields = F.filter(F.split(query, "&"), lambda x: x != "")
    pairs = F.transform(fields, lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("k"), F.substring(x, F.length(F.split_part(x, F.lit("="), F.lit(1))) + 2, F.length(x)).alias("v")))
    decoded = F.transform(pairs, lambda p: F.struct(F.coalesce(F.try_url_decode(p["k"]), p["k"]).alias("k"), F.coalesce(F.try_url_decode(p["v"]), p["v"]).alias("v")))
    return F.array_join(F.transform(F.array_sort(decoded), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _encoded(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower host, no fragment and default port, path / if empty, query fields sorted and encoded anew; null if not allowed in form."""
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    query = canonical_query(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    out = F.concat(F.lit("https://"), host(url), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    fine = plain_url_text(url) & url.rlike("^(?i:https)://") & valid_hostname(host(url)) & ~_authority(url).contains("@") & _port_ok(url)
    return F.when(fine & plain_url_text(out), out)


def url_policy(url: Column) -> Column:
    """Whether a source URL may be fetched, its host's place on the allow-list apart."""
    name = host(url)
    return F.coalesce(plain_url_text(url) & url.rlike("^(?i:https)://") & name.contains(".") & ~is_ip(name) & ~_authority(url).contains("@") & ~url.rlike("#.") & _port_ok(url), F.lit(False))


def _folds() -> tuple[str, str, dict[str, str]]:
    """What case folding makes of characters: those that become one other character (from, to), and those that become several."""
    changed = {c: c.casefold() for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.casefold() != c}
    one = {c: f for c, f in changed.items() if len(f) == 1}
    return "".join(one), "".join(one.values()), {c: f for c, f in changed.items() if len(f) > 1}


#: From Unicode's rules by way of Python: equal texts but for case fold to one text, also where lower case does not (ß, ſ, K, ligatures).
FOLD_FROM, FOLD_TO, FOLD_LONG = _folds()


def casefold(c: Column) -> Column:
    """Full case folding. Plain text is only lower-cased; the few characters that become several are only looked for where one stands."""
    single = F.translate(c, FOLD_FROM, FOLD_TO)
    several = reduce(lambda x, item: F.replace(x, F.lit(item[0]), F.lit(item[1])), FOLD_LONG.items(), single)
    return F.when(~c.rlike(r"[^\x00-\x7F]"), F.lower(c)).when(c.rlike("[" + "".join(FOLD_LONG) + "]"), several).otherwise(single)


def search_tokens(query: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(casefold(query), F.lit("[a-z0-9]+"), F.lit(0)))


def relevance_score(tokens: Column, url: Column) -> Column:
    folded = casefold(url)
    return F.size(F.filter(tokens, lambda x: F.contains(folded, x)))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def normalized_text(c: Column) -> Column:
    """NFC, line feeds only, no tabs, hard spaces, control or format characters; no space before line ends, at most one empty line; one final line feed."""
    return tidy_text(nfc(c))


def tidy_text(c: Column) -> Column:
    """What normalized_text makes of a text in NFC."""
    x = F.regexp_replace(c, "\r\n?", "\n")
    x = F.translate(x, " \t", "  ")
    x = F.regexp_replace(x, r"[\p{Cc}\p{Cf}\x{890}\x{891}\x{13439}-\x{1343F}&&[^\n]]", "")  # format characters that are newer than Java's tables stand by number
    x = F.regexp_replace(x, r" +(?=\n|\z)", "")
    x = strip(F.regexp_replace(x, "\n{3,}", "\n\n"))
    return F.when(x == "", "").otherwise(F.concat(x, F.lit("\n")))


def codepoint_slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def non_blank(c: Column, rule: str) -> Column:
    """rule: 'unicode' (any white space is blank), 'spaces' (only spaces are), 'ascii' (a character other than ASCII white space)."""
    return {"unicode": strip(c) != "", "spaces": F.trim(c) != "", "ascii": c.rlike(r"\S")}[rule]


def is_hex64(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def key_pattern(c: Column, kind: str) -> Column:
    """Whether a value has the form of its kind: provider_key, error_code or currency."""
    patterns = {"provider_key": "^[a-z][a-z0-9_.-]*$", "error_code": "^[A-Z][A-Z0-9_]*$", "currency": "^[A-Z]{3}$"}
    return c.rlike(patterns[kind]) & (F.length(c) <= 100)


def cost(c: Column) -> Column:
    """Decimal of a plain non-negative number with at most 12 digits before and 6 after the point, else null."""
    return F.when(c.rlike(r"^(0|[1-9][0-9]{0,11})([.][0-9]{1,6})?$"), c.try_cast("decimal(18,6)"))


def bounded(c: Column, limit: int) -> Column:
    x = F.substring(F.trim(F.regexp_replace(c, "[^ -~]", "")), 1, limit)
    return F.nullif(x, F.lit(""))


def location_reference(snapshot: Column, chunk: Column, start: Column, end: Column) -> Column:
    return F.format_string("source-snapshot:%d#chunk=%d&chars=%d-%d", snapshot, chunk, start, end)


def option_label(position: Column) -> Column:
    return F.char(F.lit(65) + position)


def duration_ms(begin: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.timestamp_diff("MILLISECOND", begin, end))


def token_usage_valid(tokens_in: Column, tokens_out: Column, total: Column) -> Column:
    each = [c.isNull() | c.between(0, MAX_INT) for c in (tokens_in, tokens_out, total)]
    return each[0] & each[1] & each[2] & F.coalesce(total == tokens_in + tokens_out, F.lit(True))


def request_id_valid(c: Column) -> Column:
    return F.length(c).between(1, 100) & (strip(c) == c) & ~c.rlike(r"(?U)[\x00-\x1f\x7f-\x9f]|[\s&&[^ ]]")


def artifact_name(document_id: Column) -> Column:
    return F.concat(F.lit("content-document-"), document_id.cast("string"), F.lit(".pdf"))
