"""Strict contracts of what comes in: model outputs as JSON, and requests as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import exprs as E

MAX_INT = 2_147_483_647
#: How many claims an output has and citations a claim, and how long a claim's texts are, at most.
MAX_CLAIMS, MAX_CITATIONS = 50, 10
TEXTS = {"object_value": 1_000, "predicate": 500, "subject": 500, "statement": 2_000}

_CITATION = "OBJECT<char_end: BIGINT, char_start: BIGINT, source_chunk_id: BIGINT>"
_OPTIONAL = "(STRING|VOID)"
_CLAIM = rf"^OBJECT<citations: ARRAY<.*>(, object_value: {_OPTIONAL})?(, predicate: {_OPTIONAL})?, statement: STRING(, subject: {_OPTIONAL})?>$"


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def _text_ok(value: Column, limit: int) -> Column:
    return value.isNull() | ((F.length(value) <= limit) & (E.strip(value) != ""))


def _citation_ok(c: Column) -> Column:
    """Exactly three whole numbers in range; a number with a point, a string or a further field is refused."""
    start, end, chunk = (_get(c, name, "bigint") for name in ("char_start", "char_end", "source_chunk_id"))
    return (F.schema_of_variant(c) == _CITATION) & (start >= 0) & (end > 0) & chunk.between(1, MAX_INT)


def _claim_ok(c: Column) -> Column:
    cited = _get(c, "citations", "array<variant>")
    texts = reduce(lambda a, b: a & b, [_text_ok(_get(c, name, "string"), limit) for name, limit in TEXTS.items()])
    return F.schema_of_variant(c).rlike(_CLAIM) & texts & F.size(cited).between(1, MAX_CITATIONS) & F.forall(cited, lambda x: F.coalesce(_citation_ok(x), F.lit(False)))


def claims_output_valid(text: Column) -> Column:
    """Whether a model's output is claims in the contracted form: no field too many, no value of another type, all within limits.

    Text that is null, no JSON, or JSON with a repeated key is not valid.
    """
    value = F.try_parse_json(text)
    claims = _get(value, "claims", "array<variant>")
    whole = F.schema_of_variant(value).rlike("^OBJECT<claims: ARRAY<[^:]*(:.*)?>>$") & (F.size(F.call_function("json_object_keys", text)) == 1)
    return F.coalesce(whole & F.size(claims).between(1, MAX_CLAIMS) & F.forall(claims, lambda c: F.coalesce(_claim_ok(c), F.lit(False))), F.lit(False))


# requests


def _filled(c: str, limit: int | None = None) -> Column:
    """Given, not blank, and not too long."""
    own = F.col(c)
    return own.isNotNull() & (E.strip(own) != "") & (F.length(own) <= limit if limit else F.lit(True))


def _optional(c: str, limit: int | None = None) -> Column:
    return F.col(c).isNull() | _filled(c, limit)


def _positive(c: str) -> Column:
    return F.col(c).between(1, MAX_INT)


def _unique(values: Column) -> Column:
    return F.size(values) == F.size(F.array_distinct(values))


def _ids(c: str) -> Column:
    own = F.col(c)
    return (F.size(own) >= 1) & F.forall(own, lambda x: F.coalesce(x > 0, F.lit(False))) & _unique(own)


def request_rules(kind: str) -> dict[str, Column]:
    """Rules of a kind of request, in the order in which they are tested: code to condition."""
    return {
        "source": {
            "TITLE": _filled("title", 500), "PUBLISHER": _optional("publisher", 255), "SOURCE_TYPE": _filled("source_type", 100), "TIER": F.col("authority_tier").between(1, 4),
            "LOCATION": _filled("location"), "LICENSE": _filled("license_status", 100), "HASH": F.col("content_hash").isNull() | (F.length("content_hash") <= 128),
        },
        "discovery_run": {
            "QUERY": _filled("query", 500), "ADAPTER": _filled("adapter_key", 100), "STATUS": F.col("status").isin("SUCCEEDED", "FAILED"),
            "MESSAGE": F.when(F.col("status") == "FAILED", _filled("error_message")).otherwise(F.col("error_message").isNull()),
            "FAILED_WITH_CANDIDATES": (F.col("status") == "SUCCEEDED") | (F.size("locations") == 0), "BLANK_LOCATION": F.forall("locations", lambda x: E.strip(x) != ""),
            "REPEATED_LOCATION": _unique(F.transform("locations", E.strip)),
        },
        "fetch_result": {
            "STATUS": F.col("status").isin("SUCCEEDED", "FAILED"), "URL": E.plain_url_text(F.col("requested_url")) & F.col("requested_url").rlike("^(?i:https?)://[^/?#@]+([/?][^#]*)?$"),
            "HTTP_STATUS": F.when(F.col("status") == "SUCCEEDED", F.col("http_status").between(200, 299)).otherwise(F.col("http_status").isNull() | F.col("http_status").between(100, 599)),
            "CONTENT": (F.col("status") == "FAILED") | (F.length("content_base64") > 0), "ERROR_CODE": F.when(F.col("status") == "FAILED", E.key_pattern(F.col("error_code"), "error_code")).otherwise(F.col("error_code").isNull()),
        },
        "syllabus_version": {"EXAM": _positive("exam_id"), "SOURCE": _positive("source_id"), "LABEL": _filled("label", 255), "TOPICS": _ids("topic_ids")},
        "question_item": {
            "VERSION": _positive("content_version_id"), "QUESTION": _filled("question_text"), "EXPLANATION": _filled("explanation"), "CLAIMS": _ids("claim_ids"), "OPTIONS": F.size("options") >= 2,
            "BLANK_OPTION": F.forall("options", lambda x: F.coalesce(E.strip(x) != "", F.lit(False))), "CORRECT_OPTION": (F.col("correct_option_position") >= 0) & (F.col("correct_option_position") < F.size("options")),
        },
        "verification": {
            "CLAIM": _positive("claim_id"), "VERDICT": F.col("verdict").isin("SUPPORTED", "CONTRADICTED", "INSUFFICIENT"), "CONFIDENCE": F.col("confidence").between(0, 1), "EVIDENCE": _ids("evidence_ids"),
            "POSITIONS": F.forall("positions", lambda x: x >= 0) & _unique(F.col("positions")),
        },
    }[kind]


def validated(requests: DataFrame, kind: str) -> DataFrame:
    """Requests with error_code: the first rule of their kind that they break, null if none. A rule that gives null is broken."""
    code = F.lit(None).cast("string")
    for name, rule in reversed(request_rules(kind).items()):
        code = F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(code)
    return requests.withColumn("error_code", code)
