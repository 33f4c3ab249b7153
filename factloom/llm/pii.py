"""Personal data: regular expressions propose spans, checksums confirm them, words before them adjust a score.

Everything is DataFrame functions. The patterns are written so that Java's matcher works through a text once: a match
can only begin where a run of its characters begins or where the last match ended, and repeated groups don't backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import text_input, unfolded, whole_rows
from .spans import Kind, redacted, rendered, with_spans

#: Added kinds need this score.
ENOUGH = 0.6

#: Words that speak for a kind.
CONTEXT = {
    "email": r"(?i)\b(e-?mail|contact|write to|mailto)\b",
    "ip": r"(?i)\b(ip|host|server|address|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|whatsapp)\b",
    "iban": r"(?i)\b(iban|account|bank|konto|cuenta|compte)\b",
    "ssn": r"(?i)\b(ssn|social security|tax id)\b",
}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column, before: Column) -> Column:
    return F.forall(F.split(match, "[.]"), lambda x: F.substring(F.regexp_replace(x, "^0+(?=.)", ""), 1, 4).cast("int") <= 255)


def _luhn(match: Column, before: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(16, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))


def _mod97(match: Column, before: Column) -> Column:
    """An account number is right if, with its first four characters moved to the end and letters as 10 to 35, it leaves 1 modulo 97."""
    turned = F.concat(F.substring(match, 5, 40), F.substring(match, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c <= F.lit("9"), F.lit(48)).otherwise(F.lit(55))
    step = lambda acc, c: F.when(code(c) > 9, acc * 100 + code(c)).otherwise(acc * 10 + code(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(F.length(c) == 0, acc).otherwise(step(acc, c)).cast("int")) == 1


def _scored(kind: str, base: float):
    return lambda match, before: F.lit(base) + F.when(before.rlike(CONTEXT[kind]), 0.35).otherwise(0.0)


def _enough(kind: str, base: float, valid=lambda match, before: F.lit(True)):
    return lambda match, before: valid(match, before) & (_scored(kind, base)(match, before) >= ENOUGH)


BASE_KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", score=_scored("email", 0.6), needs=lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", keep=_octets, score=_scored("ip", 0.5)),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", keep=_luhn, score=_scored("card", 0.7)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", keep=lambda match, before: F.length(_digits(match)).between(8, 15), score=_scored("phone", 0.5), needs=lambda t: t.contains("+")),
]
ADDED_KINDS = [
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Za-z0-9])", keep=_enough("iban", 0.6, _mod97), score=_scored("iban", 0.6)),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", keep=_enough("ssn", 0.3), score=_scored("ssn", 0.3)),
]


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, and an array of spans (kind, start, end, score) a kind, in columns spans_<kind>.

    Null and empty texts have no spans; each row is judged by itself, so repeated rows repeat; further columns are not read.
    """
    return with_spans(text_input(docs, id_col, text_col), "text", BASE_KINDS + ADDED_KINDS, "spans_")


def all_spans(kinds=None) -> Column:
    return F.concat(*[F.col(f"spans_{k.name}") for k in (kinds or BASE_KINDS + ADDED_KINDS)])


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row.

    Null and empty texts have no spans and the hash of an empty list; rows that repeat are judged each; an empty table
    gives no rows; further columns are not read.
    """
    found = pii_spans(docs)
    counts = [F.size(f"spans_{k.name}").cast("long").alias(f"n_{k.name}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(rendered(all_spans(BASE_KINDS)), 256).alias("base_sha256"), rendered(all_spans()).alias("spans"))


def redact_pii(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with all personal data in the text column replaced by its kind in angle brackets.

    A null text stays null and an empty one empty; rows that repeat are redacted each; other columns, whatever their
    names, stay as they are; an empty table stays empty. Overlapping spans become one.
    """
    rows = whole_rows(docs, text_col, text=F.col(text_col).cast("string"))
    found = with_spans(rows, "text", BASE_KINDS + ADDED_KINDS, "spans_")
    return unfolded(found, docs.columns, **{text_col: redacted(F.col("text"), all_spans())})
