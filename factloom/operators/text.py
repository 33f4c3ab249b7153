"""Text extraction and chunking."""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser
from unicodedata import normalize
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions import exprs as E
from factloom.sources.storage import bounded_batches, settled

SIZE, OVERLAP = 1000, 100
#: Chunks that are Python strings at a time.
PIECES = 512

#: Elements that are not shown, and those that begin and end a line.
HIDDEN = frozenset("head script style template noscript svg".split())
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())

_ERROR = "\0"


#: What a chunk may end after, the best first.
_MARKS = [re.compile("(?=\n\n)"), re.compile("\n"), re.compile(" ")]
_WIDTHS = [2, 1, 1]
_INK = re.compile(r"\S")


def _windows(text: str, size: int, overlap: int) -> list[dict]:
    """Overlapping ranges of at most `size` characters over a whole text.

    Where each mark stands is found once; a range that does not reach the end of the text stops after the last mark of the best
    kind that lies in its second half, unless only white space stands before that mark.
    """
    if len(text) <= size:
        return [{"char_start": 0, "char_end": len(text)}] if text else []
    marks = [[m.start() for m in mark.finditer(text)] for mark in _MARKS]

    def stop(begin: int) -> int:
        hard = begin + size
        if hard >= len(text):
            return len(text)
        for places, width in zip(marks, _WIDTHS, strict=True):
            last = bisect_right(places, hard - width) - 1
            if last >= 0 and places[last] >= begin + size // 2:
                soft = places[last] + width
                return soft if _INK.search(text, begin, soft) else hard
        return hard

    out = [{"char_start": 0, "char_end": stop(0)}]
    while out[-1]["char_end"] < len(text):
        begin = max(out[-1]["char_end"] - overlap, 0)
        begin = begin if begin > out[-1]["char_start"] else out[-1]["char_end"]
        out.append({"char_start": begin, "char_end": stop(begin)})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())])))
def chunk_offsets(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _windows(t or "", SIZE, OVERLAP))


_PIECE = T.StructType([T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType())])


@F.arrow_udf(T.ArrayType(_PIECE))
def _pieces(texts: pa.Array) -> pa.Array:
    """The chunks of each text, in Arrow's memory column by column: one text and some hundred chunks are Python strings at a time."""
    done, waiting, begin, end, upto = [], [], [], [], [0]
    for scalar in texts:
        text = scalar.as_py() or ""
        for at in _windows(text, SIZE, OVERLAP):
            begin.append(at["char_start"])
            end.append(at["char_end"])
            waiting.append(text[at["char_start"] : at["char_end"]])
            if len(waiting) == PIECES:
                done.append(pa.array(waiting, pa.string()))
                waiting = []
        upto.append(len(begin))
    done.append(pa.array(waiting, pa.string()))
    chunks = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.concat_arrays(done)], _PIECE.names)
    return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), chunks)


def chunk_text(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, position, char_start, char_end, text and sha256 of each chunk. Null and empty texts have no chunks."""
    bounded_batches(docs.sparkSession)
    placed = docs.select(F.col(id_col), F.posexplode(_pieces(F.col(text_col))).alias("position", "_at"))
    return placed.select(id_col, "position", F.col("_at.char_start").alias("char_start"), F.col("_at.char_end").alias("char_end"), F.col("_at.text").alias("text"), F.sha2("_at.text", 256).alias("sha256"))


class _Events(HTMLParser):
    """What a document consists of, in order: (kind, tag or text), kind being open, close, empty or text."""

    def __init__(self, text: str) -> None:
        super().__init__(convert_charrefs=True)
        self.seen: list[tuple[str, str]] = []
        self.feed(text)
        self.close()

    handle_starttag = lambda self, tag, attrs: self.seen.append(("open", tag))
    handle_startendtag = lambda self, tag, attrs: self.seen.append(("empty", tag))
    handle_endtag = lambda self, tag: self.seen.append(("close", tag))
    handle_data = lambda self, data: self.seen.append(("text", data))


def _shown(events: list[tuple[str, str]]) -> Iterator[str]:
    """The text outside hidden elements, with a line end where an element that makes a line begins or ends."""
    inside: list[str] = []
    for kind, value in events:
        hides = kind in ("open", "close") and value in HIDDEN
        if hides and kind == "open":
            inside.append(value)
        elif hides and inside:
            inside.pop()
        elif not inside and kind == "text":
            yield value
        elif not inside and value in BLOCKS:
            yield "\n"


def _html(text: str) -> str:
    return "".join(_shown(_Events(text).seen))


def _leaves(value) -> Iterator[str]:
    if isinstance(value, (dict, list)):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _leaves(x)
    else:
        yield value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, allow_nan=False)


def _refuse(name: str):
    raise ValueError(name)


def _json(text: str) -> str:
    return "\n".join(_leaves(json.loads(text, parse_constant=_refuse)))


def _xml(text: str) -> str:
    return "".join(ElementTree.fromstring(text).itertext())


_PARSERS = {"text/plain": lambda text: text, "text/html": _html, "application/json": _json, "application/xml": _xml, "text/xml": _xml}


def _parse(kind: str, text: str | None) -> str | None:
    if text is None or kind not in _PARSERS:
        return None
    try:
        found = normalize("NFC", _PARSERS[kind](text))
    except (ValueError, ElementTree.ParseError, AssertionError, RecursionError):
        return _ERROR
    return "" if found == _ERROR else found  # a text of that character alone has nothing to show


@F.pandas_udf(T.StringType())
def parsed_text(kinds: pd.Series, texts: pd.Series) -> pd.Series:
    """The text of each document, in NFC, by the parser of its kind; null for other kinds, a zero character where it can't be read."""
    return pd.Series([_parse(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)


_SCHEMA_PART = r"(?i)<!\s*(DOCTYPE|ENTITY)\b"


def decoded_utf8(content: Column) -> Column:
    """Text of UTF-8 bytes, without a byte order mark; null if they are none."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.regexp_replace(content.cast("string"), "^﻿", ""))


def extract_snapshots(snapshots: DataFrame, *, max_bytes: int = 5_242_880, max_chars: int = 2_000_000, max_chunks: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """snapshots: snapshot_id, content_type, content (bytes). Runs (status, error_code, text, sizes) and chunks of those that succeeded.

    The snapshots are read and parsed once: what came of each, its chunks included, is stored in the shared folder, and
    both tables are read from there. A parser sees only documents of its kind and of allowed size.
    """
    bounded_batches(snapshots.sparkSession)
    sized = snapshots.select("snapshot_id", "content_type", "content", F.octet_length("content").alias("n_bytes"))
    decoded = sized.withColumn("raw", F.when(F.col("n_bytes") <= max_bytes, decoded_utf8(F.col("content")))).drop("content")
    known = F.coalesce(F.col("content_type").isin(list(_PARSERS)), F.lit(False))
    refused = F.col("content_type").isin("application/xml", "text/xml") & F.col("raw").rlike(_SCHEMA_PART)
    parsed = decoded.withColumn("parsed", parsed_text("content_type", F.when(~F.coalesce(refused, F.lit(False)), F.col("raw"))))
    parsed = parsed.withColumn("parsed", F.when(refused, F.lit(_ERROR)).otherwise(F.col("parsed")))
    text = parsed.withColumn("text", F.when(F.col("parsed") != _ERROR, E.tidy_text(F.col("parsed"))))
    text = text.withColumn("chunks", F.when(F.length("text") <= max_chars, _pieces("text")))
    code = (
        F.when(F.col("n_bytes") > max_bytes, "EXTRACTION_INPUT_TOO_LARGE")
        .when(~known, "EXTRACTION_UNSUPPORTED_CONTENT_TYPE")
        .when(F.col("raw").isNull(), "EXTRACTION_INVALID_ENCODING")
        .when(F.col("parsed") == _ERROR, "EXTRACTION_INVALID_DOCUMENT")
        .when(F.col("text") == "", "EXTRACTION_EMPTY_TEXT")
        .when(F.length("text") > max_chars, "EXTRACTION_TEXT_TOO_LARGE")
        .when(F.size("chunks") > max_chunks, "EXTRACTION_CHUNK_LIMIT")
    )
    coded = text.withColumn("error_code", code)
    done = F.col("error_code").isNull()
    stored = settled(
        coded.select(
            "snapshot_id", "content_type", F.when(done, "SUCCEEDED").otherwise("FAILED").alias("status"), "error_code", F.when(done, F.col("text")).alias("text"),
            F.when(done, F.length("text")).alias("text_char_count"), F.when(done, F.sha2("text", 256)).alias("text_sha256"), F.when(done, F.col("chunks")).alias("chunks"),
        )
    )
    chunks = stored.select("snapshot_id", F.posexplode("chunks").alias("position", "c"))
    return stored.drop("chunks"), chunks.select("snapshot_id", "position", "c.char_start", "c.char_end", "c.text", F.sha2("c.text", 256).alias("sha256"))


def store_extraction(snapshots: DataFrame, folder: str, **limits: int) -> tuple[DataFrame, DataFrame]:
    """Write runs and chunks under a folder, from one pass over the snapshots, and read them back. A failed run has no chunks; a repeated call replaces both."""
    spark = snapshots.sparkSession
    out = []
    for name, df in zip(("runs", "chunks"), extract_snapshots(snapshots, **limits), strict=True):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out.append(spark.read.schema(df.schema).parquet(f"{folder}/{name}"))
    return out[0], out[1]


def chunk_integrity(chunks: DataFrame, texts: DataFrame, *, size: int = SIZE) -> DataFrame:
    """Chunks that differ from their place in the text, from their hash, or from the limits, with the first reason.

    A text meets its chunks' places and digests once, so the work is linear in texts and chunks of any length. A chunk
    without a place is out of range, one without text or hash differs; chunks of unknown texts are left out.
    """
    start, end, text = F.col("char_start"), F.col("char_end"), F.col("text")
    own = (
        F.when(F.coalesce((start < 0) | (end <= start), F.lit(True)), "RANGE")
        .when(F.length(text) != end - start, "LENGTH")
        .when(F.length(text) > size, "TOO_LONG")
        .when(E.strip(text) == "", "BLANK")
    )
    digest = F.sha2(text, 256)
    placed = chunks.select("id", F.struct("position", start.cast("long").alias("a"), end.cast("long").alias("b"), F.unhex(digest).alias("digest"), own.alias("reason"), (digest == F.col("sha256")).alias("same")).alias("chunk"))
    gathered = placed.groupBy("id").agg(F.collect_list("chunk").alias("chunks"))  # as many as the text, which is one row, has chunks
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, row_of, reasons = batch.column(2), [], []
            parts = [lists.flatten().field(name).to_pylist() for name in ("a", "b", "digest", "reason", "same")]
            at = 0
            for row, (whole, n) in enumerate(zip(batch.column(1).to_pylist(), lists.value_lengths().to_pylist(), strict=True)):
                for a, b, digest, reason, same in zip(*[p[at : at + n] for p in parts], strict=True):
                    if reason != "RANGE" and b > len(whole):
                        reason = "RANGE"
                    elif not reason and sha256(whole[a:b].encode()).digest() != digest:
                        reason = "TEXT"
                    elif not reason and not same:
                        reason = "HASH"
                    reasons.append(reason)
                    row_of.append(row)
                at += n
            found = pa.array(reasons, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_of, pa.int64())), lists.flatten().field("position"), found], ["id", "position", "reason"]).filter(found.is_valid())

    both = texts.select("id", F.col("text").alias("whole")).where("whole is not null").join(gathered.hint("merge"), "id")
    return both.select("id", "whole", "chunks").mapInArrow(check, f"id {kinds['id']}, position {kinds['position']}, reason string")


def chunk_continuity(chunks: DataFrame, lengths: DataFrame, *, overlap: int = OVERLAP) -> DataFrame:
    """Runs (id) whose chunks do not begin at 0, leave gaps in positions or text, or do not end with the text. lengths: id, n."""
    w = Window.partitionBy("id").orderBy("position")
    seen = chunks.withColumn("following", F.lead("char_start").over(w)).withColumn("place", F.row_number().over(w) - 1)
    bad = F.col("following").isNotNull() & ~((F.col("following") == F.col("char_end") - overlap) | (F.col("following") == F.col("char_end")))
    per = seen.groupBy("id").agg(F.count_if(bad | (F.col("position") != F.col("place"))).alias("breaks"), F.min("char_start").alias("first"), F.max("char_end").alias("last"), F.count("*").alias("n_chunks"))
    return per.join(lengths.hint("merge"), "id").select("id", "n_chunks", "breaks", ((F.col("breaks") == 0) & (F.col("first") == 0) & (F.col("last") == F.col("n"))).alias("continuous"))
