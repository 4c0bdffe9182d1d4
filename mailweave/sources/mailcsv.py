"""Raw mail: CSV scan and sink, header parsing, transfer decoding; traces as JSON lines."""

from __future__ import annotations

from datetime import datetime
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mailweave.functions.text import blank_to_null, normalize_subject, strip, text_or_empty

RAW_SCHEMA = "file string, message string"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, message) of a mail CSV with quoted cells of many lines."""
    return spark.read.schema(RAW_SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1)


def write_slice(rows: DataFrame, path: str) -> None:
    """Rows (row_idx, file, message) as CSV in source order."""
    rows.orderBy("row_idx").select("file", "message").write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_summary(summary: DataFrame, path: str) -> None:
    """The one row of a slice's summary as a JSON object; thread counts in order of count."""
    summary.coalesce(1).write.mode("overwrite").json(path)


SLIM = "struct<doc_id:string,thread_id:string,message_id:string,page_no:int,filename:string,chunk_type:string,score:double,subject:string,date_text:string,text_preview:string>"
CITATIONS = "array<struct<cite_type:string,message_id:string,page_no:int>>"
#: The thirteen fields of a recorded turn.
TRACE_SCHEMA = f"trace_id string, logged_at timestamp_ntz, session_id string, thread_id string, user_text string, rewrite string, retrieved array<{SLIM}>, used_items array<{SLIM}>, answer string, citations {CITATIONS}, latency_ms double, search_outside_thread boolean, token_counts map<string,bigint>"


def trace_rows(turns: DataFrame) -> DataFrame:
    """Turns in the thirteen fields of a trace; missing ones are empty or null, a turn without an id gets one."""
    have = set(turns.columns)
    cols = []
    for field in TRACE_SCHEMA.split(", "):
        name, kind = field.split(" ", 1)
        empty = "map()" if kind.startswith("map") else "array()" if kind.startswith("array") else "null"
        value = F.col(name) if name in have else F.expr(empty)
        cols.append((F.coalesce(value, F.expr(empty)) if empty != "null" else value).cast(kind).alias(name))
    out = turns.select(*cols)
    return out if "trace_id" in have else out.withColumn("trace_id", F.concat(F.lit("trace_"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12)))


def write_trace(turns: DataFrame, path: str, run_id: str) -> None:
    """Appends turns as JSON lines under the run's folder, null fields written out."""
    trace_rows(turns).withColumn("run_id", F.lit(run_id)).write.mode("append").option("ignoreNullFields", "false").partitionBy("run_id").json(path)


def read_trace(spark: SparkSession, path: str, schema: str = TRACE_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def _named(head: Column, key) -> Column:
    """(k, v) of the header lines of a head, continuation lines folded, lines without a colon skipped."""
    unfolded = F.split(F.regexp_replace(head, r"\s*\n[ \t]+", " "), "\n")
    return F.transform(F.filter(unfolded, lambda x: x.contains(":")), lambda x: F.struct(F.lower(key(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"), strip(F.regexp_extract(x, r"^[^:]*:(?s:(.*))$", 1)).alias("v")))


def headers(message: Column) -> Column:
    """Headers (k, v) of a message by stripped lower-case name, in the order they stand in."""
    return _named(F.get(F.split(F.regexp_replace(text_or_empty(message), r"\r\n?", "\n"), "\n\n", 2), F.lit(0)), strip)


def slice_headers(message: Column) -> Column:
    """As ``headers``, but up to the first blank line of any kind, and names with blanks before the colon are other names."""
    return _named(F.get(F.split(F.concat(F.lit("\n"), F.regexp_replace(text_or_empty(message), r"\r\n?", "\n")), r"\n[^\S\n]*(?=\n|\z)", 2), F.lit(0)), lambda k: F.regexp_replace(k, r"^\n", ""))


def header(named: Column, name: str) -> Column:
    """The value of the last header of the name, null if there is none."""
    return F.get(F.reverse(F.filter(named, lambda h: h["k"] == name)), F.lit(0))["v"]


def body_of(message: Column) -> Column:
    return text_or_empty(F.get(F.split(F.regexp_replace(text_or_empty(message), r"\r\n?", "\n"), "\n\n", 2), F.lit(1)))


def quoted_printable(text: Column) -> Column:
    """Soft breaks joined, escaped bytes decoded as UTF-8, bytes that aren't UTF-8 as replacement characters."""
    safe = F.regexp_replace(F.regexp_replace(text, "%", "%25"), r"\+", "%2B")
    return F.try_url_decode(F.regexp_replace(F.regexp_replace(safe, r"=\r?\n", ""), "=([0-9A-Fa-f]{2})", "%$1"))


def list_field(col: Column) -> Column:
    """Entries between commas, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(text_or_empty(col), ","), strip), lambda x: x != "")


@F.pandas_udf(StructType().add("iso", "string").add("wall", "string"))
def _dates(text: pd.Series) -> pd.DataFrame:
    """The date of a mail header in ISO form, and its wall time, also of texts in ISO form; there is no built-in for the header's grammar."""

    def one(t):
        try:
            at = parsedate_to_datetime(t)
            return at.isoformat(), at.replace(tzinfo=None).isoformat()
        except (TypeError, ValueError, IndexError, OverflowError):
            pass
        try:
            return None, datetime.fromisoformat(t).replace(tzinfo=None).isoformat()
        except (TypeError, ValueError):
            return None, None

    return pd.DataFrame([one(t) for t in text], columns=["iso", "wall"], dtype=object)


def iso_date(raw: Column) -> Column:
    """A mail header's date as ISO text with its offset, none for -0000 and zones of no offset; other texts stay, an empty one is null."""
    return F.coalesce(_dates(raw)["iso"], blank_to_null(raw))


def header_time(raw: Column) -> Column:
    """The wall time of a mail header's date; null for other texts."""
    return F.substring(_dates(raw)["iso"], 1, 19).try_cast("timestamp_ntz")


def wall_time(raw: Column) -> Column:
    """The wall time of a mail header's date or an ISO text; null for other texts."""
    return _dates(raw)["wall"].try_cast("timestamp_ntz")


# What marks an attachment in a lower-cased message.
ATTACHMENT_MARKS = ["content-disposition: attachment", "filename=", "name="]


def message_metadata(raw: DataFrame) -> DataFrame:
    """(row_idx, subject, at, flagged, size) of raw messages (row_idx, message): normalised subject, wall time, whether it is marked as having an attachment, bytes."""
    named = raw.withColumn("_h", slice_headers(F.col("message")))
    low = F.lower("message")
    marked = F.lit(False)
    for mark in ATTACHMENT_MARKS:
        marked = marked | low.contains(mark)
    subject = blank_to_null(normalize_subject(header(F.col("_h"), "subject")))
    return named.select("row_idx", subject.alias("subject"), header_time(header(F.col("_h"), "date")).alias("at"), marked.alias("flagged"), F.octet_length("message").alias("size"))


def structured(raw: DataFrame) -> DataFrame:
    """Structured records of raw rows (file, message), with row_idx if they have one."""
    h = lambda name: header(F.col("_h"), name)
    rows = raw.withColumn("_h", headers(F.col("message"))).withColumn("_body", body_of(F.col("message")))
    decoded = F.when(F.lower(h("content-transfer-encoding")) == "quoted-printable", F.coalesce(quoted_printable(F.col("_body")), F.col("_body"))).otherwise(F.col("_body"))
    return rows.select(
        *[c for c in ("row_idx",) if c in raw.columns], h("message-id").alias("message_id"), h("subject").alias("subject"), iso_date(h("date")).alias("date_text"), h("from").alias("sender"), list_field(h("to")).alias("recipients"),
        list_field(F.coalesce(blank_to_null(h("cc")), h("x-cc"))).alias("cc"), strip(decoded).alias("body"), F.coalesce(blank_to_null(h("in-reply-to")), h("reply-to")).alias("in_reply_to"), list_field(h("references")).alias("ref_ids"), F.col("file").alias("source_file"),
    )
