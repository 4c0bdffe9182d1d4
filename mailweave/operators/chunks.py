"""Retrieval chunks: paragraphs packed greedily up to a number of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions.text import blank_to_null, strip, text_or_empty, tokens
from mailweave.operators.cleaning import with_clean_body
from mailweave.operators.threads import threaded_records
from mailweave.sources import mailcsv
from mailweave.sources.tables import checkpointed

CHUNK_TOKENS = 220


def chunk_text(subject: Column, sender: Column, to: Column, cc: Column, body: Column) -> Column:
    """Subject, sender, recipients, copies and body, a line each; missing ones left out."""
    listed = lambda x: blank_to_null(F.array_join(F.coalesce(x, F.array().cast("array<string>")), " "))
    return strip(F.concat_ws("\n", blank_to_null(subject), blank_to_null(sender), listed(to), listed(cc), blank_to_null(body)))


def packed_sections(text: Column, limit: int = CHUNK_TOKENS, separator: str = "\n\n") -> Column:
    """Sections of whole paragraphs of at most ``limit`` tokens; a longer paragraph is a section of its own."""
    paragraphs = F.filter(F.transform(F.split(F.regexp_replace(text_or_empty(text), r"\r\n?", "\n"), separator), strip), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        n = F.size(tokens(p))
        joins = (acc["open"] != "") & (acc["n"] + n <= limit)
        longer = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit("\n\n"), p).alias("open"), (acc["n"] + n).alias("n"))
        fresh = F.struct(F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), p.alias("open"), n.alias("n"))
        return F.when(joins, longer).otherwise(fresh)

    packed = F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    return F.when(F.size(packed) > 0, packed).otherwise(F.array(strip(text_or_empty(text))))


def chunked(mail: DataFrame, body: str = "body") -> DataFrame:
    """One row per section of each mail, with the mail's columns, its thread_id where it has one; sections count from 1."""
    text = chunk_text(F.col("subject"), F.col("sender"), F.col("recipients"), F.col("cc"), F.col(body))
    thread = F.col("thread_id") if "thread_id" in mail.columns else F.lit(None).cast("string").alias("thread_id")
    exploded = mail.select("row_idx", thread, "message_id", "subject", "date_text", "sender", "recipients", "cc", "source_file", F.posexplode(packed_sections(text)).alias("pos", "chunk_text"))
    return exploded.select(
        F.format_string("email_%04d_%02d", "row_idx", F.col("pos") + 1).alias("doc_id"), "row_idx", (F.col("pos") + 1).alias("section"), "thread_id", F.coalesce(blank_to_null(F.col("message_id")), F.concat(F.lit("row_"), "row_idx")).alias("message_id"),
        F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("filename"), F.lit("email").alias("chunk_type"), "subject", "date_text", "sender", "recipients", "cc", "chunk_text", F.size(tokens(F.col("chunk_text"))).alias("token_count"), "source_file",
    )


def ingested(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threaded records and retrieval chunks of raw messages (row_idx, file, message): parsed, cleaned, threaded by the mails' dates, cut.

    Chunks are cut from the clean body, from the body as it came where nothing is left of it.
    """
    records = checkpointed(with_clean_body(mailcsv.structured(raw)).withColumn("_at", mailcsv.wall_time(F.col("date_text"))))
    threaded = threaded_records(records, "_at").drop("_at")
    shown = threaded.withColumn("_shown", F.coalesce(blank_to_null(F.col("clean_body")), F.col("body")))
    return threaded, chunked(shown, "_shown")
