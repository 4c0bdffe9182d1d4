"""Thread inference: sessions of like subjects by gaps and participants, joined with replies into components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.text import normalize_subject, participants
from mailweave.operators.ranks import with_rank
from mailweave.sources.tables import checkpointed

GAP_DAYS = 14


def gap_sessions(mail: DataFrame, time: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """(row_idx, normalized_subject, session): neighbours of one subject in time, those without one first, belong together if they share a participant, lack a time, or lie within the gap.

    Rows are range-partitioned in the order of subject and time, so that a subject of any size is worked on in several tasks;
    the borders between ranges are mended with one row of each range and subject.
    """
    rows = mail.select("row_idx", normalize_subject(F.col("subject")).alias("normalized_subject"), F.col(time).alias("_at"), participants(F.col("sender"), F.col("recipients"), F.col("cc")).alias("_who"))
    ranged = checkpointed(rows.repartitionByRange("normalized_subject", "_at", "row_idx").withColumn("_range", F.spark_partition_id()))
    piece = Window.partitionBy("_range", "normalized_subject").orderBy(F.col("_at").asc_nulls_first(), "row_idx")
    apart = lambda row, before: F.when(before["row_idx"].isNull() | ~F.coalesce(F.arrays_overlap(row["_who"], before["_who"]) | row["_at"].isNull() | before["_at"].isNull() | (row["_at"] <= before["_at"] + F.make_dt_interval(F.lit(gap_days))), F.lit(False)), 1).otherwise(0)
    own = F.struct("_at", "row_idx", "_who")
    starts = ranged.withColumn("_own", own).withColumn("_new", F.when(F.lag("row_idx").over(piece).isNotNull(), apart(F.col("_own"), F.lag("_own").over(piece))).otherwise(0))
    starts = starts.withColumn("_in", F.sum("_new").over(piece.rowsBetween(Window.unboundedPreceding, 0))).select("row_idx", "normalized_subject", "_range", "_own", "_in")
    # a row for each range and subject: its first and last mail and the starts inside
    order = F.struct(F.col("_own._at").isNotNull(), F.col("_own._at"), F.col("_own.row_idx"))
    borders = starts.groupBy("_range", "normalized_subject").agg(F.min_by("_own", order).alias("head"), F.max_by("_own", order).alias("tail"), F.max("_in").alias("inside"))
    along = Window.partitionBy("normalized_subject").orderBy("_range")
    mended = borders.withColumn("_first", apart(F.col("head"), F.lag("tail").over(along)))
    offset = F.sum(F.col("_first") + F.col("inside")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside")
    return starts.join(mended.select("_range", "normalized_subject", offset.alias("_offset")), ["_range", "normalized_subject"]).select("row_idx", "normalized_subject", (F.col("_offset") + F.col("_in")).alias("session"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label): least vertex reachable over ``edges`` (u, v), by minimum labels and pointer jumps until nothing changes."""
    both = checkpointed(edges.filter("u <> v").select("u", "v").unionByName(edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = checkpointed(both.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("m")).select("vertex", F.least("vertex", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("vertex").alias("v"), "label"), "v").groupBy(F.col("u").alias("vertex")).agg(F.min("label").alias("m"))
        lower = labels.join(near, "vertex").select("vertex", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = lower.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        after = checkpointed(lower.join(jump, "label", "left").select("vertex", F.coalesce(F.least("label", "further"), "label").alias("label"), "was"))
        moved = after.filter("label <> was").limit(1).count()
        labels = after.select("vertex", "label")
        if not moved:
            return labels


def infer_threads(mail: DataFrame, time: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """(row_idx, normalized_subject, thread_row): components of reply links and sessions; ``thread_row`` is the least row of the thread.

    A repeated message id stands for its last row; an id that no row has links nothing.
    """
    sessions = checkpointed(gap_sessions(mail, time, gap_days))
    heads = sessions.groupBy("normalized_subject", "session").agg(F.min("row_idx").alias("head"))
    member = sessions.join(heads, ["normalized_subject", "session"]).select("row_idx", "normalized_subject", "head")
    member = checkpointed(member)
    by_id = mail.filter("length(message_id) > 0").groupBy("message_id").agg(F.max("row_idx").alias("target"))
    related = mail.select("row_idx", F.explode(F.array_distinct(F.concat(F.array("in_reply_to"), F.coalesce("ref_ids", F.array().cast("array<string>"))))).alias("message_id"))
    links = related.join(by_id, "message_id").select("row_idx", "target")
    # sessions are vertices: a link joins two of them
    edges = links.join(member.select("row_idx", F.col("head").alias("u")), "row_idx").join(member.select(F.col("row_idx").alias("target"), F.col("head").alias("v")), "target").select("u", "v").distinct()
    labels = components(edges)
    return member.join(labels.withColumnRenamed("vertex", "head"), "head", "left").select("row_idx", "normalized_subject", F.coalesce("label", "head").alias("thread_row"))


def numbered(threads: DataFrame) -> DataFrame:
    """thread_id by first appearance: thread_0001 is the thread of the first row."""
    heads = with_rank(threads.select("thread_row").distinct(), "thread_row", name="_n")
    return threads.join(heads, "thread_row").select("row_idx", "normalized_subject", F.format_string("thread_%04d", "_n").alias("thread_id"))


def threaded_records(mail: DataFrame, time: str, gap_days: int = GAP_DAYS) -> DataFrame:
    """The mail with normalized_subject and thread_id."""
    return mail.join(numbered(infer_threads(mail, time, gap_days)), "row_idx")
