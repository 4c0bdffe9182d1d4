"""Choice of a coherent slice of a corpus: month statistics, the best window of months, ranked threads, capped rows.

Input rows are (row_idx, subject, at, flagged, size) as ``mailcsv.message_metadata`` gives them: a normalised subject, a
wall-clock time, whether the message carries an attachment, and its bytes. Rows without subject or time are no candidates.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.operators.ranks import with_rank


@dataclass(frozen=True)
class Targets:
    month_span_min: int = 3
    month_span_max: int = 6
    thread_min: int = 10
    thread_max: int = 20
    message_min: int = 100
    message_max: int = 300
    attachment_min: int = 20
    attachment_max: int = 50
    text_bytes_max: int = 100 * 1024 * 1024
    viable_messages: int = 3


def _month(rows: DataFrame) -> DataFrame:
    return rows.filter("subject is not null and at is not null").withColumn("month", F.year("at") * 12 + F.month("at") - 1)


def month_stats(rows: DataFrame) -> DataFrame:
    """(month, messages, flagged, subjects); month counts from year 0."""
    return _month(rows).groupBy("month").agg(F.count(F.lit(1)).alias("messages"), F.count_if("flagged").alias("flagged"), F.count_distinct("subject").alias("subjects"))


def window_scores(rows: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """(start, span, last, messages, flagged, viable, score) of each run of months that all hold messages."""
    per_subject = _month(rows).groupBy("month", "subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("f"))
    months = per_subject.groupBy("month").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    spans = months.select(F.col("month").alias("start"), F.explode(F.sequence(F.lit(targets.month_span_min), F.lit(targets.month_span_max))).alias("span"))
    cover = spans.withColumn("month", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("span") - 1)))
    totals = cover.join(months, "month").groupBy("start", "span").agg(F.count(F.lit(1)).alias("have"), F.sum("n").alias("messages"), F.sum("f").alias("flagged")).filter("have = span").drop("have")
    viable = cover.join(per_subject, "month").groupBy("start", "span", "subject").agg(F.sum("n").alias("n")).groupBy("start", "span").agg(F.count_if(F.col("n") >= targets.viable_messages).alias("viable"))
    score = F.col("viable") * 1000 - F.abs(F.col("messages") - 200) - 2 * F.abs(F.col("flagged") - 35) - 25 * F.abs(F.col("span") - 4)
    return totals.join(viable, ["start", "span"]).withColumn("last", F.col("start") + F.col("span") - 1).withColumn("score", score)


def choose_window(rows: DataFrame, targets: Targets = Targets(), legacy_end: bool = False) -> DataFrame:
    """The window of the best score, the earliest and shortest of equals; one row. ``legacy_end`` ends it a month early."""
    best = window_scores(rows, targets).orderBy(F.desc("score"), "start", "span").limit(1)
    return best.withColumn("last", F.col("last") - 1) if legacy_end else best


def thread_ranks(rows: DataFrame, window: DataFrame) -> DataFrame:
    """Subjects of the window's messages, ranked: with attachments first, then by attachments and messages, then as they came."""
    inside = _month(rows).join(F.broadcast(window.select("start", "last")), F.col("month").between(F.col("start"), F.col("last")))  # one row
    stats = inside.groupBy("subject").agg(F.count(F.lit(1)).alias("messages"), F.count_if("flagged").alias("flagged"), F.min("row_idx").alias("first_row"))
    return with_rank(stats, (F.col("flagged") > 0).desc(), F.desc("flagged"), F.desc("messages"), "first_row")


def select_threads(ranks: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Greedy choice down the ranks: the first ``thread_min`` always, then threads that fit, until the targets are met or the slice is full."""
    # beyond the first thread_min, no more than thread_max of one size are taken, and once one doesn't fit none of its size does
    equal = F.row_number().over(Window.partitionBy("messages").orderBy("rank"))
    rest = ranks.filter((F.col("rank") > targets.thread_min) & F.col("messages").between(1, targets.message_max)).withColumn("_place", equal).filter(F.col("_place") <= targets.thread_max).drop("_place")
    usable = ranks.filter((F.col("rank") <= targets.thread_min) & (F.col("messages") > 0)).unionByName(rest)
    ordered = usable.agg(F.array_sort(F.collect_list(F.struct("rank", "subject", "messages", "flagged"))).alias("t"))  # at most thread_min + message_max * thread_max
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("chosen"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("f"), F.lit(False).alias("over"))

    def step(acc, t):
        early = F.size(acc["chosen"]) < targets.thread_min
        fits = acc["n"] + t["messages"] <= targets.message_max
        take = ~acc["over"] & (early | fits) & (F.size(acc["chosen"]) < targets.thread_max)
        chosen = F.when(take, F.concat(acc["chosen"], F.array(t["subject"]))).otherwise(acc["chosen"])
        n, f = acc["n"] + F.when(take, t["messages"]).otherwise(0), acc["f"] + F.when(take, t["flagged"]).otherwise(0)
        met = (F.size(chosen) >= targets.thread_min) & n.between(targets.message_min, targets.message_max) & f.between(targets.attachment_min, targets.attachment_max)
        return F.struct(chosen.alias("chosen"), n.alias("n"), f.alias("f"), (acc["over"] | met).alias("over"))

    return ordered.select(F.explode(F.aggregate("t", start, step, lambda a: a["chosen"])).alias("subject"))


def slice_rows(rows: DataFrame, window: DataFrame, threads: DataFrame, targets: Targets = Targets()) -> DataFrame:
    """Rows of the chosen threads in the window in source order, up to the caps of messages and bytes."""
    inside = _month(rows).join(F.broadcast(window.select("start", "last")), F.col("month").between(F.col("start"), F.col("last")))
    mine = inside.join(F.broadcast(threads), "subject", "left_semi")  # at most thread_max subjects
    first = mine.orderBy("row_idx").limit(targets.message_max)  # the cap is the feature
    running = F.sum("size").over(Window.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("running_bytes", running).filter(F.col("running_bytes") <= targets.text_bytes_max)


def slice_summary(rows: DataFrame, window: DataFrame) -> DataFrame:
    """One row: window, threads, messages, attachments and bytes of a slice, and its threads' messages, the most first, else as they came."""
    total = rows.agg(F.count_distinct("subject").alias("threads_selected"), F.count(F.lit(1)).alias("messages_selected"), F.count_if("flagged").alias("attachment_messages"), F.coalesce(F.sum("size"), F.lit(0)).alias("indexed_text_bytes"))
    counts = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("messages"), F.min("row_idx").alias("first"))
    # at most thread_max subjects
    listed = counts.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("messages")).alias("o"), "first", "subject", "messages"))), lambda t: F.struct(t["subject"], t["messages"])).alias("thread_message_counts"))
    text = lambda m: F.format_string("%04d-%02d", F.floor(F.col(m) / 12), F.col(m) % 12 + 1)
    joined = total.join(F.broadcast(listed)).join(F.broadcast(window))  # one row each
    return joined.select(text("start").alias("window_start"), text("last").alias("window_end"), F.col("span").alias("month_span"), "threads_selected", "messages_selected", "attachment_messages", "indexed_text_bytes", F.round(F.col("indexed_text_bytes") / 1048576, 2).alias("indexed_text_mb"), "thread_message_counts")
