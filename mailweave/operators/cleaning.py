"""Cleaning of mail bodies: markup, repeated header lines, disclaimers, newsletter noise, broken lines."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mailweave.functions.text import lines, strip, text_or_empty

# Lines at which a disclaimer starts.
DISCLAIMER_STARTS = [
    "this e-mail and any attachment", "the information contained in this email", "this message may contain confidential", "if you are not the intended recipient", "legal stuff", "this story appeared on", "here is the story we were requested to send you",
    "the information contained in this newsletter", "attachment part",
]
CUT_PATTERN = r"(?i)^(?:" + "|".join(DISCLAIMER_STARTS) + r"|content-disposition:\s*attachment|[-_]{10,}$)"
# Headings after which a newsletter holds no mail text.
NEWSLETTER_STARTS = ["welcome new hires", "transfers to", "nuggets & notes", "in the news"]
HEADER_PATTERN = r"(?i)^(from|sent|to|cc|subject|date)\s*:"


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Entities as characters; there is no built-in for all of them."""
    return text.map(lambda t: html.unescape(t) if isinstance(t, str) and "&" in t else t)


def strip_markup(col: Column) -> Column:
    """Entities first, then tags to blanks."""
    return F.regexp_replace(unescaped(text_or_empty(col)), r"<[^>]+>", " ")


def drop_header_runs(col: Column) -> Column:
    """Keeps the first two of a run of header lines: a line goes if it and the two before it are headers."""
    split = lines(col)
    none = F.array(F.lit(""))
    # each line beside the two before it
    both = F.arrays_zip(split.alias("line"), F.concat(none, split).alias("one"), F.concat(none, none, split).alias("two"))
    head = lambda line: strip(line).rlike(HEADER_PATTERN)
    kept = F.filter(F.slice(both, 1, F.size(split)), lambda x: ~(head(x["line"]) & head(x["one"]) & head(x["two"])))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def _before_first(split: Column, hit) -> tuple[Column, Column]:
    """Lines before the first that hits, and whether one does."""
    at = F.array_position(F.transform(split, hit), True)
    return F.when(at > 0, F.slice(split, 1, (at - 1).cast("int"))).otherwise(split), at > 0


def cut_disclaimer(col: Column) -> Column:
    """Text before the first disclaimer line, stripped if one was cut."""
    kept, cut = _before_first(lines(col), lambda line: strip(line).rlike(CUT_PATTERN))
    joined = F.array_join(kept, "\n")
    return F.when(cut, strip(joined)).otherwise(joined)


def drop_newsletter_noise(col: Column, starts: list[str] | None = None) -> Column:
    """Lines before a newsletter heading, without link lines; blank lines become empty."""
    heading = r"(?i)^(?:" + "|".join(starts or NEWSLETTER_STARTS) + ")"
    kept, _ = _before_first(lines(col), lambda line: strip(line).rlike(heading))
    rest = F.filter(kept, lambda line: ~strip(line).rlike(r"(?i)^(?:https?://|\[no worries)"))
    return strip(F.array_join(F.transform(rest, lambda line: F.when(strip(line) == "", "").otherwise(line)), "\n"))


def unwrap_lines(col: Column) -> Column:
    """Joins lines broken in mid-sentence; blank, quoted and header lines stand alone."""
    split = F.transform(lines(col), strip)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("open"))
    closed = lambda acc: F.when(acc["open"] != "", F.concat(acc["out"], F.array(acc["open"]))).otherwise(acc["out"])

    def step(acc: Column, line: Column) -> Column:
        alone = (line == "") | line.startswith(">") | line.rlike(HEADER_PATTERN) | line.startswith("-----Original Message-----")
        joins = ~acc["open"].rlike(r"[.!?:;]$") & ~line.rlike(r"^[-*]")
        shut = F.struct(F.concat(closed(acc), F.array(line)).alias("out"), F.lit("").alias("open"))
        opened = F.struct(acc["out"].alias("out"), line.alias("open"))
        longer = F.struct(acc["out"].alias("out"), F.concat(acc["open"], F.lit(" "), line).alias("open"))
        next_one = F.struct(closed(acc).alias("out"), line.alias("open"))
        return F.when(alone, shut).when(acc["open"] == "", opened).when(joins, longer).otherwise(next_one)

    return F.array_join(F.aggregate(split, start, step, closed), "\n")


def tidy_space(col: Column) -> Column:
    """Single blanks within lines, at most one blank line between, none at the ends."""
    each = F.transform(lines(col), lambda line: strip(F.regexp_replace(line, r"[ \t]+", " ")))
    return strip(F.regexp_replace(F.array_join(each, "\n"), r"\n{3,}", "\n\n"))


def _cleaned(mail: DataFrame, body: str) -> DataFrame:
    """Adds clean_body, a column per step so that no step's input is computed more than once; '' for null."""
    steps = [lambda c: F.regexp_replace(F.regexp_replace(text_or_empty(c), r"\r\n?", "\n"), r"<[^>]+>", " "), drop_header_runs, cut_disclaimer, drop_newsletter_noise, unwrap_lines, tidy_space]
    out = mail.withColumn("clean_body", F.col(body))
    for step in steps:
        out = out.withColumn("clean_body", step(F.col("clean_body")))
    return out


def with_clean_body(mail: DataFrame, body: str = "body") -> DataFrame:
    """The mail with ``clean_body``; bodies without an entity don't leave the JVM."""
    plain = mail.filter(~F.coalesce(F.col(body).contains("&"), F.lit(False)))
    coded = mail.filter(F.col(body).contains("&")).withColumn("_body", F.col(body))
    schema = coded.schema
    decoded = coded.mapInPandas(_unescape_rows("_body"), schema)
    return _cleaned(plain, body).unionByName(_cleaned(decoded, "_body").drop("_body"))


def _unescape_rows(body: str):
    def run(batches):
        for batch in batches:
            yield batch.assign(**{body: batch[body].map(html.unescape)})

    return run
