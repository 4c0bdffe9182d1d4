"""Mixed timestamp notations and time zones: one text, at most one UTC instant.

The text is brought to one pipe-separated form by a regular expression per notation, then to a local time plus either a
numeric offset or a time zone name. Local times of a named zone are joined, as of their local year, to the zone's offset
intervals laid out in local time: two intervals that hold the time make it ambiguous, none makes it nonexistent, one gives
the offset. Intervals are laid out for the zones and years that occur, whatever they are.

Defined results: a null, empty, partial, impossible, ambiguous or nonexistent time gives no row; an empty table gives no
rows; a row whose mailbox is unknown is usable only if its text carries a zone; repeated rows give repeated results; other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import zoneinfo
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed, sized_join

# Zone letters and their offsets in minutes.
ZONE_LETTERS = {
    "AKDT": -480, "AKST": -540, "ADT": -180, "AST": -240, "BST": 60, "CDT": -300, "CEST": 120, "CET": 60, "CST": -360,
    "EDT": -240, "EST": -300, "GMT": 0, "HST": -600, "JST": 540, "MDT": -360, "MST": -420, "NDT": -150, "NST": -210,
    "PDT": -420, "PST": -480, "UT": 0, "UTC": 0, "Z": 0,
}
# Month names.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Day names.
DAYS = ["sun", "mon", "tue", "wed", "thu", "fri", "sat"]

_DAY = r"(?:([a-z]{3,9})\.?,? )?"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?: ?(.+))?"
#: Pattern and the order of its groups: year|month|day|hour|minute|second|fraction|am or pm|zone|weekday|slashed.
NOTATIONS = [
    # 2001-03-23T18:15:07.25-06:00, 2002-06-26 09:01:32[Europe/London]
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})[t ]{_TIME}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8||"),
    # Thu, 29 Mar 2001 21:05:09 -0600 (CST), 25-Jul-2000 16:49
    (rf"^{_DAY}(\d{{1,2}})[ -]([a-z]{{3,9}})\.?[ -](\d{{4}}|\d{{2}}) {_TIME}(?: ?([ap]m))?{_ZONE}$", "$4|$3|$2|$5|$6|$7|$8|$9|$10|$1|"),
    # Fri May 30 11:54:54 CDT 2003
    (rf"^{_DAY}([a-z]{{3,9}}) (\d{{1,2}}) {_TIME}(?: ([a-z]{{1,5}}|[+-]\d{{4}}))? (\d{{4}})(?: ?(\(.*\)))?$", "$9|$2|$3|$4|$5|$6|$7||$8$10|$1|"),
    # Tuesday, May 27, 2003 3:23 PM CDT
    (rf"^{_DAY}([a-z]{{3,9}}) (\d{{1,2}}), (\d{{4}}),? {_TIME}(?: ?([ap]m))?{_ZONE}$", "$4|$2|$3|$5|$6|$7|$8|$9|$10|$1|"),
    # 11/26/2000 11:00 AM
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),? {_TIME}(?: ?([ap]m))?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9||/"),
]


def _number(col: Column) -> Column:
    return F.when(F.length(col) > 0, col.try_cast("int"))


def parsed(t: Column) -> Column:
    """Struct of the number an all-digit text is and the parts of a lower-case time text; null where no notation fits."""
    canonical = F.coalesce(*[F.when(t.rlike(p), F.regexp_replace(t, p, form)) for p, form in NOTATIONS])
    return F.struct(F.when(t.rlike(r"^\d{8,14}$"), t.cast("long")).alias("number"), F.split(canonical, r"\|").alias("part"))


def local_times(rows: DataFrame, text: str, day_first: str, home_zone: str) -> DataFrame:
    """Adds year, local_us (wall time in microseconds), offset_s or zone, and epoch_us to each row that denotes a real wall time."""
    part = lambda k: F.col("_p.part")[k]
    month_names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    letters = F.create_map(*[F.lit(x) for k, m in ZONE_LETTERS.items() for x in (k.lower(), m * 60)])
    days = F.create_map(*[F.lit(x) for i, d in enumerate(DAYS) for x in (d, i + 1)])
    full = rows.withColumn("_t", F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))).withColumn("_p", parsed(F.col("_t")))
    swapped = (part(10) == "/") & F.coalesce(F.col(day_first), F.lit(False))
    month_text = F.when(swapped, part(2)).otherwise(part(1))
    day_text = F.when(swapped, part(1)).otherwise(part(2))
    year = _number(part(0))
    hour = _number(part(3))
    half = part(7)
    z = F.trim(part(8))
    offset = F.regexp_extract(z, r"^(?:gmt|utc|ut)?([+-]\d{2}:?\d{2})(?: ?[(\[].*)?$", 1)
    digits = F.regexp_replace(offset, ":", "")
    name = F.regexp_replace(z, r"^[(\[]|[)\]]$", "")
    full = full.withColumns(
        {
            "_year": F.when(F.length(part(0)) == 2, year + 2000).otherwise(year),
            "_month": F.when(month_text.rlike(r"^\d+$"), _number(month_text)).when(F.length(month_text) >= 3, month_names[F.substring(month_text, 1, 3)]),
            "_day": _number(day_text),
            "_hour": F.when(F.length(half) == 0, hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)),
            "_minute": _number(part(4)),
            "_second": F.coalesce(_number(part(5)), F.lit(0)),
            "_fraction": F.substring(F.rpad(part(6), 6, "0"), 1, 6).try_cast("int"),
            "_offset": F.when((F.length(digits) == 5) & (F.substring(digits, 2, 2).try_cast("int") <= 15) & (F.substring(digits, 4, 2).try_cast("int") < 60),
                              F.concat(F.substring(digits, 1, 1), F.lit("1")).try_cast("int") * (F.substring(digits, 2, 2).try_cast("int") * 3600 + F.substring(digits, 4, 2).try_cast("int") * 60)),
            "_bad_offset": z.rlike(r"^(?:gmt|utc|ut)?[+-]"),
            "_name": F.when(F.length(name) > 0, name),
            "_weekday": F.when(F.length(part(9)) > 0, F.coalesce(days[F.substring(part(9), 1, 3)], F.lit(0))),
        }
    )
    date = F.expr("try_make_timestamp_ntz(_year, _month, _day, 0, 0, 0)")
    real = F.col("_hour").between(0, 23) & F.col("_minute").between(0, 59) & F.col("_second").between(0, 59)
    seconds = F.datediff(date, F.lit("1970-01-01").cast("timestamp_ntz")).cast("long") * 86400 + F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second")
    full = full.withColumns(
        {
            "year": F.year(date),
            "local_us": F.when(real & (F.col("_weekday").isNull() | (F.col("_weekday") == F.dayofweek(date))), seconds * 1_000_000 + F.coalesce(F.col("_fraction"), F.lit(0))),
            "offset_s": F.coalesce(F.col("_offset"), F.when(~F.col("_bad_offset"), letters[F.col("_name")])),
            "zone": F.when(F.col("_name").isNull(), F.lower(F.col(home_zone))).when(~F.col("_bad_offset") & F.col("_name").contains("/"), F.col("_name")),
            "epoch_us": F.when(F.col("_p.number") >= 100_000_000_000, F.col("_p.number") * 1000).otherwise(F.col("_p.number") * 1_000_000),
        }
    )
    return full.drop("_t", "_p", "_year", "_month", "_day", "_hour", "_minute", "_second", "_fraction", "_offset", "_bad_offset", "_name", "_weekday")


def _zone_years(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task: (zone, year, intervals) of each zone and local year; intervals hold start and end in local time. Unknown zones give none."""
    names = {n.lower(): n for n in zoneinfo.available_timezones() - {"localtime", "posixrules", "Factory"}}
    epoch, day = datetime(1970, 1, 1), 86400
    first, last = ((t - epoch).days * day for t in (datetime(1, 1, 3), datetime(9999, 12, 29)))

    def offset_at(zone: zoneinfo.ZoneInfo, at: int) -> int:
        return int((epoch + timedelta(seconds=at)).replace(tzinfo=UTC).astimezone(zone).utcoffset().total_seconds())

    for batch in batches:
        found = []
        for name, year in zip(batch["zone"], batch["year"]):
            if name not in names or not 1 <= year <= 9999:
                continue
            zone, begin = zoneinfo.ZoneInfo(names[name]), (datetime(year, 1, 1) - epoch).days * day
            at, end = max(first, begin - 2 * day), min(last, begin + 368 * day)
            since, offset, spans = at, offset_at(zone, at), []
            while at < end:
                then = min(at + 14 * day, end)
                if offset_at(zone, then) == offset:
                    at = then
                    continue
                # the first second of the new offset
                at = at + 1 + bisect.bisect_left(range(at + 1, then), True, key=lambda s: offset_at(zone, s) != offset)  # noqa: B023
                spans.append((since + offset, at + offset, offset))
                since, offset = at, offset_at(zone, at)
            spans.append((since + offset, end + offset, offset))
            found.append((name, year, [{"start_us": a * 1_000_000, "end_us": b * 1_000_000, "offset_s": o} for a, b, o in spans]))
        yield pd.DataFrame(found, columns=["zone", "year", "intervals"])


def zone_intervals(years: DataFrame) -> DataFrame:
    """(zone, year, intervals): the offset intervals of each distinct (zone, year), a few each."""
    return years.mapInPandas(_zone_years, "zone string, year int, intervals array<struct<start_us:long,end_us:long,offset_s:int>>")


def to_instants(mail: DataFrame, mailboxes: DataFrame, key: str = "row_idx", text: str = "date_text", source_file: str = "source_file") -> DataFrame:
    """(key, utc_us): rows whose time text denotes exactly one instant.

    ``mailboxes`` is a directory of one row per mailbox; it is broadcast by size, not by hint.
    """
    rows = mail.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.regexp_extract(F.col(source_file), r"^[^/]*/([^/]+)/", 1).alias("_mailbox"))
    homes = mailboxes.groupBy(F.col("mailbox").alias("_mailbox")).agg(F.first("home_zone").alias("_home"), F.first("day_first").alias("_day_first"))
    times = local_times(rows.join(homes, "_mailbox", "left"), "_text", "_day_first", "_home")
    fixed = F.coalesce(F.col("epoch_us"), F.col("local_us") - F.col("offset_s").cast("long") * 1_000_000)
    zoned = fixed.isNull() & F.col("local_us").isNotNull()
    # narrow rows, read twice: the parsing is the work. No filter before: pushed below the projections it would repeat all of
    # the parsing in one expression
    times = checkpointed(times.select("_key", "local_us", fixed.alias("fixed_us"), F.when(zoned, F.col("zone")).alias("zone"), F.when(zoned, F.col("year")).alias("year")))
    occurring = times.filter("zone is not null").select("zone", "year").distinct().repartition(int(mail.sparkSession.conf.get("spark.sql.shuffle.partitions")), "zone", "year")
    joined = sized_join(times, zone_intervals(occurring), ["zone", "year"], "left", max_rows=100_000)
    holding = F.filter("intervals", lambda i: (i["start_us"] <= F.col("local_us")) & (F.col("local_us") < i["end_us"]))
    joined = joined.withColumn("holding", holding)
    zoned = F.when(F.size("holding") == 1, F.col("local_us") - F.col("holding")[0]["offset_s"].cast("long") * 1_000_000)
    return joined.select(F.col("_key").alias(key), F.coalesce("fixed_us", zoned).alias("utc_us")).filter(F.col("utc_us").isNotNull())
