"""Quoted history and signatures in emails: only the text newly written by its sender.

Marked history is cut by its marks: the body ends at the first header block of an older mail, quoted lines and the lines
introducing them go, and what follows a closing phrase, a separator or the sender's name line goes up to the next quotation.
What is left is exploded into normalised paragraphs. Ranked by date within its thread, a paragraph stays only where it was
first authored; short lines that recur as closings of one sender are removed by their counts, and long ones that end many
mails which have nothing else in common (notices) where they end a mail.

Defined results: null bodies count as empty and are no case; a body of nothing but old text has empty new text; rows without
a thread are compared with themselves only; a mail delivered twice, told by its id or its equal body, does not quote itself;
times that denote no instant fall back to the time of loading; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.operators.instants import to_instants
from mailweave.sources.tables import checkpointed

# Phrases that close a mail.
CLOSINGS = [
    "cheers", "many thanks", "sincerely", "yours sincerely", "regards", "best", "thanks", "best regards", "kind regards", "warm regards", "all the best", "best wishes", "thank you", "thanks again", "thx", "rgds",
    "yours truly", "respectfully", "cordially", "take care", "viele grüße", "mit freundlichen grüßen", "beste grüße", "gruß", "grüße", "cordialement", "bien à vous", "merci", "saludos", "un saludo", "atentamente", "gracias", "atenciosamente", "abraços", "obrigado",
]
# Common words of legal notices.
NOTICE_CUES = ["intended recipient", "information contained in this e-?mail", "privileged and confidential", "e-?mail and any attachments", "may contain confidential", "strictly prohibited", "notify the sender"]

_NAME = r"\p{Lu}[\p{L}'’-]*\.?(?: \p{Lu}[\p{L}'’-]*\.?){0,4}"
#: Header blocks of older mail; all after them is old.
_OLDER = "|".join(
    [
        r"-{4,} ?[^-\s][^\n]*",
        r"Begin forwarded message\b[^\n]*",
        r"[^\n:]{2,60}\n\d{1,2}/\d{1,2}/\d{2,4} \d{1,2}:\d{2}(?: [AP]M)?\nTo:",
        r"From: [^\n]*\n(?:\[[^\n]*\n)?(?:Sent|Date|To): ",
    ]
)
_QUOTED = r"[ \t]*[>|][^\n]*"
_INTRO = r"(?:On|Am|Le|El|Em|Il|Den|Op) [^\n]*\d[^\n]*(?:wrote|schrieb|a écrit|escribió|escreveu|ha scritto)[^\n]*:[ \t]*|[^\n]+ (?:wrote|schrieb|a écrit|escribió|escreveu) (?:on|am|le|el|em) [^\n]*\d[^\n]*:[ \t]*"
_CLOSING = r"(?i:" + "|".join(CLOSINGS) + r")[,.!]?[ \t]*(?=\n|\z)|--[ \t]*(?=\n|\z)"
#: A line of a signature block below the name.
_DETAIL = r"(?:[^\n]{2,40}, \p{Lu}[^\n]{2,30}|(?:Phone|Tel|Fax|Mobile|Cell|t|m|p)[:.]? ?[+(\d][^\n]*|[+(]?\d[\d ().x+-]{6,}[^\n]*|\S+@\S+)[ \t]*(?=\n|\z)"
_BREAK, _GONE = "\u0001", "\u0002"


def key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _same(text: Column) -> Column:
    """What paragraphs are compared by: the key, or all letters and digits where the script leaves little to the key."""
    return F.when(F.length(key(text)) * 3 < F.length(text), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")).otherwise(key(text))


def _paragraphs(body: Column) -> Column:
    """Paragraphs of a body without marked history, signatures and marked notices."""
    text = F.regexp_replace(body, r"\r\n?", "\n")
    text = F.get(F.split(text, rf"(?m)^(?:{_OLDER})", 2), F.lit(0))
    text = F.regexp_replace(text, rf"(?m)^(?:{_QUOTED}|{_INTRO})$", _BREAK)
    text = F.regexp_replace(text, rf"(?m)^(?:{_CLOSING})[^{_BREAK}]*", _GONE + "\n")
    text = F.regexp_replace(text, rf"(?m)(?<=\A|\n[ \t]?\n|{_BREAK}\n)^{_NAME}[ \t]*\n{_DETAIL}[^{_BREAK}]*", _GONE + "\n")
    text = F.regexp_replace(text, rf"(?m)^[_*=]{{8,}}[ \t]*(?:\n[^\n{_BREAK}{_GONE}]+)*", _GONE)
    return F.filter(F.split(text, rf"\n[ \t]*\n|[{_BREAK}{_GONE}]"), lambda p: p.rlike(r"\S"))


def reduced(mail: DataFrame, ingest: DataFrame, mailboxes: DataFrame, pasted: int = 25, notice: int = 40, notice_share: float = 0.003, notice_mails: int = 5, closings: int = 3, texts: bool = False) -> DataFrame:
    """(row_idx, old_key, new_key): the key of each body and of its new text; with ``texts`` also the new text itself, its paragraphs parted by blank lines.

    ``pasted`` and ``notice`` are the least lengths of a paragraph's key to be compared within its thread and counted across
    mails; ``notice_share`` and ``notice_mails`` are the share of all different bodies, and their least number, that a notice
    must end; ``closings`` is how many mails of a sender a short name-like line must close.
    """
    cue = "(?is)" + "|".join(NOTICE_CUES).replace(" ", r"\s+")
    rows = mail.filter("body is not null").select(
        "row_idx",
        F.coalesce(F.lower("message_id"), F.md5("body")).alias("mail"),
        F.xxhash64("body").alias("whole"),
        F.regexp_extract("source_file", r"^[^/]*/([^/]+)/", 1).alias("mailbox"),
        plain_words(F.col("sender")).alias("by"),
        key(F.col("body")).alias("old_key"),
        F.filter(_paragraphs(F.col("body")), lambda p: ~p.rlike(cue)).alias("paragraphs"),
    )
    # a name line of the sender closes the mail, unless it opens it
    opens = F.array_position(F.transform("paragraphs", lambda p: p.rlike(r"[\p{L}\p{N}]")), True) - 1
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumn("signed", F.transform("paragraphs", lambda p, i: (i > F.col("opens")) & p.rlike(rf"^\s*{_NAME}\s*$")))
    rows = rows.withColumn("keys", F.transform("paragraphs", _same))
    rows = rows.withColumn("own", F.transform("paragraphs", lambda p, i: F.get(F.col("signed"), i) & F.arrays_overlap(plain_words(p), F.col("by"))))
    rows = checkpointed(rows.select("row_idx", "mail", "whole", "mailbox", "by", "old_key", "keys", "signed", "own", *["paragraphs"] * texts))

    times = mail.select("row_idx", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us")).join(to_instants(mail, mailboxes), "row_idx", "left").select("row_idx", F.coalesce("utc_us", "loaded_us").alias("us"))
    threads = ingest.groupBy("row_idx").agg(F.min("thread_id").alias("thread"))
    placed = rows.select("row_idx", "mail", "whole", "mailbox", F.posexplode(F.arrays_zip("keys", "signed", "own")).alias("pos", "p")).filter("p.keys <> ''").select(
        "row_idx", "mail", "whole", "mailbox", "pos", F.xxhash64("p.keys").alias("digest"), F.length("p.keys").alias("n"), F.col("p.signed").alias("signed"), F.col("p.own").alias("own")
    )
    placed = placed.join(times.join(threads, "row_idx", "left"), "row_idx", "left").withColumn("thread", F.coalesce("thread", F.concat(F.lit("row "), "row_idx")))
    placed = checkpointed(placed)
    # where a paragraph of a thread was first authored
    authored = placed.filter(F.col("n") >= pasted)
    first = authored.groupBy("thread", "digest").agg(F.min(F.struct("us", "row_idx", "mail", "whole")).alias("first"), F.count_distinct("mail").alias("mails")).filter("mails > 1").drop("mails")
    late = authored.join(first, ["thread", "digest"]).filter("mail <> first.mail and whole <> first.whole").select("row_idx", "pos")
    # notices recur across mails, closings within a sender
    notices = _notices(rows, placed, notice, max(notice_mails, notice_share * rows.select("whole").distinct().count()), notice_mails)
    recurring = placed.filter("signed").groupBy("mailbox", "digest").agg(F.count_distinct("mail").alias("mails")).filter(F.col("mails") >= closings).select("mailbox", "digest")
    closing = placed.filter("signed").join(recurring, ["mailbox", "digest"], "left_semi").select("row_idx", "pos").unionByName(placed.filter("own").select("row_idx", "pos"))
    gone = late.unionByName(notices).unionByName(closing).groupBy("row_idx").agg(F.collect_set("pos").alias("gone"))  # of one mail
    kept = lambda c: F.filter(c, lambda _, i: ~F.coalesce(F.array_contains(F.col("gone"), i), F.lit(False)))
    whole = [F.array_join(F.transform(kept("paragraphs"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), "\n\n").alias("new_text")] if texts else []
    return rows.join(gone, "row_idx", "left").select("row_idx", "old_key", key(F.array_join(kept("keys"), "")).alias("new_key"), *whole)


def new_texts(mail: DataFrame, ingest: DataFrame, mailboxes: DataFrame, **settings) -> DataFrame:
    """(row_idx, new_text): every mail's body as only what its sender newly wrote; null where there is no body."""
    new = reduced(mail, ingest, mailboxes, texts=True, **settings).select("row_idx", "new_text")
    return new.unionByName(mail.filter("body is null").select("row_idx", F.lit(None).cast("string").alias("new_text")))


def _notices(rows: DataFrame, placed: DataFrame, notice: int, least: float, senders: int, common: float = 0.1) -> DataFrame:
    """(row_idx, pos) of the paragraphs that end a mail and are notices.

    Evidence is the text in front of such a paragraph: a notice has at least ``least`` different ones, of ``senders`` senders,
    and half of all its texts have little in common. A text has much in common if half of its pieces, cut at fixed letters,
    stand in the share ``common`` of the texts each; so copies of one mail, changed or not, are no evidence.
    """
    long = placed.filter(F.col("n") >= notice)
    often = long.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= least).select("digest")
    marked = long.join(often, "digest", "left_semi").groupBy("row_idx").agg(F.collect_set("pos").alias("marked"))  # of one mail
    # the run of such paragraphs at the end of a mail begins behind its last other one
    other = F.array_except(F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: F.get("keys", i) != ""), "marked")
    ends = rows.join(marked, "row_idx").withColumn("end", F.coalesce(F.array_max(other), F.lit(-1)))
    front = F.array_join(F.slice("keys", 1, F.col("end") + 1), "")
    ends = ends.select("row_idx", "end", F.array_join(F.array_sort("by"), " ").alias("by"), F.array_distinct(F.filter(F.split(front, "(?<=th|er|st|nd)"), lambda x: F.length(x) >= 10)).alias("pieces"))
    candidates = checkpointed(placed.select("row_idx", "pos", "digest").join(ends, "row_idx").filter("pos > end").drop("end"))
    texts = candidates.filter(F.size("pieces") > 0).groupBy("digest", F.xxhash64("pieces").alias("text")).agg(F.first("pieces").alias("pieces"), F.min("by").alias("by"))
    number = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    parts = texts.select("digest", "text", F.explode("pieces").alias("piece"))
    shared = parts.groupBy("digest", "piece").agg(F.count(F.lit(1)).alias("held")).join(number, "digest").filter((F.col("held") > 1) & (F.col("held") >= common * F.col("texts"))).select("digest", "piece")
    tied = parts.join(shared, ["digest", "piece"], "left_semi").groupBy("digest", "text").agg(F.count(F.lit(1)).alias("tied"))
    alone = F.coalesce("tied", F.lit(0)) * 2 < F.size("pieces")
    counted = texts.join(tied, ["digest", "text"], "left").groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.count_if(alone).alias("alone"), F.count_distinct(F.when(alone, F.col("by"))).alias("senders"))
    proven = counted.filter((F.col("alone") >= least) & (F.col("alone") * 2 >= F.col("texts")) & (F.col("senders") >= senders)).select("digest")
    return candidates.join(proven, "digest", "left_semi").select("row_idx", "pos")


def plain_words(text: Column) -> Column:
    """Words of three letters or more of a name, without an address's domain."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"@\S+", "")), F.lit(r"\p{L}{3,}"), F.lit(0))


def found(mail: DataFrame, ingest: DataFrame, mailboxes: DataFrame, **settings) -> DataFrame:
    """(row_idx, new_md5): rows whose body holds anything but new text."""
    both = reduced(mail, ingest, mailboxes, **settings)
    return both.filter("old_key <> new_key").select("row_idx", F.md5("new_key").alias("new_md5")).distinct()
