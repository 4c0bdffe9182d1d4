"""Garbled text from wrong character encoding: code-page swaps as substitution ciphers, learned by expectation-maximisation.

A swap writes each byte of the original UTF-8 as one symbol of another code page, which makes it a substitution cipher of
symbols for bytes. Which ciphers a source (a mailbox) went through is unknown. Public code pages are the prior: each proposes
readings of a stretch of symbols. Every reading is scored by bigrams of characters counted over the clean text of all rows,
and expectation-maximisation learns each source's weights of the ciphers and from them the reading of each stretch. The
readings that win give each source its own table of symbols to bytes, of nothing but symbols that occur there; the table is
applied with ``translate()``, whose result holds one character per byte, and the bytes are read as UTF-8. Text that was
swapped twice by one page is restored by applying the table as often; by different pages, in as many passes.

Defined results: null, empty and pure ASCII bodies are no case; a body with a replacement character is a case whose original
is lost; repeated rows count once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed

# Single-byte code pages that mail clients have written.
CODE_PAGES = [
    "cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "cp1254", "cp1257", "cp1253", "cp852", "cp858", "cp860", "cp863", "cp865",
    "cp866", "koi8_r", "koi8_u", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15", "mac_latin2", "mac_cyrillic", "mac_greek", "mac_turkish", "mac_iceland",
]
LOST = "�"
_RUN = "[^\\x00-\\x7F]{2,}"
_ODD = "[^\\x00-\\x7F]"


#: Characters that stand for the bytes from 128 on.
_BYTES = "".join(chr(b) for b in range(128, 256))
#: UTF-8 of one character beyond ASCII, a character for each byte.
_UTF8 = "|".join(["[\u00C2-\u00DF][\u0080-\u00BF]", "\u00E0[\u00A0-\u00BF][\u0080-\u00BF]", "[\u00E1-\u00EC\u00EE\u00EF][\u0080-\u00BF]{2}", "\u00ED[\u0080-\u009F][\u0080-\u00BF]", "\u00F0[\u0090-\u00BF][\u0080-\u00BF]{2}", "[\u00F1-\u00F3][\u0080-\u00BF]{3}", "\u00F4[\u0080-\u008F][\u0080-\u00BF]{2}"])
#: Stands for what is no symbol of a table.
_NONE = "\ue000"
_SWAPPED = 3


def symbols(page: str) -> str:
    """The symbols of a code page for the bytes from 128 on; bytes that it leaves open stand for themselves."""
    return "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in range(128, 256))


def _translate(text: Column, symbols: Column, by: Column) -> Column:
    return F.call_function("translate", text, symbols, by)


def _bytes_of(text: Column, table: Column) -> Column:
    """The text with each symbol of the table as the character of its byte, all others as none."""
    others = _translate(F.lit(_BYTES), table["symbols"], F.lit(""))  # characters of bytes that are no symbols here
    marked = _translate(text, others, F.rpad(F.lit(""), F.length(others), F.lit(_NONE)))
    return _translate(marked, table["symbols"], table["bytes"])


def _with_read(df: DataFrame, text: str, table: str, out: str) -> DataFrame:
    """Adds the text with every stretch that is UTF-8 under the table restored; null where there is none."""
    step = lambda acc, x: F.struct(
        F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(x["gap"])), F.decode(F.encode(x["unit"], "ISO-8859-1"), "UTF-8")).alias("out"), (acc["at"] + F.length(x["gap"]) + F.length(x["unit"])).alias("at")
    )
    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text)))
    pairs = F.arrays_zip(F.slice("_gaps", 1, F.size("_units")).alias("gap"), F.col("_units").alias("unit"))
    read = F.when(F.size("_units") > 0, F.aggregate(pairs, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, rest))
    coded = df.withColumn("_coded", _bytes_of(F.col(text), F.col(table)))
    coded = coded.withColumns({"_units": F.regexp_extract_all("_coded", F.lit(_UTF8), F.lit(0)), "_gaps": F.split("_coded", _UTF8, -1)})
    return coded.withColumn(out, read).drop("_coded", "_units", "_gaps")


def _readings(runs: DataFrame, pages: list[str]) -> DataFrame:
    """(run, page, restored, steps): the readings of each run, with what it read before each; page '' leaves it as it is."""
    tables = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(symbols(p)).alias("symbols"), F.lit(_BYTES).alias("bytes")) for p in pages])
    # rows of one table together: translate() keeps its last table
    each = runs.withColumn("t", F.explode(tables)).withColumn("r0", F.col("run")).sortWithinPartitions("t.page")
    for k in range(_SWAPPED):  # swapped again and again by the same page: as often as reads best
        each = _with_read(each, f"r{k}", "t", f"r{k + 1}")
    found = F.array(*[F.struct(F.col(f"r{k + 1}").alias("restored"), F.array(*[f"r{j}" for j in range(k + 1)]).alias("steps")) for k in range(_SWAPPED)])
    read = each.select("run", F.col("t.page").alias("page"), F.explode(found).alias("f")).select("run", "page", "f.restored", "f.steps")
    # nobody writes private and unassigned characters
    read = read.filter(F.col("restored").isNotNull() & ~F.col("restored").rlike(r"[\p{Co}\p{Cn}]"))
    return read.unionByName(runs.select("run", F.lit("").alias("page"), F.col("run").alias("restored"), F.array().cast("array<string>").alias("steps")))


def bigram_counts(mail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, n) and (letter, n): characters that are not ASCII with the ASCII ones beside them; single ones only, as swaps write two or more."""
    near = F.regexp_extract_all(F.col("body"), F.lit("[\\x00-\\x7F][^\\x00-\\x7F][\\x00-\\x7F]"), F.lit(0))
    spans = mail.filter(F.col("body").rlike(_ODD)).select(F.explode(near).alias("span")).groupBy("span").count()
    part = lambda width: spans.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(4 - width)), lambda i: F.substring("span", i, F.lit(width)))).alias("x"), "count")
    pairs = part(2).groupBy(F.col("x").alias("pair")).agg(F.sum("count").alias("n"))
    return pairs, part(1).groupBy(F.col("x").alias("letter")).agg(F.sum("count").alias("n"))


def _scored(options: DataFrame, pairs: DataFrame, letters: DataFrame, pull: float = 50.0, unseen: float = 1e-4) -> DataFrame:
    """Log likelihood of left + restored + right, against the best option of the spot.

    A letter's probability after another is its share there, pulled towards its share of all letters by ``pull`` sightings; a
    letter never seen counts as ``unseen`` sightings.
    """
    spot = F.concat("left", "restored", "right")
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length(spot) - 1), lambda i: F.substring(spot, i, F.lit(2))))
    exploded = options.withColumn("pair", pair).withColumns({"first": F.substring("pair", 1, 1), "second": F.substring("pair", 2, 1)})
    total = letters.agg((F.coalesce(F.sum("n"), F.lit(0)) + 1).alias("all"))  # one row
    joined = exploded.join(pairs, "pair", "left").join(letters.select(F.col("letter").alias("first"), F.col("n").alias("n1")), "first", "left")
    joined = joined.join(letters.select(F.col("letter").alias("second"), F.col("n").alias("n2")), "second", "left").join(F.broadcast(total))
    seen = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = (seen("n") + pull * (seen("n2") + unseen) / F.col("all")) / (seen("n1") + pull)
    keys = ["mailbox", "run", "left", "right", "page", "restored", "times"]
    likely = joined.groupBy(*keys).agg(F.sum(F.log(share)).alias("score"))
    # a spot has a few options per code page
    return likely.withColumn("score", F.col("score") - F.max("score").over(Window.partitionBy("mailbox", "run", "left", "right")))


def learned_restorations(mail: DataFrame, pages: list[str], model: tuple[DataFrame, DataFrame], rounds: int = 4) -> DataFrame:
    """(mailbox, run, restored) of each stretch that is better read through a code page."""
    mailbox = F.coalesce(F.regexp_extract("source_file", r"^[^/]*/([^/]+)/", 1), F.lit(""))
    spot = F.regexp_extract_all(F.col("body"), F.lit("[\\x00-\\x7F]?" + _RUN + "[\\x00-\\x7F]?"), F.lit(0))
    seen = mail.filter(F.col("body").rlike(_RUN)).select(mailbox.alias("mailbox"), F.explode(spot).alias("spot"))
    seen = seen.select("mailbox", F.regexp_extract("spot", _RUN, 0).alias("run"), F.regexp_extract("spot", "^[\\x00-\\x7F]", 0).alias("left"), F.regexp_extract("spot", "[\\x00-\\x7F]$", 0).alias("right"))
    seen = checkpointed(seen.groupBy("mailbox", "run", "left", "right").agg(F.count(F.lit(1)).alias("times")))
    runs = seen.select("run").distinct().repartition(int(mail.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run")  # narrow rows, much work each
    options = checkpointed(_readings(runs, pages))
    scored = checkpointed(_scored(seen.join(options.drop("steps"), "run"), *model))
    spotted = ["mailbox", "run", "left", "right"]
    # the identity is one more page; pages start equal
    weights = scored.select("mailbox", "page").distinct().withColumn("weight", F.lit(1.0))
    for _ in range(rounds):
        likely = scored.join(weights, ["mailbox", "page"]).withColumn("p", F.col("weight") * F.exp("score"))
        total = likely.groupBy(*spotted).agg(F.sum("p").alias("total"))
        share = likely.join(total, spotted).withColumn("share", F.col("p") / F.col("total") * F.col("times"))
        sums = share.groupBy("mailbox", "page").agg(F.sum("share").alias("weight"))
        # add-one over the pages keeps rare swaps possible
        weights = checkpointed(sums.select("mailbox", "page", (F.col("weight") + 1.0).alias("weight")))
    final = scored.join(weights, ["mailbox", "page"]).withColumn("p", F.col("weight") * F.exp("score"))
    # pages that read a stretch alike add up, and so do the places where a mailbox has it
    total = final.groupBy(*spotted).agg(F.sum("p").alias("total"))
    shares = checkpointed(final.join(total, spotted).groupBy("mailbox", "run", "restored", "page").agg(F.sum(F.col("p") / F.col("total") * F.col("times")).alias("share")))
    alike = shares.groupBy("mailbox", "run", "restored").agg(F.sum("share").alias("share"), F.max_by("page", F.struct("share", "page")).alias("page"))
    won = alike.groupBy("mailbox", "run").agg(F.max_by(F.struct("restored", "page"), F.struct("share", "restored")).alias("w"))
    won = won.select("mailbox", "run", "w.restored", "w.page").filter("restored <> run").join(options, ["run", "restored", "page"])
    # each source's own table of every cipher, of the symbols that its readings turned into bytes
    public = F.create_map(*[x for p in pages for x in (F.lit(p), F.struct(F.lit(symbols(p)).alias("symbols"), F.lit(_BYTES).alias("bytes")))])
    used = won.select("mailbox", "page", F.explode(F.array_distinct(F.split(F.array_join("steps", ""), ""))).alias("symbol")).distinct().withColumn("byte", _translate(F.col("symbol"), public[F.col("page")]["symbols"], F.lit(_BYTES))).filter(F.length("symbol") > 0).filter(F.contains(public[F.col("page")]["symbols"], F.col("symbol")))
    tables = used.groupBy("mailbox", "page").agg(F.array_sort(F.collect_list(F.struct("symbol", "byte"))).alias("s"))  # at most 128 symbols
    tables = tables.select("mailbox", "page", F.struct(F.array_join("s.symbol", "").alias("symbols"), F.array_join("s.byte", "").alias("bytes")).alias("table"))
    out = won.join(tables, ["mailbox", "page"]).select("mailbox", "run", "table", F.size("steps").alias("times"))
    out = out.withColumn("restored", F.col("run"))
    for k in range(_SWAPPED):
        out = _with_read(out, "restored", "table", "_next").withColumn("restored", F.when(F.col("times") > k, F.col("_next")).otherwise(F.col("restored"))).drop("_next")
    return out.select("mailbox", "run", "restored")


def restored_bodies(mail: DataFrame, pages: list[str] | None = None, passes: int = 2) -> DataFrame:
    """(row_idx, garbled, lost, restored): rows with wrongly decoded text and their whole restored body."""
    rows = mail.select("row_idx", "body", "source_file").filter(F.col("body").rlike(_ODD))
    mailbox = F.coalesce(F.regexp_extract("source_file", r"^[^/]*/([^/]+)/", 1), F.lit(""))
    current = rows.withColumn("first_body", F.col("body"))
    # the language is learned from the text as it came, never from restorations
    pairs, letters = bigram_counts(mail)
    model = checkpointed(pairs), checkpointed(letters)
    for _ in range(passes):
        learned = learned_restorations(current, pages or CODE_PAGES, model)
        spot = F.regexp_extract_all(F.col("body"), F.lit(_RUN), F.lit(0))
        marked = current.filter(F.col("body").rlike(_RUN))
        found = marked.select("row_idx", mailbox.alias("mailbox"), F.posexplode(spot).alias("pos", "run")).join(learned, ["mailbox", "run"])
        per_row = found.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "restored"))).alias("by_pos"))
        gaps = F.split("body", _RUN, -1)
        pieces = F.transform(spot, lambda r, i: F.concat(F.coalesce(F.element_at("by_pos", i), r), F.get(gaps, i + 1)))
        mended = F.concat(F.get(gaps, F.lit(0)), F.array_join(pieces, ""))
        current = checkpointed(current.join(per_row, "row_idx", "left").select("row_idx", "source_file", "first_body", F.when(F.col("by_pos").isNull(), F.col("body")).otherwise(mended).alias("body")))
    lost = F.col("first_body").contains(LOST)
    return current.filter(lost | (F.col("body") != F.col("first_body"))).select("row_idx", lost.alias("lost"), F.col("body").alias("restored"))


def found(mail: DataFrame) -> DataFrame:
    """(row_idx, restored_md5): rows with wrongly decoded text; '' where the original is lost."""
    return restored_bodies(mail).select("row_idx", F.when(F.col("lost"), F.lit("")).otherwise(F.md5("restored")).alias("restored_md5")).distinct()
