"""Intent routing and extractive answers with citations over retrieved chunks.

Items are the retrieved chunks of a question as ``retrieval.with_chunks`` gives them, with query_id and rank. Corpus-specific hints are a table of rules given by the caller, none by default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions.text import SENTENCE_BREAK, blank_to_null, lines, lower_first, sentences, squeeze, strip, text_or_empty, tokens, word_count
from mailweave.operators.retrieval import slim

NO_ITEMS = "I could not find enough evidence in the active thread. What email, person, or subject should I focus on?"
NO_EVIDENCE = "I found relevant messages in the active thread, but I do not have enough clear evidence to answer directly. Please narrow the question slightly."
_any = lambda *words: rf"(?iU)\b(?:{'|'.join(words)})\b"
# What tells each intent, in the order of precedence.
INTENTS = {
    "timeline": _any("timeline", "chronology", "chronological", "who said what", "when did"),
    "people": _any("who is involved", "who all are involved", "who is talking", "participants", "people involved", "who sent"),
    "decision": _any("decision", "proposal", "request", "asked", "asking", "what.*discussed", "what.*proposal", "what.*request"),
    "why": _any("why"),
    "meeting": r"(?iU)\bwhat meeting|which meeting|meeting referred to|meeting mentioned\b",
    "location": _any("where", "location", "connected to"),
    "value": _any("amount", "price", "cost", "value", "cap", "rate", "how much", "what is new price", "new price"),
    "date": _any("when", "date", "sent", "approved on", "when was"),
    "summary": _any("summary", "summarize", "what is this about", "what does it talk about", "what is this thread mainly about", "mainly about", "overview"),
}
# Words that mark a request or decision.
REQUEST_CUES = ["approved", "decided", "proposed", "requested", "please forward", "is invited", "meeting", "pre-meeting", "ask", "approval"]
MONEY = r"(?i)(?:\$|USD\s*)\s*\d[\d,]*(?:\.\d+)?(?:/[A-Za-z]+)?"
RATE = r"(?U)\b\d+(?:\.\d+)?\s*/\s*[A-Za-z]+\b"
# Bylines, datelines and legal tails of wire stories, and what takes their place.
WIRE_TAILS = [
    (r"(?i)\(MORE\)", " "), (r"(?i)\s*Dow Jones Newswires\s*\d{1,2}-\d{1,2}-\d{2}\s*\d{3,4}GMT.*", ""), (r"\bBy\s+[A-Z][A-Z\s.\-']+\b(?:\s+Of\s+[A-Z][A-Z\s.\-']+)?", ""),
    (r"\bOf\s+DOW JONES NEWSWIRES\b.*", ""), (r"(?i)\bLEGAL STUFF\b.*", ""), (r"(?i)\bThis story appeared on\b.*", ""),
]
# Datelines at the start of a story.
DATELINES = [r"^[A-Z\s]+\(Dow Jones\)--", r"^[A-Z][A-Za-z\s]+--"]
# Sentences that carry no content.
EMPTY_SENTENCES = [r"(?i)^By\s+[A-Z][A-Za-z\s.\-']+(?:\s+Of\s+[A-Z][A-Za-z\s.\-']+)?$", r"(?i)^(?:if there was an inch|more|final order|legal stuff)"]
# Openings that an answer does without.
ANSWER_OPENINGS = [r"(?i)^(to|cc|subject|importance):\s+.*$", r"(?i)^(here you go|good afternoon)[\s\-:]*", r"(?i)^(the following message was attached:\s*)"]
# Meetings with a date, and law offices.
MEETING_DATE = r"(?iU)\b(?:meeting|luncheon meeting).{0,60}?(Monday,\s+[A-Za-z]+\s+\d{1,2})"
LAW_OFFICE = r"(?iU)\blaw offices?\s+of\s+([^.,]+)"


def intent(col: Column) -> Column:
    """The first intent that the question matches, else 'default'."""
    out = None
    for name, pattern in INTENTS.items():
        out = F.when(col.rlike(pattern), name) if out is None else out.when(col.rlike(pattern), name)
    return out.otherwise("default")


def citation(message_id: Column, page_no: Column) -> Column:
    page = F.coalesce(F.concat(F.lit(", page: "), page_no.cast("string")), F.lit(""))
    return F.concat(F.lit("[msg: "), text_or_empty(message_id), page, F.lit("]"))


def clean_sentence(col: Column) -> Column:
    """Without wire-service bylines, datelines and legal tails, single blanks."""
    s = F.regexp_replace(col, ">", " ")
    for pattern, to in WIRE_TAILS:
        s = F.regexp_replace(s, pattern, to)
    for pattern in DATELINES:
        s = F.regexp_replace(strip(s), pattern, "")
    return squeeze(s)


def content_sentences(text: Column) -> Column:
    """Cleaned sentences of more than eight words behind the first three lines, bylines left out."""
    full = F.filter(F.transform(lines(text), strip), lambda x: x != "")
    body = F.when(F.size(full) > 3, F.array_join(F.slice(full, 4, 1 << 20), "\n")).otherwise(text_or_empty(text))
    each = F.transform(F.split(body, SENTENCE_BREAK), clean_sentence)
    return F.filter(each, lambda s: (word_count(s) > 8) & ~s.rlike(EMPTY_SENTENCES[0]) & ~s.rlike(EMPTY_SENTENCES[1]))


def normalize_answer(col: Column) -> Column:
    s = clean_sentence(col)
    for pattern in ANSWER_OPENINGS:
        s = F.regexp_replace(s, pattern, "")
    return F.regexp_replace(squeeze(s), r"^[ \-:]+|[ \-:]+$", "")


def valid_compressed(col: Column) -> Column:
    """Whether a model's answer is one: four words or more."""
    t = strip(text_or_empty(col))
    return (word_count(t) >= 4) & ~F.lower(t).isin("true", "false", "yes", "no")


def best_sentences(question: Column, text: Column, most: int = 2) -> Column:
    """The sentences that share most words with the question, the earlier of equals first."""
    asked = F.array_distinct(tokens(question))
    ranked = F.transform(sentences(text), lambda s, i: F.struct((-F.size(F.array_intersect(asked, tokens(s)))).alias("o"), i.alias("i"), s.alias("s")))
    return F.transform(F.slice(F.array_sort(ranked), 1, most), lambda r: r["s"])


def values(text: Column) -> Column:
    """Money values, then rates, as they stand."""
    c = clean_sentence(text)
    return F.concat(F.regexp_extract_all(c, F.lit(MONEY), F.lit(0)), F.regexp_extract_all(c, F.lit(RATE), F.lit(0)))


def request_sentence(text: Column) -> Column:
    cue = "(?i)" + "|".join(REQUEST_CUES)
    asked = F.filter(F.transform(F.filter(content_sentences(text), lambda s: s.rlike(cue)), normalize_answer), lambda s: ~F.lower(s).contains("forwarded by"))
    return blank_to_null(F.get(asked, F.lit(0)))


def topic_hint(subject: Column) -> Column:
    s = normalize_answer(strip(text_or_empty(subject)))
    return F.when(s != "", F.concat(F.lit("This thread is mainly about "), lower_first(s), F.lit(".")))


def distinct_items(items: DataFrame, keep: int = 5) -> DataFrame:
    """Items without repeated subject and preview, renumbered as ``place`` from 1."""
    sign = [F.lower(strip(text_or_empty(F.col("subject")))), F.lower(strip(text_or_empty(F.col("text_preview"))))]
    w = Window.partitionBy("query_id", "_a", "_b").orderBy("rank")
    # texts move once: rows of one question lie together for both windows
    one = items.repartition("query_id").withColumns({"_a": sign[0], "_b": sign[1]}).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_a", "_b")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("place") <= keep)


def distinct_people(items: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, people): names of senders and recipients in order, each once without regard to case."""
    every = F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>")), F.coalesce("cc", F.array().cast("array<string>")))
    shown = items.select("query_id", "place", F.posexplode(every).alias("pos", "person")).filter("length(trim(person)) > 0").withColumn("norm", F.lower(strip(F.col("person"))))
    first = shown.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "norm").orderBy("place", "pos"))).filter("_n = 1")
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "pos"))).filter(F.col("k") <= most)
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "person"))), lambda x: x["person"]), ", ").alias("people"))


def _has_name(x: Column) -> Column:
    return (F.length(x["sender"]) > 0) | F.exists(x["others"], lambda o: F.length(o) > 0)


def answers(questions: DataFrame, items: DataFrame, rules: DataFrame | None = None, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, intent, answer, citations, used_items) for each question (query_id, text, evidence_text).

    ``rules`` (priority, phrase, template) are fixed sentences for texts that contain a phrase; the least priority wins.
    ``generate`` turns a column of prompts, null where none is asked, into a model's texts; without it answers are extracts.
    """
    asked = questions.select("query_id", intent(text_or_empty(F.col("text"))).alias("intent"), F.col("text"), F.coalesce(blank_to_null(F.col("evidence_text")), F.col("text")).alias("evidence_text"))
    used = distinct_items(items)
    if rules is None:
        used = used.withColumn("rule_hint", F.lit(None).cast("string"))
    else:
        hit = used.select("query_id", "place", F.lower(text_or_empty(F.col("chunk_text"))).alias("t")).join(F.broadcast(rules), F.col("t").contains(F.col("phrase")))  # a rule table of the caller
        used = used.join(hit.groupBy("query_id", "place").agg(F.min_by("template", "priority").alias("rule_hint")), ["query_id", "place"], "left")
    # the question's intent first: only what its answer is built from is read out of the texts
    routed = used.join(asked, "query_id")
    text, only = F.col("chunk_text"), lambda what, *intents: F.when(F.col("intent").isin(*intents), what)
    none = F.array().cast("array<string>")
    each = routed.select(
        "query_id", "intent", "place", "date_text", "sender", F.concat(F.coalesce("recipients", none), F.coalesce("cc", none)).alias("others"), "subject", "rule_hint", "message_id", citation(F.col("message_id"), F.col("page_no")).alias("cite"), F.struct(F.col("chunk_type").alias("cite_type"), "message_id", F.col("page_no").cast("int").alias("page_no")).alias("source"), slim().alias("slim"),
        only(topic_hint(F.col("subject")), "decision", "summary").alias("topic"), only(request_sentence(text), "decision").alias("request"), only(normalize_answer(F.get(content_sentences(text), F.lit(0))), "why", "summary").alias("lead"), only(values(text), "value").alias("values"),
        only(clean_sentence(F.array_join(best_sentences(F.col("evidence_text"), text), " ")), "default").alias("best"), only(F.regexp_extract(text_or_empty(text), MEETING_DATE, 1), "meeting").alias("meeting"), only(F.regexp_extract(text_or_empty(text), LAW_OFFICE, 1), "location").alias("office"), F.lower(F.col("text")).rlike("price|cap|rate").alias("rated"),
    )
    preferred = F.filter("values", lambda v: v.contains("/") | F.lower(v).contains("mwh"))
    each = each.withColumn("value", F.when(F.col("rated") & (F.size(preferred) > 0), F.get(preferred, F.lit(0))).otherwise(F.get("values", F.lit(0))))
    # at most five items of a question
    packed = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "message_id", "date_text", "sender", "others", "subject", "rule_hint", "cite", "source", "slim", "topic", "request", "lead", "best", "meeting", "office", "value"))).alias("i"))
    joined = asked.join(packed, "query_id", "left").join(distinct_people(used.join(asked.filter("intent = 'people'").select("query_id"), "query_id")), "query_id", "left")

    top, first = F.slice("i", 1, 3), F.get("i", F.lit(0))
    cites = F.array_join(F.transform(top, lambda x: x["cite"]), " ")
    sources = lambda of: F.transform(of, lambda x: x["source"])
    pick = lambda field, among: F.get(F.filter(among, lambda x: F.length(x[field]) > 0), F.lit(0))
    said_by = lambda before, what, x: F.concat(F.lit(before), what, F.lit(" "), x["cite"])
    dated, req, val = F.coalesce(pick("date_text", F.col("i")), first), pick("request", top), pick("value", F.col("i"))
    line = lambda x: F.concat(F.coalesce(blank_to_null(x["date_text"]), F.lit("Unknown date")), F.lit(": "), F.coalesce(blank_to_null(x["sender"]), F.lit("Unknown sender")), F.lit(" re "), F.coalesce(blank_to_null(x["subject"]), F.lit("No subject")), F.lit(" "), x["cite"])
    timeline = F.array_sort(F.transform("i", lambda x: F.struct(text_or_empty(x["date_text"]).alias("d"), text_or_empty(x["message_id"]).alias("m"), x["place"].alias("p"), strip(line(x)).alias("l"), x["source"].alias("source"))))
    told_lines = F.transform(timeline, lambda x: x["l"])
    led = F.filter(top, lambda x: word_count(x["lead"]) > 6)
    points = F.array_distinct(F.transform(led, lambda x: x["lead"]))
    told = F.filter(top, lambda x: word_count(x["best"]) >= 5)
    said = F.array_distinct(F.transform(told, lambda x: x["best"]))
    joined = joined.withColumns({"points": points, "said": said})
    grounded = F.array_join(F.transform("said", lambda s: F.concat(s, F.lit(" "), F.array_join(F.transform(F.filter(told, lambda x: x["best"] == s), lambda x: x["cite"]), " "))), " ")
    one, two = F.get("points", F.lit(0)), F.get("points", F.lit(1))
    lead = F.concat(F.lit("This thread is about "), lower_first(one))
    apart = two.isNotNull() & ~F.contains(F.lower(one), F.lower(two)) & ~F.contains(F.lower(two), F.lower(one)) & ~F.contains(F.lower(lead), F.lower(two))
    summed = F.concat(F.when(apart, F.concat(lead, F.lit(" "), two)).otherwise(lead), F.lit(" "), cites)
    topical = F.coalesce(first["rule_hint"], first["topic"])
    if generate is not None:
        ask_summary = F.concat(F.lit("summarize the following evidence in 2 concise sentences: "), F.array_join(F.slice("points", 1, 3), " "))
        ask_answer = F.concat(F.lit("answer the question in 2 short sentences using only the provided evidence. question: "), F.col("evidence_text"), F.lit(" evidence: "), F.array_join(F.slice("said", 1, 3), " "))
        prompt = F.when((F.col("intent") == "summary") & topical.isNull() & (F.size("points") > 0), ask_summary).when((F.col("intent") == "default") & (F.size("said") > 0), ask_answer)
        joined = joined.withColumn("_prompt", prompt).withColumn("_model", generate(F.col("_prompt")))
        model = F.when(valid_compressed(F.col("_model")), F.concat(F.col("_model"), F.lit(" "), cites))
        summed, grounded = F.coalesce(model, summed), F.coalesce(model, grounded)
    only_first = F.array(first["source"])
    built = {
        "timeline": (F.when(F.size("i") == 1, F.concat(F.lit("This thread has one indexed message. "), F.get(told_lines, F.lit(0)))).otherwise(F.array_join(F.array_distinct(F.slice(told_lines, 1, 8)), "\n")), sources(timeline)),
        "people": (F.concat(F.lit("The conversation involves: "), F.col("people"), F.lit(". "), cites), sources(F.filter("i", _has_name))),
        "decision": (F.coalesce(said_by("", first["rule_hint"], first), said_by("The main request or proposal is: ", req["request"], req), said_by("I do not see a formal decision in this thread. It mainly shares information: ", first["topic"], first)), F.array(F.when(first["rule_hint"].isNull() & req.isNotNull(), req["source"]).otherwise(first["source"]))),
        "why": (F.coalesce(said_by("", first["rule_hint"], first), F.when(F.length(first["lead"]) > 0, said_by("The email was forwarded to share this information more widely: ", first["lead"], first))), only_first),
        "meeting": (F.when(F.length(first["meeting"]) > 0, F.concat(F.lit("The thread refers to a meeting scheduled for "), first["meeting"], F.lit(". "), first["cite"])), only_first),
        "location": (F.when(F.length(first["office"]) > 0, F.concat(F.lit("The meeting is connected to the law offices of "), strip(first["office"]), F.lit(". "), first["cite"])), only_first),
        "value": (F.concat(F.lit("The key value mentioned is "), val["value"], F.lit(". "), cites), F.array(val["source"])),
        "date": (F.concat(F.lit("The message was sent on "), F.coalesce(dated["date_text"], F.lit("an unknown date")), F.lit(". "), dated["cite"]), F.array(dated["source"])),
        "summary": (F.coalesce(said_by("", topical, first), summed), F.when(topical.isNotNull(), only_first).otherwise(sources(led))),
        "default": (grounded, sources(told)),
    }
    text_of = cited = None
    for name, (what, which) in built.items():
        text_of = F.when(F.col("intent") == name, what) if text_of is None else text_of.when(F.col("intent") == name, what)
        cited = F.when(F.col("intent") == name, which) if cited is None else cited.when(F.col("intent") == name, which)
    held = joined.withColumn("_text", blank_to_null(strip(text_of)))
    answer = F.when(F.col("i").isNull(), NO_ITEMS).otherwise(F.coalesce("_text", F.lit(NO_EVIDENCE)))
    known = F.col("i").isNotNull() & F.col("_text").isNotNull()
    return held.select("query_id", "intent", answer.alias("answer"), F.when(known, cited).otherwise(F.array()).alias("citations"), F.when(known, F.transform(top, lambda x: x["slim"])).otherwise(F.array()).alias("used_items"))
