"""Session state over recorded turns: sessions, bounded history, running notes, rewriting of vague questions.

Sessions are rows (session_id, thread_id, history, people, dates, amounts, filenames, message_ids, last_topic): history holds
the last turns as structs, the notes what was named so far. A switch of thread or a reset starts both anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from mailweave.functions.text import blank_to_null, strip, text_or_empty

HISTORY, CONTEXT, REWRITE_CHARS = 5, 2, 240
# Words that point back, and words that open a full question.
POINTING = ["that", "it", "he", "she", "they", "them", "those", "these", "earlier", "previous", "same one", "that one"]
OPENINGS = ["who ", "what ", "when ", "where ", "why ", "show ", "summarize "]
# What notes are taken of.
NOTE_PATTERNS = {
    "people": r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "dates": r"(?U)\b(?:\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b",
    "amounts": r"(?iU)(?:\$|USD\s?)\d[\d,]*(?:\.\d+)?",
    "filenames": r"(?iU)\b[\w,\-]+\.(?:pdf|docx?|txt|html?)\b",
    "message_ids": r"<[^>\s]+>",
}
# What a model says that is no rewriting, and words of a question that count.
NO_REWRITE = r"(?iU)\b(not_duplicate|return one short search query|duplicate)\b"
KEYWORD = r"(?U)\b[a-zA-Z][a-zA-Z0-9./'-]{2,}\b"
MOST_KEYWORDS = 18
_POINTS = r"(?iU)\b(?:" + "|".join(POINTING) + r")\b"
_ITEMS = "array<struct<subject:string,filename:string>>"


def distinct_turns(turns: DataFrame) -> DataFrame:
    """One row per trace id: recorded twice, the earlier stays."""
    w = Window.partitionBy("trace_id").orderBy("logged_at", "user_text")
    return turns.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _in_session() -> Window:
    return Window.partitionBy("session_id", "epoch").orderBy("logged_at", "trace_id")


def with_epochs(turns: DataFrame) -> DataFrame:
    """epoch counts the switches of thread in a session; history and notes start anew with each."""
    w = Window.partitionBy("session_id").orderBy("logged_at", "trace_id")
    switched = F.when(F.coalesce(F.lag("thread_id").over(w) != F.col("thread_id"), F.lit(False)), 1).otherwise(0)
    return turns.withColumn("_s", switched).withColumn("epoch", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def turn(turns: DataFrame) -> Column:
    """A turn as sessions keep it."""
    retrieved = F.col("retrieved") if "retrieved" in turns.columns else F.expr("cast(array() as array<struct<doc_id:string>>)")
    return F.struct("user_text", "rewrite", "answer", F.coalesce("citations", F.expr("array()")).alias("citations"), retrieved.alias("retrieved"), F.col("logged_at").alias("timestamp"))


def history(turns: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Each turn with the last ``keep`` turns of its session up to it, oldest first."""
    w = _in_session().rowsBetween(-(keep - 1), 0)
    return with_epochs(turns).withColumn("history", F.collect_list(turn(turns)).over(w))


def previous_reference(turns: DataFrame) -> DataFrame:
    """What a pointing word refers to: the rewrite, else the answer, else the question of the turn before."""
    w = _in_session()
    before = [blank_to_null(F.lag(c).over(w)) for c in ("rewrite", "answer", "user_text")]
    return with_epochs(turns).withColumn("reference", F.coalesce(*before))


def extract(col: Column, kind: str) -> Column:
    return F.regexp_extract_all(text_or_empty(col), F.lit(NOTE_PATTERNS[kind]), F.lit(0))


def with_notes(turns: DataFrame) -> DataFrame:
    """Each turn with the distinct people, dates, amounts, file names and message ids of its session so far, in the order they came, and the last topic.

    ``retrieved`` items, where the turns have them, add their file names, and the first subject to turns without text. Only
    what a turn names for the first time is carried through the session.
    """
    text = F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in ("user_text", "rewrite", "answer")])
    cited = F.filter(F.transform(F.coalesce("citations", F.expr("cast(array() as array<struct<cite_type:string,message_id:string,page_no:int>>)")), lambda c: c["message_id"]), lambda m: F.length(m) > 0)
    out = with_epochs(turns).withColumn("_text", text)
    items = F.col("retrieved") if "retrieved" in turns.columns else F.lit(None).cast(_ITEMS)
    more = {"message_ids": cited, "filenames": F.filter(F.coalesce(F.transform(items, lambda i: i["filename"]), F.array().cast("array<string>")), lambda f: F.length(f) > 0)}
    kinds = list(NOTE_PATTERNS)
    out = out.withColumns({f"_{k}": F.concat(extract(F.col("_text"), k), more[k]) if k in more else extract(F.col("_text"), k) for k in kinds})
    marked = lambda n: lambda x, i: F.struct(F.lit(n).alias("kind"), x.alias("item"), i.alias("at"))
    of_kind = lambda n: lambda x: x["kind"] == n
    named = F.flatten(F.array(*[F.transform(f"_{k}", marked(n)) for n, k in enumerate(kinds)]))
    each = out.select("session_id", "epoch", "logged_at", "trace_id", F.explode(named).alias("n")).select("session_id", "epoch", "logged_at", "trace_id", "n.*")
    first = each.groupBy("session_id", "epoch", "kind", "item").agg(F.min(F.struct("logged_at", "trace_id", "at")).alias("f")).select("kind", "item", "f.trace_id", "f.at")
    own = first.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "item"))).alias("_new"))  # of one turn
    out = out.drop(*[f"_{k}" for k in kinds]).join(own, "trace_id", "left")
    w = _in_session().rowsBetween(Window.unboundedPreceding, 0)
    for n, k in enumerate(kinds):
        new = F.transform(F.filter("_new", of_kind(n)), lambda x: x["item"])
        out = out.withColumn(k, F.flatten(F.collect_list(F.coalesce(new, F.array().cast("array<string>"))).over(w)))
    subject = F.get(F.filter(F.transform(items, lambda i: i["subject"]), lambda x: F.length(x) > 0), F.lit(0))
    said = lambda c: F.when(F.length(c) > 0, strip(F.col(c)))
    topic = blank_to_null(F.coalesce(said("rewrite"), said("user_text"), subject))
    return out.withColumn("last_topic", F.last(topic, True).over(w)).drop("_text", "_new")


def started(threads: DataFrame) -> DataFrame:
    """A new, empty session for each row of thread_id."""
    ident = F.concat(F.lit("sess_"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12))
    none = F.array().cast("array<string>")
    return threads.select(ident.alias("session_id"), "thread_id", F.expr("cast(array() as array<struct<user_text:string>>)").alias("history"), *[none.alias(k) for k in NOTE_PATTERNS], F.lit(None).cast("string").alias("last_topic"))


def session_states(turns: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The state of each session after its last turn."""
    noted = with_notes(turns).withColumn("_turn", turn(turns))
    held = noted.withColumn("history", F.collect_list("_turn").over(_in_session().rowsBetween(-(keep - 1), 0)))
    last = Window.partitionBy("session_id").orderBy(F.desc("logged_at"), F.desc("trace_id"))
    return held.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("session_id", "thread_id", "history", *NOTE_PATTERNS, "last_topic")


def _emptied(states: DataFrame, hit: Column) -> DataFrame:
    cleared = {c: F.when(hit, F.array().cast(states.schema[c].dataType)).otherwise(F.col(c)) for c in ["history", *NOTE_PATTERNS]}
    return states.withColumns(cleared | {"last_topic": F.when(~hit, F.col("last_topic"))})


def switched(states: DataFrame, switches: DataFrame) -> DataFrame:
    """States after switches (session_id, thread_id), one a session: those sessions go on with the new thread, empty."""
    to = switches.select("session_id", F.col("thread_id").alias("_to"), F.lit(True).alias("_hit"))
    joined = states.join(to, "session_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return _emptied(joined, F.col("_hit")).withColumn("thread_id", F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("thread_id"))).drop("_to", "_hit")


def reset(states: DataFrame, sessions: DataFrame) -> DataFrame:
    """States after resets (session_id): those sessions keep their thread and start empty."""
    hit = sessions.select("session_id").distinct().withColumn("_hit", F.lit(True))
    return _emptied(states.join(hit, "session_id", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))), F.col("_hit")).drop("_hit")


def session(states: DataFrame, session_id: str) -> Row:
    """The state of one session; ValueError if there is none."""
    found = states.filter(F.col("session_id") == session_id).take(1)
    if not found:
        raise ValueError(f"session not found: {session_id}")
    return found[0]


def needs_rewrite(col: Column) -> Column:
    """Points back, or is at most three words and opens no full question."""
    t = F.lower(strip(text_or_empty(col)))
    opens = F.lit(False)
    for o in OPENINGS:
        opens = opens | t.startswith(o)
    words = F.size(F.regexp_extract_all(t, F.lit(r"\S+"), F.lit(0)))
    return F.when(t == "", False).when(t.rlike(_POINTS), True).otherwise(~opens & (words <= 3))


def points_back(col: Column) -> Column:
    return text_or_empty(col).rlike(_POINTS)


def hints(prefix: str = "_before_") -> Column:
    """Memory hints in fixed order, the last two of each kind."""
    last_two = lambda kind: F.array_join(F.slice(F.col(prefix + kind), F.greatest(F.size(prefix + kind) - 1, F.lit(1)), 2), ", ")
    topic = F.when(F.length(F.col(prefix + "last_topic")) > 0, F.concat(F.lit("topic: "), F.col(prefix + "last_topic")))
    others = [F.when(F.size(prefix + k) > 0, F.concat(F.lit(f"{k}: "), last_two(k))) for k in ("filenames", "message_ids", "dates", "amounts", "people")]
    return F.array_compact(F.array(topic, *others))


def keywords(col: Column) -> Column:
    """The lower-case words of three characters or more, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(col), F.lit(KEYWORD), F.lit(0)), F.lower))


def valid_rewrite(original: Column, model: Column) -> Column:
    """Whether a model's rewriting is one: it shares a word with the question, holds few words, and isn't an echo of the prompt."""
    asked, said = keywords(original), keywords(model)
    return F.coalesce((F.length(strip(model)) > 0) & ~model.rlike(NO_REWRITE) & (F.size(said) > 0) & ((F.size(asked) == 0) | F.arrays_overlap(asked, said)) & (F.size(said) <= MOST_KEYWORDS), F.lit(False))


def rewritten(turns: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each turn with ``needs`` and ``rewritten``: a question that points back gains the reference and the first two hints, cut to 240 characters.

    ``generate`` turns a column of prompts, null where none is asked, into a model's rewritings, taken where they are valid.
    """
    noted, w, empty = with_notes(turns), _in_session(), F.array().cast("array<string>")
    noted = noted.withColumns({f"_before_{kind}": F.coalesce(F.lag(kind).over(w), empty) for kind in NOTE_PATTERNS})
    before = [blank_to_null(F.lag(c).over(w)) for c in ("rewrite", "answer", "user_text")]
    noted = noted.withColumns({"_before_last_topic": F.lag("last_topic").over(w), "reference": F.coalesce(*before), "needs": needs_rewrite(F.col("user_text"))}).withColumn("_hints", hints())
    text = strip(text_or_empty(F.col("user_text")))
    long = strip(F.substring(F.concat_ws(" ", text, F.col("reference"), F.get("_hints", F.lit(0)), F.get("_hints", F.lit(1))), 1, REWRITE_CHARS))
    cut = strip(F.substring(text, 1, REWRITE_CHARS))
    done = F.when(F.col("needs") & points_back(F.col("user_text")), long).when(F.col("needs"), cut).otherwise(text)
    if generate is not None:
        told = F.when(F.size("_hints") > 0, F.concat(F.lit("memory hints: "), F.array_join("_hints", "; ")))
        prompt = F.concat_ws(" ", F.lit("rewrite the user question for email retrieval."), F.concat(F.lit("user question: "), text), F.concat(F.lit("recent context: "), F.col("reference")), told, F.lit("return one short search query."))
        noted = noted.withColumn("_model", generate(F.when(F.col("needs"), prompt)))
        done = F.when(F.col("needs") & valid_rewrite(text, F.col("_model")), strip(F.col("_model"))).otherwise(done)
    return noted.withColumn("rewritten", done).drop("_hints", "_model", *[f"_before_{k}" for k in [*NOTE_PATTERNS, "last_topic"]])
