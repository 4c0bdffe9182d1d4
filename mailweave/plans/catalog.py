"""Queries of the engine's own operators, on the tables of a data directory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import text as T
from mailweave.operators import answers, chunks, cleaning, retrieval, sessions, slicer, threads
from mailweave.operators.instants import to_instants
from mailweave.plans.sql import SQL as SQL
from mailweave.sources import mailcsv
from mailweave.sources.tables import load, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _mail(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "email_structure")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ingest").select("doc_id", "row_idx", "thread_id", "message_id", "subject", "date_text", "sender", "recipients", "cc", "chunk_text", "chunk_type", "page_no", "filename")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return sessions.distinct_turns(load(spark, d, "trace_turns"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select(F.col("trace_id").alias("query_id"), "thread_id", F.col("user_text").alias("text"), F.col("rewrite").alias("evidence_text"), "search_outside_thread")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct question once, for searches over all threads."""
    return load(spark, d, "trace_turns").filter("length(user_text) > 0").select(F.col("user_text").alias("query_id"), F.col("user_text").alias("text"), F.lit(None).cast("string").alias("thread_id")).distinct()


def _digest(col) -> F.Column:
    return F.md5(col)


@query
def p1_found(spark, d):
    return to_instants(_mail(spark, d), load(spark, d, "mailboxes")).distinct()


_STORED: dict[tuple[str, str], retrieval.Index] = {}


def _index(spark: SparkSession, d: str) -> retrieval.Index:
    """The index of a data directory, stored once in a session."""
    kept = (spark.sparkContext.applicationId, d)
    if kept not in _STORED:
        _STORED[kept] = retrieval.store_index(_chunks(spark, d), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _STORED[kept]


@query
def index_build(spark, d):
    """Builds and stores the index anew; its terms with their statistics."""
    _STORED.pop((spark.sparkContext.applicationId, d), None)
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk_partition(spark, d):
    return retrieval.ranked(_index(spark, d), _questions(spark, d)).select("query_id", "rank", "doc_id", "score")


@query
def bm25_topk_global(spark, d):
    return retrieval.ranked(_index(spark, d), _texts(spark, d), scoped=False).select("query_id", "rank", "doc_id", "score")


@query
def bm25_repeated_terms(spark, d):
    asked = _questions(spark, d).withColumn("text", F.concat_ws(" ", "text", "evidence_text"))
    return retrieval.scores(_index(spark, d), asked, True).select("query_id", "doc_id", "score")


@query
def retrieval_cascade(spark, d):
    return retrieval.cascade(_index(spark, d), _questions(spark, d).drop("search_outside_thread")).select("query_id", "tier", "rank", "doc_id")


@query
def retrieved_items(spark, d):
    """What a search in the question's thread gives, field by field."""
    found = retrieval.search(_index(spark, d), _questions(spark, d))
    return found.select("query_id", "rank", "doc_id", "thread_id", "message_id", "page_no", "filename", "chunk_type", "score", "subject", "date_text", "sender", F.array_join(F.coalesce("recipients", F.array().cast("array<string>")), "|").alias("recipients"), F.array_join(F.coalesce("cc", F.array().cast("array<string>")), "|").alias("cc"), F.md5("chunk_text").alias("text_digest"), "text_preview")


@query
def term_doc_freq(spark, d):
    return _index(spark, d).terms.select("term", "df")


@query
def doc_length_stats(spark, d):
    return _index(spark, d).corpus.select("docs", F.round("avg_length", 4).alias("avg_length"))


@query
def search_dedupe_signature(spark, d):
    return retrieval.first_per_signature(_chunks(spark, d))


@query
def list_first_per_key(spark, d):
    return retrieval.listed(_chunks(spark, d)).select("thread_id", "rank", "doc_id")


@query
def thread_counts(spark, d):
    return retrieval.thread_counts(_chunks(spark, d))


@query
def chunk_pack(spark, d):
    packed = _mail(spark, d).select("row_idx", F.posexplode(chunks.packed_sections(F.col("body"), 60)).alias("pos", "section_text"))
    return packed.select("row_idx", (F.col("pos") + 1).alias("section"), F.size(T.tokens(F.col("section_text"))).alias("token_count"), _digest(F.col("section_text")).alias("digest"))


@query
def chunk_rows(spark, d):
    return chunks.chunked(_mail(spark, d)).select("doc_id", "row_idx", "section", "message_id", "token_count", _digest(F.col("chunk_text")).alias("digest"))


@query
def subject_normalize(spark, d):
    return _mail(spark, d).select("row_idx", T.normalize_subject(F.col("subject")).alias("normalized_subject"))


@query
def participants(spark, d):
    return _mail(spark, d).select("row_idx", F.array_join(F.array_sort(T.participants(F.col("sender"), F.col("recipients"), F.col("cc"))), "|").alias("participants"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _mail(spark, d).withColumn("wall_time", mailcsv.wall_time(F.col("date_text")))


@query
def gap_sessions(spark, d):
    return threads.gap_sessions(_timed(spark, d), "wall_time")


@query
def thread_components(spark, d):
    return threads.infer_threads(_timed(spark, d), "wall_time").select("row_idx", "thread_row")


@query
def thread_numbers(spark, d):
    return threads.threaded_records(_timed(spark, d), "wall_time").select("row_idx", "thread_id", "normalized_subject")


@query
def whitespace_normalize(spark, d):
    return _mail(spark, d).select("row_idx", _digest(T.squeeze(T.text_or_empty(F.col("body")))).alias("digest"))


@query
def html_strip(spark, d):
    return _mail(spark, d).select("row_idx", _digest(cleaning.strip_markup(F.col("body"))).alias("digest"))


@query
def forward_header_runs(spark, d):
    return _mail(spark, d).select("row_idx", _digest(cleaning.drop_header_runs(F.col("body"))).alias("digest"))


@query
def disclaimer_cut(spark, d):
    return _mail(spark, d).select("row_idx", _digest(cleaning.cut_disclaimer(F.col("body"))).alias("digest"))


@query
def newsletter_noise(spark, d):
    return _mail(spark, d).select("row_idx", _digest(cleaning.drop_newsletter_noise(F.col("body"))).alias("digest"))


@query
def unwrap_lines(spark, d):
    return _mail(spark, d).select("row_idx", _digest(cleaning.unwrap_lines(F.col("body"))).alias("digest"))


@query
def clean_body(spark, d):
    return cleaning.with_clean_body(_mail(spark, d).select("row_idx", "body")).select("row_idx", _digest(F.col("clean_body")).alias("digest"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Each mail written out as a raw message of ten headers, folded subjects, quoted-printable bodies in every third, and an attachment part where there are copies."""
    m = _mail(spark, d)
    many = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", ")
    coded = F.pmod("row_idx", F.lit(3)) == 0
    flat = lambda c: F.regexp_replace(T.text_or_empty(c), r"[\r\n]+", " ")
    named = {
        "Message-ID": flat(F.col("message_id")), "Subject": F.regexp_replace(T.squeeze(T.text_or_empty(F.col("subject"))), " ", "\n "), "Date": flat(F.col("date_text")), "From": flat(F.col("sender")), "To": many("recipients"), "Cc": many("cc"),
        "In-Reply-To": flat(F.col("in_reply_to")), "References": many("ref_ids"), "Content-Transfer-Encoding": F.when(coded, "quoted-printable").otherwise("8bit"),
    }
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), v) for k, v in named.items()])
    body = T.text_or_empty(F.col("body"))
    body = F.when(coded, F.regexp_replace(F.regexp_replace(body, "=", "=3D"), "\u00E9", "=C3=A9")).otherwise(body)
    part = F.when(F.size("cc") > 0, "\n\nContent-Disposition: Attachment; FileName=notes.txt").otherwise("")
    return m.select("row_idx", F.col("source_file").alias("file"), F.concat(head, F.lit("\n\n"), body, part).alias("message"))


def _slice_rows(spark: SparkSession, d: str) -> DataFrame:
    return mailcsv.message_metadata(_raw(spark, d))


@query
def message_metadata(spark, d):
    return _slice_rows(spark, d)


@query
def month_stats(spark, d):
    return slicer.month_stats(_slice_rows(spark, d))


@query
def window_scores(spark, d):
    return slicer.window_scores(_slice_rows(spark, d)).select("start", "span", "messages", "flagged", "viable", "score")


@query
def window_choice(spark, d):
    return slicer.choose_window(_slice_rows(spark, d)).select("start", "span", "last", "messages", "flagged", "viable", "score")


@query
def thread_rank(spark, d):
    rows = _slice_rows(spark, d)
    return slicer.thread_ranks(rows, slicer.choose_window(rows)).select("rank", "subject", "messages", "flagged")


@query
def slice_cap(spark, d):
    rows = _slice_rows(spark, d)
    window = slicer.choose_window(rows)
    chosen = slicer.select_threads(slicer.thread_ranks(rows, window))
    return slicer.slice_rows(rows, window, chosen).select("row_idx", "subject", "running_bytes")


@query
def slice_summary(spark, d):
    rows = _slice_rows(spark, d)
    window = slicer.choose_window(rows)
    chosen = slicer.select_threads(slicer.thread_ranks(rows, window))
    made = slicer.slice_summary(slicer.slice_rows(rows, window, chosen), window)
    return made.withColumn("thread_message_counts", F.to_json("thread_message_counts"))


def _written(turns: str) -> F.Column:
    """A list of turns written out, field by field."""
    cites = lambda t: F.array_join(F.transform(t["citations"], lambda c: F.concat_ws("/", c["cite_type"], c["message_id"], c["page_no"].cast("string"))), ",")
    return F.array_join(F.transform(turns, lambda t: F.concat_ws("|", T.text_or_empty(t["user_text"]), T.text_or_empty(t["rewrite"]), T.text_or_empty(t["answer"]), cites(t), F.date_format(t["timestamp"], "yyyy-MM-dd HH:mm:ss"))), " || ")


@query
def history_last_n(spark, d):
    return sessions.history(_turns(spark, d)).select("trace_id", "epoch", _written("history").alias("history"))


@query
def session_state(spark, d):
    state = sessions.session_states(_turns(spark, d))
    return state.select("session_id", "thread_id", _written("history").alias("history"), *[F.array_join(k, "|").alias(k) for k in sessions.NOTE_PATTERNS], "last_topic")


@query
def session_switch_reset(spark, d):
    """Sessions of long questions switch to a thread of their own, those of outside searches are reset."""
    turns = _turns(spark, d)
    states = sessions.session_states(turns)
    to = turns.groupBy("session_id").agg(F.max("thread_id").alias("thread_id"), F.max(F.length("user_text")).alias("n")).filter("n > 60").select("session_id", "thread_id")
    back = turns.filter("search_outside_thread").select("session_id")
    done = sessions.reset(sessions.switched(states, to), back)
    return done.select("session_id", "thread_id", F.size("history").alias("turns"), F.size("people").alias("people"), "last_topic")


@query
def prev_reference(spark, d):
    return sessions.previous_reference(_turns(spark, d)).select("trace_id", "reference")


@query
def entity_notes_running(spark, d):
    noted = sessions.with_notes(_turns(spark, d))
    return noted.select("trace_id", *[F.array_join(k, "|").alias(k) for k in sessions.NOTE_PATTERNS], "last_topic")


@query
def needs_rewrite(spark, d):
    return _turns(spark, d).select("trace_id", sessions.needs_rewrite(F.col("user_text")).alias("needs"))


@query
def rule_rewrite(spark, d):
    return sessions.rewritten(_turns(spark, d)).select("trace_id", "needs", "rewritten")


@query
def intent_route(spark, d):
    return _turns(spark, d).select("trace_id", answers.intent(T.text_or_empty(F.col("user_text"))).alias("intent"))


@query
def sentence_rank(spark, d):
    pairs = _chunks(spark, d).select("doc_id", "subject", "chunk_text")
    return pairs.select("doc_id", F.md5(F.array_join(answers.best_sentences(F.col("subject"), F.col("chunk_text")), "|")).alias("digest"))


@query
def content_sentences(spark, d):
    return _chunks(spark, d).select("doc_id", F.size(answers.content_sentences(F.col("chunk_text"))).alias("n"), F.md5(F.array_join(answers.content_sentences(F.col("chunk_text")), "|")).alias("digest"))


@query
def entity_extract(spark, d):
    return load(spark, d, "documents").select("doc_id", *[F.array_join(sessions.extract(F.col("text"), k), "|").alias(k) for k in ("people", "dates", "amounts", "filenames")])


@query
def value_extract(spark, d):
    return _chunks(spark, d).select("doc_id", F.array_join(answers.values(T.text_or_empty(F.col("chunk_text"))), "|").alias("found"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.listing(_chunks(spark, d)).withColumn("query_id", F.col("thread_id"))


@query
def item_dedupe(spark, d):
    return answers.distinct_items(_listed(spark, d)).select("query_id", "place", "doc_id")


@query
def people_answer(spark, d):
    return answers.distinct_people(answers.distinct_items(_listed(spark, d)))


def _told(df: DataFrame) -> DataFrame:
    """Answers with their citations and used items written out."""
    part = lambda *cols: F.concat_ws("/", *[c.cast("string") for c in cols])
    cites = F.array_join(F.transform("citations", lambda c: part(c["cite_type"], c["message_id"], c["page_no"])), " ")
    used = F.array_join(F.transform("used_items", lambda u: part(*[u[k] for k in ("doc_id", "thread_id", "message_id", "page_no", "filename", "chunk_type", "score", "subject", "date_text")], F.md5(u["text_preview"]))), " ")
    return df.select("query_id", "intent", "answer", cites.alias("citations"), used.alias("used_items"))


@query
def answer_turns(spark, d):
    asked, index = _questions(spark, d), _index(spark, d)
    found = retrieval.with_chunks(index, retrieval.cascade(index, asked).drop("tier"))
    return _told(answers.answers(asked, found))


def _listed_answers(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        items = _listed(spark, d)
        asked = items.select("query_id").distinct().withColumns({"text": F.lit(text), "evidence_text": F.lit(text)})
        return _told(answers.answers(asked, items))

    return run


for _name, _text in {
    "timeline_answer": "show the timeline", "people_reply": "who is involved", "decision_answer": "what was the decision", "why_answer": "why was it forwarded", "meeting_answer": "which meeting", "location_answer": "where is it connected to", "value_answer": "what is the price",
    "date_answer": "when was the mail", "summary_answer": "give me a summary", "grounded_answer": "the pension and the tariff",
}.items():
    QUERIES[_name] = _listed_answers(_text)


@query
def rule_table_hint(spark, d):
    """Fixed sentences about the organisations of the directory, the first one that the text names."""
    named = load(spark, d, "contacts").filter("contact_kind = 'organisation'")
    rules = named.select(F.col("contact_id").alias("priority"), F.lower("full_name").alias("phrase"), F.concat(F.lit("This thread is about "), "full_name", F.lit(".")).alias("template"))
    items = _listed(spark, d)
    asked = items.select("query_id").distinct().withColumns({"text": F.lit("give me a summary"), "evidence_text": F.lit(None).cast("string")})
    return _told(answers.answers(asked, items, rules))


@query
def mime_parse(spark, d):
    h = mailcsv.headers(F.col("message"))
    return _raw(spark, d).select("row_idx", *[mailcsv.header(h, k).alias(k.replace("-", "_")) for k in ("message-id", "subject", "from", "in-reply-to")], F.md5(mailcsv.body_of(F.col("message"))).alias("digest"))


@query
def structured_records(spark, d):
    s = mailcsv.structured(_raw(spark, d))
    return s.select("row_idx", "source_file", "message_id", "subject", "date_text", "sender", "in_reply_to", *[F.array_join(c, "|").alias(c) for c in ("recipients", "cc", "ref_ids")], F.md5("body").alias("digest"))


@query
def ingest_chunks(spark, d):
    """From raw messages to chunks."""
    _, cut = chunks.ingested(_raw(spark, d))
    return cut.select("doc_id", "row_idx", "section", "thread_id", "message_id", "subject", "date_text", "token_count", F.md5("chunk_text").alias("digest"))


@query
def address_list(spark, d):
    joined = F.array_join(F.coalesce("recipients", F.array().cast("array<string>")), ", ")
    return _mail(spark, d).select("row_idx", F.array_join(mailcsv.list_field(joined), "|").alias("entries"))


@query
def date_normalize(spark, d):
    return _mail(spark, d).select("row_idx", mailcsv.iso_date(F.col("date_text")).alias("iso"))


@query
def quoted_printable(spark, d):
    """Bodies written with every byte escaped, decoded again."""
    escaped = F.regexp_replace(F.hex(F.encode(T.text_or_empty(F.col("body")), "UTF-8")), "(..)", "=$1")
    return _mail(spark, d).select("row_idx", F.md5(mailcsv.quoted_printable(escaped)).alias("digest"))


@query
def raw_csv(spark, d):
    """Raw messages written as CSV with quoted cells of many lines, and read back."""
    path = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    mailcsv.write_slice(_raw(spark, d), path)
    return mailcsv.read_raw(spark, path).select("file", F.md5("message").alias("digest"))


@query
def keyword_tokens(spark, d):
    return _turns(spark, d).select("trace_id", F.array_join(sessions.keywords(F.col("user_text")), " ").alias("words"), sessions.valid_rewrite(F.col("user_text"), F.col("rewrite")).alias("valid"), answers.valid_compressed(F.col("answer")).alias("compressed"))


@query
def trace_roundtrip(spark, d):
    """Turns with what was retrieved for them, written as JSON lines of thirteen fields under a run and read back."""
    index, asked = _index(spark, d), _questions(spark, d)
    hits = retrieval.with_chunks(index, retrieval.ranked(index, asked))
    kept = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", retrieval.slim().alias("item")))).alias("r"))  # at most five
    items = F.transform("r", lambda x: x["item"])
    turns = _turns(spark, d).join(kept, F.col("trace_id") == F.col("query_id"), "left").withColumns({"retrieved": items, "used_items": F.slice(items, 1, 3)})
    path = f"{shared_folder(spark)}/trace-{uuid.uuid4().hex}"
    mailcsv.write_trace(turns, path, "run")
    back = mailcsv.read_trace(spark, path)
    cites = F.array_join(F.transform("citations", lambda c: F.concat_ws("/", c["cite_type"], c["message_id"], c["page_no"].cast("string"))), " ")
    names = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["doc_id"], x["score"].cast("string"), F.md5(x["text_preview"]))), " ")
    return back.select("trace_id", "logged_at", "session_id", "thread_id", "user_text", "rewrite", names("retrieved").alias("retrieved"), names("used_items").alias("used_items"), "answer", cites.alias("citations"), "latency_ms", "search_outside_thread", F.size("token_counts").alias("token_counts"))
