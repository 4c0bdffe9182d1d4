import random
import time
from datetime import datetime
from email.utils import parsedate_to_datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mailweave.operators import answers, chunks, cleaning, sessions, slicer, threads
from mailweave.sources import mailcsv

TABLES = "/root/testdata/sf0.001"


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first().y


def test_header_runs(spark):
    assert one(spark, cleaning.drop_header_runs, "From: a\nTo: b\nCc: c\nSubject: d\ntext\nDate: x") == "From: a\nTo: b\ntext\nDate: x"
    assert one(spark, cleaning.drop_header_runs, None) == ""


def test_unwrap(spark):
    assert one(spark, cleaning.unwrap_lines, "A line\nbroken here.\nNew one\n\n> quoted\nlast") == "A line broken here.\nNew one\n\n> quoted\nlast"


def test_clean_body(spark):
    df = spark.createDataFrame([(1, "a &lt;b&gt; c\nmore\n\n\n\nend\n------------\nlegal"), (2, None), (3, "")], "row_idx long, body string")
    got = {r.row_idx: r.clean_body for r in cleaning.with_clean_body(df).collect()}
    assert got == {1: "a c more\n\nend", 2: "", 3: ""}


def test_packing(spark):
    text = "\n\n".join(["w " * 100, "w " * 100, "w " * 50, "w " * 500, "w"])
    packed = one(spark, chunks.packed_sections, text)
    assert [len(p.split()) for p in packed] == [200, 50, 500, 1]
    assert one(spark, chunks.packed_sections, None) == [""]


def test_headers(spark):
    message = "A: 1\nSubject: one\n two\nnot a header\na: 2\n\nbody: x"
    assert [tuple(r) for r in one(spark, mailcsv.headers, message)] == [("a", "1"), ("subject", "one two"), ("a", "2")]
    assert one(spark, lambda m: mailcsv.header(mailcsv.headers(m), "a"), message) == "2" and one(spark, lambda m: mailcsv.header(mailcsv.headers(m), "b"), message) is None
    assert one(spark, mailcsv.quoted_printable, "a=\nb =C3=A9 50% 1+1") == "ab é 50% 1+1"
    assert one(spark, mailcsv.iso_date, "Thu, 29 Mar 2001 21:05:09 -0600 (CST)") == "2001-03-29T21:05:09-06:00"
    assert one(spark, mailcsv.iso_date, "garbage") == "garbage"


def test_raw_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file,message\na/1,"Subject: x\n\nHe said ""hi"", twice"\n')
    row = mailcsv.structured(mailcsv.read_raw(spark, str(tmp_path / "m.csv"))).first()
    assert row.subject == "x" and row.body == 'He said "hi", twice' and row.recipients == []


def test_needs_rewrite(spark):
    for text, want in [("why did they decide that?", True), ("when was the mail about gas sent", False), ("gas price", True), ("who sent mail", False), ("", False), (None, False)]:
        assert one(spark, sessions.needs_rewrite, text) is want


def test_intents(spark):
    for text, want in [("who is involved", "people"), ("what was asked and when did", "timeline"), ("why", "why"), ("anything", "default"), ("a summary of the price", "value")]:
        assert one(spark, answers.intent, text) == want


def test_gaps(spark):
    rows = [(1, "Re: x", "2001-01-01", "a"), (2, "x", "2001-01-15", "b"), (3, "X ", "2001-01-29 00:00:01", "c"), (4, "fw: x", "2002-01-01", "c")]
    df = spark.createDataFrame(rows, "row_idx long, subject string, t string, sender string").withColumns({"recipients": F.array().cast("array<string>"), "cc": F.lit(None).cast("array<string>"), "at": F.col("t").cast("timestamp_ntz")})
    assert {r.row_idx: r.session for r in threads.gap_sessions(df, "at").collect()} == {1: 1, 2: 1, 3: 2, 4: 2}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.vertex: r.label for r in threads.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: find(v) for e in edges for v in e if e[0] != e[1] or v in got}
    assert threads.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_empty_slice(spark):
    rows = spark.createDataFrame([], "row_idx long, subject string, at timestamp_ntz, flagged boolean, size long")
    assert slicer.choose_window(rows).collect() == [] and slicer.month_stats(rows).collect() == []


def test_ranks_of_all_threads(spark):
    """Every subject has a rank, and a thread that fits is taken however late it stands."""
    sizes = [(f"big{i}", 30 if i else 29) for i in range(10)] + [(f"pair{i}", 2) for i in range(10_500)] + [("last", 1)]
    rows = spark.createDataFrame(sizes, "subject string, n int").select("subject", F.explode(F.sequence(F.lit(1), "n"))).select("subject", F.monotonically_increasing_id().alias("row_idx"))
    rows = rows.withColumns({"at": F.lit("2001-01-05").cast("timestamp_ntz"), "flagged": F.lit(False), "size": F.lit(1)})
    month = 2001 * 12
    window = spark.createDataFrame([(month, 1, month)], "start int, span int, last int")
    ranks = slicer.thread_ranks(rows, window)
    got = sorted((r["rank"], r.subject, r.messages) for r in ranks.collect())
    first = dict(rows.groupBy("subject").agg(F.min("row_idx")).collect())
    assert got == [(k, s, n) for k, (s, n) in enumerate(sorted(sizes, key=lambda x: (-x[1], first[x[0]])), 1)]
    assert {r.subject for r in slicer.select_threads(ranks).collect()} == {f"big{i}" for i in range(10)} | {"last"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_dates(spark):
    """As the standard library reads them, and wall times of ISO texts."""
    texts = ["Thu, 29 Mar 2001 21:05:09 -0600 (CST)", "Fri, 01 Aug 2003 13:24:08 -0000", "29 Mar 01 21:05 EST", "Fri Apr 11 09:39:26 CDT 2003", "Thu, 29 Mar 2001 21:05:09 GMT", "29 Mar 70 21:05:09", "2001-03-29T21:05:09.5+02:00", "31 Feb 2001 10:00:00", "soon", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(mailcsv.iso_date(F.col("t")).alias("iso"), mailcsv.header_time(F.col("t")).alias("at"), mailcsv.wall_time(F.col("t")).alias("wall"))
    for t, r in zip(texts, df.collect()):
        try:
            want = parsedate_to_datetime(t)
        except (TypeError, ValueError):
            want = None
        assert r.iso == (want.isoformat() if want else t or None) and r["at"] == (want and want.replace(tzinfo=None))
        assert r.wall == (datetime(2001, 3, 29, 21, 5, 9, 500000) if t and "T21" in t else r["at"])


def test_message_metadata(spark):
    rows = [(1, "Subject: Re: A  b\nDate: 1 Mar 2001 10:00:00 -0600\n\nsee FileName=x"), (2, "Subject : no\nDate: 1 Mar 2001 10:00\n\nx"), (3, "Subject: a\n \t\nDate: 1 Mar 2001 10:00\n\nx"), (4, "\nSubject: a\n\n"), (5, "Subject: a\r\nDate: never\r\n\r\né")]
    got = {r.row_idx: (r.subject, r["at"], r.flagged, r["size"]) for r in mailcsv.message_metadata(spark.createDataFrame(rows, "row_idx long, message string")).collect()}
    told = {1: ("a b", datetime(2001, 3, 1, 10), True), 2: (None, datetime(2001, 3, 1, 10), False), 3: ("a", None, False), 4: (None, None, False), 5: ("a", None, False)}
    assert got == {i: (*told[i], len(m.encode())) for i, m in rows}


def test_long_bodies_of_headers(spark):
    body = "\n".join(["Subject: x"] * 20_000)
    began = time.time()
    assert one(spark, cleaning.drop_header_runs, body) == "Subject: x\nSubject: x" and time.time() - began < 20


def test_slice(spark, tmp_path):
    """A window over the turn of a year, threads with attachments first, the caps, and the summary."""
    rows = [(i, f"t{i % 12}", f"{2000 + (i % 4 > 1)}-{[11, 12, 1, 2][i % 4]:02}-05", i % 12 < 3) for i in range(1, 145)]
    df = spark.createDataFrame(rows, "row_idx long, subject string, t string, flagged boolean").select("row_idx", "subject", F.col("t").cast("timestamp_ntz").alias("at"), "flagged", F.lit(10).alias("size"))
    window = slicer.choose_window(df)
    chosen = slicer.select_threads(slicer.thread_ranks(df, window))
    assert {r.subject for r in chosen.collect()} == {f"t{i}" for i in range(10)}
    part = slicer.slice_rows(df, window, chosen)
    made = slicer.slice_summary(part, window)
    r = made.first()
    assert (r.window_start, r.window_end, r.month_span, r.threads_selected, r.messages_selected, r.attachment_messages) == ("2000-11", "2001-02", 4, 10, 120, 36)
    assert [tuple(x) for x in r.thread_message_counts][:2] == [("t1", 12), ("t2", 12)]
    mailcsv.write_summary(made, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().messages_selected == 120


def test_gaps_over_ranges(spark):
    """One subject over many ranges, times missing, against a plain walk."""
    rng = random.Random(7)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", None if rng.random() < 0.02 else rng.randrange(4000), rng.choice("abcdefghij") + str(rng.randrange(40))) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_idx long, subject string, day int, sender string").withColumns({"recipients": F.array().cast("array<string>"), "cc": F.lit(None).cast("array<string>")})
    df = df.withColumn("at", F.expr("cast(date_add(date'2001-01-01', day) as timestamp_ntz)"))
    want = {}
    for subject in {r[1] for r in rows}:
        before, n = None, 0
        for r in sorted((r for r in rows if r[1] == subject), key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            if before is None or not (r[3] == before[3] or r[2] is None or before[2] is None or r[2] - before[2] <= 14):
                n += 1
            want[r[0]], before = n, r
    assert {r.row_idx: r.session for r in threads.gap_sessions(df, "at").collect()} == want


def test_ingest(spark):
    rows = [(1, "f/1", "Message-ID: <a>\nSubject: Hi\nFrom: x@y\nTo: \"B, C\" <b@y>\nDate: 1 Mar 2001 10:00:00 -0600\n\none &lt;b&gt; two"), (2, "f/2", "Message-ID: <b>\nSubject: other\nFrom: z@y\nReply-To: <a>\nDate: 1 Mar 2001 11:00:00 -0600\n\n<br>"), (3, "f/3", "Subject: third\nX-cc: q@y\nReferences: <zz>\n\n")]
    records, cut = chunks.ingested(spark.createDataFrame(rows, "row_idx long, file string, message string"))
    assert {r.row_idx: (r.thread_id, r.clean_body, r.normalized_subject, r.recipients, r.cc) for r in records.collect()} == {1: ("thread_0001", "one two", "hi", ['"B', 'C" <b@y>'], []), 2: ("thread_0001", "", "other", [], []), 3: ("thread_0002", "", "third", [], ["q@y"])}
    assert {r.doc_id: (r.thread_id, r.message_id, r.page_no, r.chunk_text) for r in cut.collect()} == {
        "email_0001_01": ("thread_0001", "<a>", None, 'Hi\nx@y\n"B C" <b@y>\none two'), "email_0002_01": ("thread_0001", "<b>", None, "other\nz@y\n<br>"), "email_0003_01": ("thread_0002", "row_3", None, "third\nq@y"),
    }


@pytest.mark.parametrize("name", ["bm25_topk_global", "trace_roundtrip", "clean_body", "structured_records", "rule_rewrite", "answer_turns", "bm25_topk_partition", "retrieval_cascade", "chunk_pack", "gap_sessions", "thread_components", "slice_cap", "people_answer", "history_last_n"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("ingest", "email_structure", "trace_turns", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    df = entry.queries()[name](spark, TABLES)
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(str(tuple(r)) for r in df.select(*cols).collect())
    assert got == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
