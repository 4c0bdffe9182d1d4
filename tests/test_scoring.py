"""Searches move chunks and the best of each task, never a row for each pair of question and chunk."""

import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest

import __spark_entry__ as entry

from mailweave.operators import answers, retrieval, scoring
from test_conversation import chunks, plain_search

MANY = [{"chunk_text": f"the price of gas and power at hub {i % 37} rose by {i}", "message_id": f"<{i // 3 if i % 5 == 0 else i}>"} for i in range(400)]
ASKED = [f"the price of gas and power at hub {i} rose by {i * 7}" for i in range(60)]
#: A row for each pair of question and chunk; the searches have fewer by far.
PAIRS = len(MANY) * len(ASKED)


def stages(spark):
    sc = spark.sparkContext
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return [found.apply(i) for i in range(found.size())]


def moved(spark, run):
    """What run() gives, and the rows that its stages wrote for others."""
    before = {s.stageId() for s in stages(spark)}
    out = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return out, sum(s.shuffleWriteRecords() for s in stages(spark) if s.stageId() not in before)


def asked(spark, texts, thread):
    return spark.createDataFrame([(str(i), thread, t) for i, t in enumerate(texts)], "query_id string, thread_id string, text string")


def found(rows):
    got = {}
    for r in rows:
        got.setdefault(int(r.query_id), {})[r["rank"]] = (r.doc_id, r.score)
    return {q: [x[k] for k in sorted(x)] for q, x in got.items()}


def test_global_moves_no_pairs(spark, tmp_path):
    index = retrieval.store_index(chunks(spark, MANY), str(tmp_path / "i"))
    got, rows = moved(spark, lambda: retrieval.ranked(index, asked(spark, ASKED, None), scoped=False).collect())
    assert found(got) == {q: plain_search(MANY, t) for q, t in enumerate(ASKED)}
    assert rows < PAIRS / 4


@pytest.mark.parametrize("block", [3, 20, 40_000])
def test_blocks_prune_exactly(monkeypatch, block):
    """Blocks of any size give the same: copies lie in one block, and bounds from earlier blocks lose nothing."""
    monkeypatch.setattr(scoring, "BLOCK", block)
    rng = random.Random(block)
    rows = [{"message_id": f"m{rng.randrange(200)}", "chunk_text": " ".join(rng.choices([f"w{i}" for i in range(50)], [1 / (k + 1) for k in range(50)], k=rng.randrange(3, 40)))} for _ in range(300)]
    rows += [{**r, "chunk_text": (r["chunk_text"] + " pad" * 60)[:190] + f" w{i % 50}"} for i, r in enumerate(rows[:60])]
    rows += [{**r, "chunk_text": r["chunk_text"] + f" w{i % 7} w40"} for i, r in enumerate(rows[300:])]
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    split = [re.findall(r"\w+", r["chunk_text"]) for r in rows]
    df = Counter(w for t in split for w in set(t))
    terms = pa.table({"term": list(df), "idf": [math.log(1 + (len(rows) - n + 0.5) / (n + 0.5)) for n in df.values()]})
    questions = pa.table({"q": range(len(texts)), "scope": [""] * len(texts), "key": texts})
    known = SimpleNamespace(value=scoring.Asked(questions, terms, sum(map(len, split)) / len(rows)))
    table = pa.table({"doc_id": [f"d{i:03}" for i in range(1, len(rows) + 1)], "scope": [""] * len(rows), "row_idx": range(1, len(rows) + 1), "grp": [hash((r["message_id"], r["chunk_text"][:180])) for r in rows], "dl": list(map(len, split)), "words": split})
    done = pa.Table.from_batches(scoring.packed(known)(table.to_batches(max_chunksize=50)))
    done = done.sort_by([(c, "ascending") for c in ("scope", "grp", "row_idx", "doc_id")])
    got = {}
    for b in scoring.best(known, 5)(done.to_batches(max_chunksize=4)):
        for r in b.to_pylist():
            got.setdefault(r["q"], []).append((r["doc_id"], r["score"]))
    assert got == {q: want for q, t in enumerate(texts) if (want := plain_search(rows, t))}
    pairs = [x for b in scoring.every(known)(done.to_batches(max_chunksize=4)) for x in b.to_pylist()]
    assert len(pairs) == sum(bool(set(t.split()) & set(s)) for t in texts for s in split)


def test_cascade_moves_no_pairs(spark, tmp_path):
    """In one thread, and over all for questions of other threads."""
    index = retrieval.store_index(chunks(spark, MANY), str(tmp_path / "i"))
    for thread, tier in (("t", 1), ("elsewhere", 3)):
        got, rows = moved(spark, lambda: retrieval.cascade(index, asked(spark, ASKED, thread)).collect())
        assert {r.tier for r in got} == {tier} and found(got) == {q: plain_search(MANY, t) for q, t in enumerate(ASKED)}
        assert rows < PAIRS / 4


def test_thread_search_moves_no_pairs(spark, tmp_path):
    index = retrieval.store_index(chunks(spark, MANY), str(tmp_path / "i"))
    got, rows = moved(spark, lambda: retrieval.ranked(index, asked(spark, ASKED, "t")).collect())
    assert found(got) == {q: plain_search(MANY, t) for q, t in enumerate(ASKED)}
    assert rows < PAIRS / 4


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A thread of all the chunks, asked once by each of many turns."""
    folder = str(tmp_path_factory.mktemp("tables"))
    chunks(spark, MANY).write.parquet(f"{folder}/ingest.parquet")
    turns = [(f"{i}", "s", "t", text, "", "", None, 1.0, False) for i, text in enumerate(ASKED)]
    schema = "trace_id string, session_id string, thread_id string, user_text string, rewrite string, answer string, citations array<struct<cite_type:string,message_id:string,page_no:int>>, latency_ms double, search_outside_thread boolean"
    spark.createDataFrame(turns, schema).selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as logged_at").write.parquet(f"{folder}/trace_turns.parquet")
    return folder


def test_trace_moves_no_pairs(spark, tables):
    got, rows = moved(spark, lambda: entry.queries()["trace_roundtrip"](spark, tables).collect())
    assert {int(r.trace_id): [x.rsplit("/", 1)[0] for x in r.retrieved.split()] for r in got} == {q: [f"{d}/{s}" for d, s in plain_search(MANY, t)] for q, t in enumerate(ASKED)}
    assert rows < PAIRS / 4


def test_answers_move_no_pairs(spark, tables):
    got, rows = moved(spark, lambda: entry.queries()["answer_turns"](spark, tables).collect())
    assert sorted(int(r.query_id) for r in got) == list(range(len(ASKED)))
    assert rows < PAIRS / 4


def test_items_move_no_pairs(spark, tables):
    got, rows = moved(spark, lambda: entry.queries()["retrieved_items"](spark, tables).collect())
    assert found(got) == {q: plain_search(MANY, t) for q, t in enumerate(ASKED)}
    assert {r.text_preview for r in got} <= {r["chunk_text"] for r in MANY}
    assert rows < PAIRS / 4


def steps(plan):
    """The nodes of a plan that ran."""
    yield plan
    kind = plan.getClass().getSimpleName()
    below = plan.children()
    inner = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
    for p in inner:
        yield from steps(p)


def test_scores_are_summed_in_place(spark, tables):
    """Every chunk shares words with every question: all scores come out, and no step has more rows than that, as one for each shared word."""
    df = entry.queries()["bm25_repeated_terms"](spark, tables)
    got = df.collect()
    assert len({(r.query_id, r.doc_id) for r in got}) == len(got) == PAIRS
    best = {q: max(r.score for r in got if r.query_id == str(q)) for q in range(0, len(ASKED), 9)}
    assert best == {q: plain_search(MANY, ASKED[q])[0][1] for q in best}
    rows = [m.get().value() for p in steps(df._jdf.queryExecution().executedPlan()) if (m := p.metrics().get("numOutputRows")).isDefined()]
    assert rows and max(rows) <= PAIRS


def test_items_of_answers_move_once(spark):
    """Their texts are shuffled to their question once, not again for each window."""
    rows = [(str(q), k, "s", f"text {k % 4}") for q in range(40) for k in range(1, 6)]
    items = spark.createDataFrame(rows, "query_id string, rank int, subject string, text_preview string")
    got, moves = moved(spark, lambda: answers.distinct_items(items).collect())
    assert sorted((int(r.query_id), r.place, r["rank"]) for r in got) == [(q, k, k) for q in range(40) for k in range(1, 5)]
    assert moves <= len(rows)
