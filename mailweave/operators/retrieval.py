"""Lexical retrieval: an inverted index of chunks and BM25 over batches of questions.

Statistics of terms are those of the whole corpus, also where a question is scoped to a thread; a word that a question repeats
counts as often. Scores are rounded to four digits; equal ones keep the order of the index. Of chunks with one message and one
leading text only the first that shares a word with the question is ranked.

Scores are summed inside tasks, see ``scoring``: what moves is each chunk once, as numbers of the words that are asked, and the
few best chunks of each question and task. Texts are joined to the chunks that are left.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailweave.functions.text import blank_to_null, strip, text_or_empty, tokens
from mailweave.operators import scoring
from mailweave.operators.scoring import B as B
from mailweave.operators.scoring import K1 as K1
from mailweave.sources.tables import checkpointed, sized_join

# tasks need not be able to import this package
cloudpickle.register_pickle_by_value(scoring)

SIGNATURE, PREVIEW, TOP_K = 180, 280, 5


@dataclass(frozen=True)
class Index:
    """The chunks and the index over them.

    ``docs`` (doc_id, thread_id, row_idx, grp, dl, words): grp is that of message and leading text, words are those of the chunk
    as often as they stand there. ``terms`` (term, df, idf). ``corpus``: one row (docs, avg_length).
    """

    chunks: DataFrame
    docs: DataFrame
    terms: DataFrame
    corpus: DataFrame


def signature(text: str = "chunk_text") -> Column:
    return F.lower(strip(F.substring(text_or_empty(F.col(text)), 1, SIGNATURE)))


def _docs(chunks: DataFrame, text: str) -> DataFrame:
    cut = chunks.select("doc_id", "thread_id", F.col("row_idx").cast("long").alias("row_idx"), F.xxhash64("message_id", signature(text)).alias("grp"), tokens(F.col(text)).alias("words"))
    return cut.select("doc_id", "thread_id", "row_idx", "grp", F.size("words").alias("dl"), "words")


def _corpus(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_length"))


def _terms(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    counted = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counted.join(F.broadcast(corpus)).select("term", "df", idf.alias("idf"))  # one row of corpus statistics


def build_index(chunks: DataFrame, text: str = "chunk_text") -> Index:
    """The index as plans over the chunks, for a corpus that is searched once; ``store_index`` keeps it."""
    docs = _docs(chunks, text)
    corpus = _corpus(docs)
    return Index(chunks, docs, _terms(docs, corpus), corpus)


def store_index(chunks: DataFrame, path: str, text: str = "chunk_text") -> Index:
    """The index written under ``path``, each part from the one before it, and read back."""
    spark = chunks.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    docs = kept(_docs(chunks, text), "docs")
    corpus = kept(_corpus(docs), "corpus")
    return Index(chunks, docs, kept(_terms(docs, corpus), "terms"), corpus)


def open_index(spark: SparkSession, chunks: DataFrame, path: str) -> Index:
    """An index stored before over the same chunks."""
    return Index(chunks, *[spark.read.parquet(f"{path}/{name}") for name in ("docs", "terms", "corpus")])


def _scored(index: Index, questions: DataFrame, scoped: bool, score: Callable, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(q, ...) as ``score`` gives them over blocks of chunks, and the questions (q, query_id): those of one scope that ask the same words share a number."""
    spark = questions.sparkSession
    scope = F.col("thread_id").cast("string") if scoped else F.lit("")
    asked = questions.select("query_id", scope.alias("scope"), F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("key")).filter("scope is not null and key <> ''")
    asked = checkpointed(asked)
    numbered = checkpointed(asked.select("scope", "key").distinct().withColumn("q", F.monotonically_increasing_id()))
    terms = index.terms.join(numbered.select(F.explode(F.split("key", " ")).alias("term")).distinct(), "term").select("term", "idf")
    # the distinct questions go to every task
    known = spark.sparkContext.broadcast(scoring.Asked(numbered.select("q", "scope", "key").toArrow(), terms.toArrow(), index.corpus.first()["avg_length"]).__dict__)
    docs = index.docs.select("doc_id", (F.col("thread_id").cast("string") if scoped else scope).alias("scope"), "row_idx", "grp", "dl", "words")
    if scoped:
        docs = sized_join(docs, numbered.select("scope").distinct(), "scope", "left_semi").select(docs.columns)
    kind = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    packed = docs.mapInArrow(scoring.packed(known), ", ".join(f"{c} {kind[c]}" for c in docs.columns[:-1]) + ", ids binary, times binary")
    # groups lie whole in a task
    blocks = packed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scope", "grp").sortWithinPartitions("scope", "grp", "row_idx", "doc_id")
    kind |= {"q": "long", "score": "double"}
    return blocks.mapInArrow(score(known), ", ".join(f"{c} {kind[c]}" for c in columns)), asked.join(numbered, ["scope", "key"]).select("q", "query_id")


def scores(index: Index, questions: DataFrame, scoped: bool) -> DataFrame:
    """(query_id, doc_id, row_idx, grp, score) of all chunks that share a word with the question (query_id, thread_id, text)."""
    found, owners = _scored(index, questions, scoped, scoring.every, ["q", "doc_id", "row_idx", "grp", "score"])
    return sized_join(found, owners, "q").select("query_id", "doc_id", "row_idx", "grp", "score")


def ranked(index: Index, questions: DataFrame, scoped: bool = True, top_k: int = TOP_K) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``top_k`` chunks of each question."""
    found, owners = _scored(index, questions, scoped, lambda known: scoring.best(known, top_k), ["q", "doc_id", "row_idx", "score"])
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "row_idx", "doc_id"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= top_k)
    return best.join(owners, "q").select("query_id", "doc_id", "score", "rank")


def with_chunks(index: Index, hits: DataFrame) -> DataFrame:
    """Ranked hits with the columns of their chunks and the preview; the hits go to the chunks where they are few, so that texts stay where they are."""
    return sized_join(index.chunks, hits, "doc_id").withColumn("text_preview", F.substring(text_or_empty(F.col("chunk_text")), 1, PREVIEW))


def search(index: Index, questions: DataFrame, scoped: bool = True, top_k: int = TOP_K) -> DataFrame:
    """The ``top_k`` chunks of each question with rank, score and preview; near copies are dropped before ranking."""
    return with_chunks(index, ranked(index, questions, scoped, top_k))


def first_per_signature(chunks: DataFrame) -> DataFrame:
    """(doc_id): the first chunk in index order of each message and leading text."""
    return chunks.groupBy("message_id", signature().alias("signature")).agg(F.min(F.struct("row_idx", "doc_id")).alias("f")).select("f.doc_id")


def listed(chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(thread_id, doc_id, rank): the first chunks of each thread, one per message, in the order of date, message and chunk as texts."""
    order = F.struct(F.coalesce("date_text", F.lit("")).alias("d"), F.coalesce("message_id", F.lit("")).alias("m"), "doc_id")
    one = chunks.groupBy("thread_id", "message_id").agg(F.min(order).alias("o"))
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("o"))
    return one.withColumn("rank", place).filter(F.col("rank") <= top_k).select("thread_id", "o.doc_id", "rank")


def listing(chunks: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """``listed`` with the columns of the chunks, score 0 and preview."""
    found = listed(chunks, top_k).select("doc_id", "rank").join(chunks, "doc_id")
    return found.withColumn("score", F.lit(0.0)).withColumn("text_preview", F.substring(text_or_empty(F.col("chunk_text")), 1, PREVIEW))


def cascade(index: Index, questions: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """(query_id, doc_id, score, rank, tier): thread search, else the thread's listing, else, where the question has search_outside_thread, search over all; ``tier`` 1 to 3 tells which.

    Questions without the column search_outside_thread may all search outside.
    """
    cols = ["query_id", "doc_id", "score", "rank", "tier"]
    near = checkpointed(ranked(index, questions, True, top_k).withColumn("tier", F.lit(1)).select(*cols))
    rest = checkpointed(questions.join(near.select("query_id").distinct(), "query_id", "left_anti"))
    listing_of = rest.select("query_id", "thread_id").join(listed(index.chunks, top_k), "thread_id").select("query_id", "doc_id", F.lit(0.0).alias("score"), "rank", F.lit(2).alias("tier"))
    listing_of = checkpointed(listing_of)
    last = rest.join(listing_of.select("query_id").distinct(), "query_id", "left_anti")
    if "search_outside_thread" in last.columns:
        last = last.filter("search_outside_thread")
    wide = ranked(index, last, False, top_k).withColumn("tier", F.lit(3)).select(*cols)
    return near.unionByName(listing_of).unionByName(wide)


def slim() -> Column:
    """The ten fields of a retrieved chunk that traces and answers keep."""
    return F.struct("doc_id", "thread_id", "message_id", F.col("page_no").cast("int").alias("page_no"), F.col("filename").cast("string").alias("filename"), "chunk_type", F.col("score").cast("double").alias("score"), "subject", "date_text", F.coalesce("text_preview", F.substring(text_or_empty(F.col("chunk_text")), 1, PREVIEW)).alias("text_preview"))


def thread_counts(chunks: DataFrame) -> DataFrame:
    """Chunks and messages of each thread; threads without an id are left out."""
    return chunks.filter(blank_to_null(F.col("thread_id")).isNotNull()).groupBy("thread_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("row_idx").alias("message_count"))
