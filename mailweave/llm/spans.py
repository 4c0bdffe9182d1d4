"""Long exact spans shared between records: super-k-mer partitioning.

Each text is cut into maximal runs of consecutive windows of ``width`` characters that have the same minimiser (the least
hash of their m-grams). Runs whose minimiser occurs in one text only are dropped before any text is read again; the others are
cut out as one packed string each, whose windows are hashed to 128 bits beside the text and counted exactly. Windows found in
the same set of texts are represented by one of them, whose texts are paired.

Defined results: texts that are null or shorter than ``width`` share nothing; equal texts are worked on once and expanded at
the end; an empty table gives no rows; other columns are ignored; document ids are taken as unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.llm.arrays import chunks, mix, sliding_min, span_hashes
from mailweave.sources.tables import checkpointed, sized_join


def _super_kmers(width: int, m: int):
    """Task: (doc_id, start, windows, minimiser) of each maximal run of windows with one minimiser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            ids = batch["doc_id"].to_numpy()
            for part in chunks(texts):
                own = texts[part]
                units = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                length = np.fromiter((len(t) for t in own), np.int64, len(own))
                first = np.cumsum(length) - length
                n = len(units)
                if n < width:
                    continue
                at = np.arange(n - m + 1)
                least = sliding_min(span_hashes(units, at, at + m), width - m + 1)
                doc = np.repeat(np.arange(len(own)), length)[: len(least)]
                place = np.arange(len(least)) - first[doc]
                whole = place + width <= length[doc]
                turn = np.empty(len(least), dtype=bool)
                turn[0] = True
                turn[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] & ~whole[:-1])
                begins = np.flatnonzero(turn & whole)
                ends = np.append(np.flatnonzero(turn), len(least))
                ends = ends[np.searchsorted(ends, begins, side="right")]
                ends = np.minimum(ends, first[doc[begins]] + length[doc[begins]] - width + 1)
                yield pd.DataFrame({"doc_id": ids[part][doc[begins]], "start": place[begins].astype(np.int32), "windows": (ends - begins).astype(np.int32), "minimiser": least[begins].astype(np.int64)})

    return run


def _window_digests(width: int):
    """Task: (doc_id, digest, second) of each window of each packed run, and its start where the runs have theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["packed"].tolist()
            ids = batch["doc_id"].to_numpy()
            for part in chunks(texts):
                own = texts[part]
                units = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                length = np.fromiter((len(t) for t in own), np.int64, len(own))
                each = length - width + 1
                first = np.cumsum(length) - length
                at = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(each.sum())
                digest = span_hashes(units, at, at + width)
                second = span_hashes(mix(units.astype(np.uint64) + np.uint64(5)) >> np.uint64(1), at, at + width)
                out = {"doc_id": np.repeat(ids[part], each), "digest": digest.astype(np.int64), "second": second.astype(np.int64)}
                if "start" in batch:
                    out["start"] = (np.repeat(batch["start"].to_numpy()[part] - (np.cumsum(each) - each), each) + np.arange(each.sum())).astype(np.int32)
                yield pd.DataFrame(out)

    return run


def _representatives(documents: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """One document of each distinct text of at least ``width`` characters, and (doc_id, rep) of them all."""
    long = documents.filter(F.length("text") >= width)
    keyed = long.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    least = keyed.groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = keyed.join(least.filter("copies > 1").select("digest", "n", "rep"), ["digest", "n"]).select("doc_id", "rep")
    return long, copies


def span_pairs(documents: DataFrame, width: int = 200, m: int = 100) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: pairs of documents with at least ``width`` consecutive characters in common."""
    between, copies, _ = _pairs_of_texts(documents, width, m)
    return _of_documents(between, copies)


def shared(documents: DataFrame, width: int = 200, m: int = 100) -> DataFrame:
    """(doc_id, shared_chars, share, partners) of every document: how many of its characters lie in a span of at least ``width`` that another document holds too, and the documents that hold one."""
    between, copies, covered = _pairs_of_texts(documents, width, m, places=True)
    pairs = checkpointed(_of_documents(between, copies))
    both = pairs.select(F.col("doc_id_a").alias("doc_id"), F.col("doc_id_b").alias("other")).unionByName(pairs.select(F.col("doc_id_b").alias("doc_id"), F.col("doc_id_a").alias("other")))
    partners = both.groupBy("doc_id").agg(F.array_sort(F.collect_list("other")).alias("partners"))  # the result
    whole = copies.select("doc_id", F.lit(True).alias("whole"))
    joined = documents.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).join(covered, "doc_id", "left").join(whole, "doc_id", "left").join(partners, "doc_id", "left")
    chars = F.when(F.col("whole"), F.col("n").cast("long")).otherwise(F.coalesce("chars", F.lit(0).cast("long")))
    share = F.when(F.col("n") > 0, chars / F.col("n")).otherwise(0.0)
    return joined.select("doc_id", chars.alias("shared_chars"), share.alias("share"), F.coalesce("partners", F.array().cast("array<long>")).alias("partners"))


def _of_documents(between: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs of documents of the pairs of their texts."""
    group = copies.select("rep", F.col("doc_id").alias("member"))
    # a text stands for its copies: those of a, those of b, and the copies among themselves
    of_a, of_b = group.select(F.col("rep").alias("a"), F.col("member").alias("ma")), group.select(F.col("rep").alias("b"), F.col("member").alias("mb"))
    spread = between.join(of_a, "a", "left").join(of_b, "b", "left")
    x, y = F.coalesce("ma", "a"), F.coalesce("mb", "b")
    crossed = spread.select(F.least(x, y).alias("doc_id_a"), F.greatest(x, y).alias("doc_id_b"))
    inside = group.select("rep", F.col("member").alias("doc_id_a")).join(group.select("rep", F.col("member").alias("doc_id_b")), "rep").filter("doc_id_a < doc_id_b")
    return crossed.unionByName(inside.select("doc_id_a", "doc_id_b"))


def _pairs_of_texts(documents: DataFrame, width: int, m: int, places: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Pairs (a, b) of representatives that share a window, (doc_id, rep) of equal texts and, with ``places``, (doc_id, chars): how many characters of a representative the windows shared with others cover."""
    long, copies = _representatives(documents, width)
    copies = checkpointed(copies)
    texts = sized_join(long.select("doc_id", "text"), copies.filter("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    # kept on the executors' disks for two readings; what a lost executor held is made again
    kmers = texts.mapInPandas(_super_kmers(width, m), "doc_id long, start int, windows int, minimiser long").persist(StorageLevel.DISK_ONLY)
    common = kmers.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("minimiser")
    kept = sized_join(kmers, common, "minimiser", "left_semi").select("doc_id", "start", "windows")
    packed = sized_join(documents.select("doc_id", "text"), kept, "doc_id").select("doc_id", *["start"] * places, F.substring("text", F.col("start") + 1, F.col("windows") + (width - 1)).alias("packed"))
    # 128 bits tell windows apart
    placed = packed.mapInPandas(_window_digests(width), "doc_id long, digest long, second long" + ", start int" * places)
    windows = placed.select("doc_id", "digest", "second")
    counted = windows.repartition("digest").distinct().groupBy("digest", "second").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.xxhash64("doc_id").cast("decimal(20,0)")).alias("who")).filter("texts > 1")
    counted = checkpointed(counted) if places else counted
    # windows held by the same set of texts, told by its size and a sum over its members: one stands for all
    chosen = counted.groupBy("texts", "who").agg(F.min(F.struct("digest", "second")).alias("w")).select("w.digest", "w.second")
    held = checkpointed(sized_join(windows, chosen, ["digest", "second"], "left_semi").distinct())
    covered = None
    if places:
        mine = sized_join(placed, counted.select("digest", "second"), ["digest", "second"], "left_semi")
        after = F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")) - F.col("start")  # of one document
        covered = checkpointed(mine.select("doc_id", F.least(F.coalesce(after, F.lit(width)), F.lit(width)).alias("own")).groupBy("doc_id").agg(F.sum("own").alias("chars")))
    kmers.unpersist()
    left, right = held.withColumnRenamed("doc_id", "a"), held.withColumnRenamed("doc_id", "b")
    return left.join(right, ["digest", "second"]).filter("a < b").select("a", "b").distinct(), copies, covered
