"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified by exact shingles.

A leak is a run of ``run_words`` consecutive words that a document shares with a test item. Documents and items are cut into
overlapping windows such that every run of that length lies whole in one window of each. Item windows are partitioned by
size; each partition has the number of one-row MinHash bands that finds a window sharing a run with probability 1 - miss,
whatever the sizes. Windows that collide in a band are candidates, verified on the words themselves.

Defined results: null and empty texts and texts of fewer than ``run_words`` words give no row; repeated documents give a row
each; repeated item ids count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.arrays import Words, chunks, mix, seeds

#: Words of a shingle for the MinHash signatures; the verification takes whole runs.
SHINGLE = 3


def _bands(size: int, window: int, run_words: int, miss: float) -> int:
    """Bands for item windows of at most ``size`` shingles: the Jaccard similarity of windows sharing a run is at least j."""
    shared = run_words - SHINGLE + 1
    j = shared / (size + window - shared)
    return math.ceil(math.log(miss) / math.log(1 - j)) if j < 1 else 1


def _windows(words: Words, run_words: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window: text, first word, one past the last word, distinct-free shingle count, and MinHash values (windows x bands)."""
    shingle, doc, first = words.shingles(SHINGLE)
    if not len(shingle):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, np.zeros((0, bands), np.uint64)
    place = first - words.bounds[doc]
    begins = np.flatnonzero((place % run_words == 0))
    block_doc = doc[begins]
    follows = np.append(block_doc[1:] == block_doc[:-1], False)
    size = np.diff(np.append(begins, len(shingle)))
    both = size + np.where(follows, np.append(size[1:], 0), 0)
    # a text's last block adds nothing to the window before it, unless it is the only one
    keep = follows | ~np.insert(follows[:-1], 0, False)
    values = np.empty((int(keep.sum()), bands), np.uint64)
    for b, (m, a) in enumerate(zip(seeds(bands, 8), seeds(bands, 9))):
        low = np.minimum.reduceat(mix(shingle * m + a), begins)
        values[:, b] = np.where(follows, np.minimum(low, np.append(low[1:], low[-1])), low)[keep]
    return block_doc[keep], first[begins][keep], first[begins][keep] + both[keep] + SHINGLE - 1, both[keep], values


def _item_index(run_words: int, miss: float):
    """Task: the band values of each item window (item_id, band, value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = Words(batch["text"].tolist())
            full = 2 * run_words
            most = _bands(full, full, run_words, miss)
            doc, _, _, size, values = _windows(words, run_words, most)
            # size partitions: quarters of the full window
            top = np.minimum(np.ceil(size / (full / 4)).astype(int) * (full // 4), full)
            need = np.array([_bands(int(t), full, run_words, miss) if t >= run_words - SHINGLE + 1 else most for t in top], dtype=int)
            w, b = np.nonzero(np.arange(most)[None, :] < need[:, None])
            yield pd.DataFrame({"item_id": batch["item_id"].to_numpy()[doc[w]], "band": b, "value": values[w, b].astype(np.int64)})

    return run


def _probe(index, run_words: int, miss: float, bits: int = 22):
    """Task: the document windows that collide with an item window in a band."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, band, value = index.value
        bands = _bands(2 * run_words, 2 * run_words, run_words, miss)
        key = mix(value.astype(np.uint64) + band.astype(np.uint64))
        order = np.argsort(key, kind="stable")
        key, items = key[order], items[order]
        maybe = np.zeros(1 << bits, dtype=bool)
        maybe[key >> np.uint64(64 - bits)] = True
        for batch in batches:
            texts = batch["text"].tolist()
            ids = batch["doc_id"].to_numpy()
            for part in chunks(texts):
                words = Words(texts[part])
                doc, start, end, _, values = _windows(words, run_words, bands)
                at = mix(values + np.arange(bands, dtype=np.uint64)[None, :])
                w, b = np.nonzero(maybe[at >> np.uint64(64 - bits)])
                probe = at[w, b]
                low, high = np.searchsorted(key, probe, "left"), np.searchsorted(key, probe, "right")
                count = high - low
                w = np.repeat(w, count)
                hit = items[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
                found = pd.DataFrame({"w": w, "item_id": hit}).drop_duplicates()
                w = found["w"].to_numpy()
                spans = [words.data[words.start[a] : words.end[min(z, len(words.end)) - 1]].decode("utf-8", "replace") for a, z in zip(start[w], end[w])]
                yield pd.DataFrame({"doc_id": ids[part][doc[w]], "item_id": found["item_id"].to_numpy(), "passage": pd.Series(spans, dtype=object)})

    return run


def _runs(text, n: int):
    """The distinct runs of n words of a text, each between blanks."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.concat(F.lit(" "), F.array_join(F.slice(words, i, n), " "), F.lit(" ")))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def leaked_items(documents: DataFrame, items: DataFrame, run_words: int = 12, miss: float = 1e-4, max_index_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): documents that hold at least ``run_words`` consecutive words of the item.

    The items' band values are broadcast where they are at most ``max_index_rows`` (24 bytes each); a larger test set is
    worked through in parts of that size, each against all documents.
    """
    spark = documents.sparkSession
    test = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    index = test.mapInPandas(_item_index(run_words, miss), "item_id long, band long, value long")
    rows = index.count()
    parts = max(1, -(-rows // max_index_rows))
    found = None
    for part in range(parts):
        own = index.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part) if parts > 1 else index
        local = own.toPandas()
        shared = spark.sparkContext.broadcast((local["item_id"].to_numpy(), local["band"].to_numpy(), local["value"].to_numpy()))
        hits = documents.select("doc_id", "text").mapInPandas(_probe(shared, run_words, miss), "doc_id long, item_id long, passage string")
        found = hits if found is None else found.unionByName(hits)
    item_runs = test.select(F.col("item_id"), _runs(F.col("text"), run_words).alias("item_runs"))
    # passages come lower-cased
    words = F.concat(F.lit(" "), F.regexp_replace("passage", "[^a-z0-9]+", " "), F.lit(" "))
    verified = found.withColumn("words", words).join(item_runs, "item_id").filter(F.exists("item_runs", lambda r: F.contains(F.col("words"), r)))
    return verified.select("doc_id", "item_id").distinct()
