"""Near-duplicate records with small edits: covering locality-sensitive hashing over MinHash words.

Each record's set of word shingles is sketched as ``groups`` 64-bit words of seven 9-bit MinHash fields. The seven fields are
the points of the projective plane of order two; for each of its seven lines there is one bit mask that ignores the line's
three fields and keeps the other four. Any two differing fields lie on a line, so two words that differ in at most two fields
agree under some mask: every pair of records that differs in fewer than ``3 * groups`` fields collides in some table. Beyond
that radius collisions are likely, not certain. Of colliding pairs only those are set aside that can't reach the similarity:
by their sizes, and by bit maps of the shingles' hashes, as each bit that one text has and the other lacks is a shingle they
don't share. All others are verified by the Jaccard similarity of the whole shingle sets; in a pair of texts shingles are told apart by 32 bits, which takes two different
ones for equal once in a hundred thousand pairs and so can only matter for a pair that misses the threshold by one shingle.

Records with equal shingle sets are sketched once. ``similar_groups`` gives every record its group; ``similar_pairs`` writes
out the pairs between copies and their partners as well.

Defined results: null texts count as empty; records of fewer than ``least`` distinct shingles have no partner; an empty table
gives no rows; other columns are ignored; row ids are taken as unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.arrays import Words, chunks, mix, seeds
from mailweave.llm.components import components
from mailweave.sources.tables import checkpointed, sized_join

FIELDS, BITS = 7, 9
#: The lines of the projective plane of order two, by point.
LINES = [(0, 1, 2), (0, 3, 4), (0, 5, 6), (1, 3, 5), (1, 4, 6), (2, 3, 6), (2, 4, 5)]
#: Longs of a text's bit map.
MAP = 8
#: Per line the mask that keeps the fields off the line.
MASKS = [sum(((1 << BITS) - 1) << (BITS * f) for f in range(FIELDS) if f not in line) for line in LINES]


def _sketches(width: int, groups: int, least: int):
    """Task: (id, size, set_a, set_b, words, bits) of each text with at least ``least`` distinct shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = FIELDS * groups
        m, a = seeds(n, 3), seeds(n, 4)
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"].to_numpy()
            for part in chunks(texts):
                words = Words(texts[part])
                shingle, doc, _ = words.shingles(width)
                if not len(shingle):
                    continue
                # the distinct shingles of each text
                order = np.lexsort((shingle, doc))
                shingle, doc = shingle[order], doc[order]
                new = np.append(True, (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1]))
                shingle, doc = shingle[new], doc[new]
                begins = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                size = np.diff(np.append(begins, len(shingle)))
                fields = np.empty((len(begins), n), np.uint64)
                for k in range(n):
                    # the least hash, brought to its field's bits
                    fields[:, k] = mix(np.minimum.reduceat(mix(shingle * m[k] + a[k]), begins)) & np.uint64((1 << BITS) - 1)
                shifts = np.uint64(BITS) * np.arange(FIELDS, dtype=np.uint64)
                sketch = (fields.reshape(-1, groups, FIELDS) << shifts).sum(axis=2, dtype=np.uint64).astype(np.int64)
                set_a = np.add.reduceat(shingle, begins).astype(np.int64)
                set_b = np.add.reduceat(mix(shingle + np.uint64(77)), begins).astype(np.int64)
                held = np.zeros((len(begins), MAP * 64), dtype=bool)
                held[np.repeat(np.arange(len(begins)), size), (mix(shingle + np.uint64(99)) % np.uint64(MAP * 64)).astype(np.int64)] = True
                bits = np.packbits(held, axis=1, bitorder="little").view(np.int64)
                keep = size >= least
                if not keep.any():
                    continue
                yield pd.DataFrame({"id": ids[part][doc[begins]][keep], "size": size[keep].astype(np.int32), "set_a": set_a[keep], "set_b": set_b[keep], "words": list(sketch[keep]), "bits": list(bits[keep])})

    return run


def _shingle_sets(width: int):
    """Task: (id, set) of distinct shingles, told apart within a pair by 32 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = batch["text"].tolist(), batch["id"].to_numpy()
            for part in chunks(texts):
                shingle, doc, _ = Words(texts[part]).shingles(width)
                bounds = np.searchsorted(doc, np.arange(part.stop - part.start + 1))
                sets = [np.unique((shingle[x:y] >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x, y in zip(bounds[:-1], bounds[1:])]
                yield pd.DataFrame({"id": ids[part], "set": sets})

    return run


def representative_pairs(texts: DataFrame, similarity: float = 0.6, width: int = 3, least: int = 20, groups: int = 9) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a < b, of representatives whose shingle sets reach ``similarity``, and (id, rep) of the records that have copies."""
    sketched = texts.select("id", "text").mapInPandas(_sketches(width, groups, least), "id long, size int, set_a long, set_b long, words array<long>, bits array<long>")
    sketched = checkpointed(sketched)
    sets = sketched.groupBy("set_a", "set_b", "size").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = checkpointed(sketched.join(sets.filter("copies > 1").drop("copies"), ["set_a", "set_b", "size"]).select("id", "rep"))
    single = sized_join(sketched, copies.filter("id <> rep").select("id"), "id", "left_anti")

    masks = F.array(*[F.lit(x) for x in MASKS])
    keyed = F.transform(F.col("words"), lambda w, g: F.transform(masks, lambda k, t: F.xxhash64(w.bitwiseAND(k), g * len(MASKS) + t)))
    tables = single.select("id", F.explode(F.flatten(keyed)).alias("key"))
    collided = tables.withColumnRenamed("id", "a").join(tables.withColumnRenamed("id", "b"), "key").filter("a < b").select("a", "b").distinct()
    mapped = lambda key, n, bits: single.select(F.col("id").alias(key), F.col("size").alias(n), F.col("bits").alias(bits))
    sized = collided.join(mapped("a", "n", "x"), "a").join(mapped("b", "m", "y"), "b")
    lacking = lambda x, y: sum((F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(MAP)), F.lit(0))
    most = F.least(F.col("n") - lacking(F.col("x"), F.col("y")), F.col("m") - lacking(F.col("y"), F.col("x")))
    near = most >= similarity * (F.col("n") + F.col("m") - most)
    likely = checkpointed(sized.filter(near).select("a", "b"))
    # whole sets of the texts that are still in question only
    asked = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct()
    exact = checkpointed(sized_join(texts.select("id", "text"), asked, "id", "left_semi").mapInPandas(_shingle_sets(width), "id long, set array<int>"))
    both = likely.join(exact.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(exact.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"), copies


def similar_pairs(texts: DataFrame, **settings) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of ``texts`` (id long, text string) whose shingle sets reach the similarity."""
    pairs, copies = representative_pairs(texts, **settings)
    of_a, of_b = copies.select(F.col("rep").alias("a"), F.col("id").alias("ca")), copies.select(F.col("rep").alias("b"), F.col("id").alias("cb"))
    spread = pairs.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    crossed = spread.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    inside = copies.select("rep", F.col("id").alias("id_a")).join(copies.select("rep", F.col("id").alias("id_b")), "rep").filter("id_a < id_b").select("id_a", "id_b")
    return crossed.unionByName(inside)


def similar_groups(texts: DataFrame, **settings) -> DataFrame:
    """(id, group): the records of ``texts`` that have a similar one, and the least id of all that are tied to it, directly or through others."""
    pairs, copies = representative_pairs(texts, **settings)
    ties = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(copies.filter("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v")))
    return components(ties).select(F.col("vertex").alias("id"), F.col("label").alias("group"))


def _texts(mail: DataFrame) -> DataFrame:
    blank = F.lit("")
    return mail.select(F.col("row_idx").alias("id"), F.concat_ws(" ", F.coalesce("subject", blank), F.coalesce("body", blank)).alias("text"))


def similar_mail(mail: DataFrame, **settings) -> DataFrame:
    """(row_idx_a, row_idx_b): pairs of rows alike in subject and body."""
    return similar_pairs(_texts(mail), **settings).select(F.col("id_a").alias("row_idx_a"), F.col("id_b").alias("row_idx_b"))


def grouped_mail(mail: DataFrame, **settings) -> DataFrame:
    """(row_idx, group_row): the rows alike to others and the least row of each group."""
    return similar_groups(_texts(mail), **settings).select(F.col("id").alias("row_idx"), F.col("group").alias("group_row"))
