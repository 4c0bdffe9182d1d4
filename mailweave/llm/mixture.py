"""Mixing sources to target weights: systematic sampling over prefix sums of expected copies.

Sizes are tokens of a public tokenizer. Equal texts are one text, whatever their documents and sources. Each source gets a
number of expected copies per text, the same for all its texts, such that its tokens reach its share of the total, and at most
its ``max_repeats``. Within a source the expected copies are prefix-summed, one random offset is added, and a text is written
once for every whole number its interval crosses, so that no text is written more than ceil(expected) times.

The prefix sums run in two levels: sums of blocks of like-sized texts, salted by hash, first, then the order within a block, so
that a source that holds a third of all texts isn't one task.

Defined results: null and empty texts have no tokens and are never written; documents of sources without a target are left
out; targets without documents are reported with no tokens; an empty table gives the targets with nothing; other columns are
ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed

TOKENIZER = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[str, object] = {}


def _counts(path: str):
    """Task: (doc_id, tokens)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        if path not in _encoders:
            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            _encoders[path] = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encoder = _encoders[path]
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "tokens": [len(encoder.encode_ordinary(t)) for t in batch["text"]]})

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of the texts that aren't empty."""
    return documents.filter("length(text) > 0").select("doc_id", "text").mapInPandas(_counts(tokenizer), "doc_id long, tokens long")


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, tokens, copies) of the texts written, and the report by source.

    Without ``total_tokens`` the total is the largest at which every source that has documents reaches its share, shares
    being relative to those of all sources that have documents. A larger total leaves capped sources short, which the report
    shows.
    """
    aimed = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    held = documents.join(aimed.select("source"), "source", "left_semi").filter("length(text) > 0")
    # one document stands for all of a text: the least id
    digest = held.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n"))
    alone = digest.groupBy("digest", "n").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    sizes = checkpointed(token_counts(held.join(alone, "doc_id", "left_semi"), tokenizer).join(held.select("doc_id", "source"), "doc_id").filter("tokens > 0"))
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count(F.lit(1)).alias("texts"))
    plan = aimed.join(own, "source", "left")  # a row per source
    with_text = plan.filter("own_tokens > 0")
    shares = with_text.agg(F.sum("target_share").alias("all_shares"))
    feasible = with_text.join(F.broadcast(shares)).agg(F.min(F.col("max_repeats") * F.col("own_tokens") * F.col("all_shares") / F.col("target_share")).alias("total"), F.first("all_shares").alias("all_shares"))
    if total_tokens is not None:
        feasible = feasible.withColumn("total", F.lit(float(total_tokens)))
    plan = checkpointed(plan.join(F.broadcast(feasible)).withColumn("expected", F.least(F.col("total") * F.col("target_share") / F.col("all_shares") / F.col("own_tokens"), F.col("max_repeats").cast("double"))))

    rate = F.broadcast(plan.select("source", "expected").filter("expected is not null"))  # one row per source with a target
    # texts of like size lie together, so that a source's sample has its sizes in proportion
    block = F.floor(F.log2("tokens") * 16).cast("long") * 64 + F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(64))
    placed = sizes.join(rate, "source").withColumn("block", block)
    in_block = placed.groupBy("source", "block").agg(F.count(F.lit(1)).alias("texts"))
    before = in_block.withColumn("before", F.coalesce(F.sum("texts").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "block", "before")
    rank = F.row_number().over(Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")) - 1
    ranked = placed.withColumn("rank", rank).join(before, ["source", "block"]).withColumn("place", F.col("before") + F.col("rank"))
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = (F.floor((F.col("place") + 1) * F.col("expected") + offset) - F.floor(F.col("place") * F.col("expected") + offset)).cast("int")
    written = ranked.withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "tokens", "copies")
    written = checkpointed(written)
    got = written.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"), F.sum("copies").alias("copies"))
    total = got.agg(F.sum("mixed_tokens").alias("all_tokens"))
    report = plan.select("source", "target_share", "max_repeats", F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), F.coalesce("texts", F.lit(0)).alias("texts"), F.round("expected", 6).alias("expected_copies")).join(got, "source", "left").join(F.broadcast(total))
    report = report.select(
        "source", "target_share", "max_repeats", "texts", "own_tokens", "expected_copies", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce(F.round(F.col("mixed_tokens") / F.col("all_tokens"), 6), F.lit(0.0)).alias("reached_share"),
    )
    return written, report
