"""Consolidating pairwise matches into groups: connected components over message ids.

The component around the vertex of highest degree is searched breadth-first by frontier joins as long as the frontier widens
or, past its widest, narrows: both take a number of rounds that grows with the logarithm of the component. A component
searched to its end is peeled: its edges are removed by an anti-join. A search that stalls has met a long chain; what it
reached is contracted to its least vertex, so that nothing found is lost. The rest is labelled by minimum propagation in
rounds of a large and a small star, which shortcut long reply chains.

Defined results: rows without an id that name nobody, and ids that no row has, tie nothing; null and empty values are no
ids; repeated rows count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed

#: What reads as a message id inside surrounding text.
ID_PATTERN = r'[^\s<>,;"()]+@[^\s<>,;"()]+'


def ids_in(text: Column) -> Column:
    """The message ids of a text, lower-cased, without brackets and surrounding text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ID_PATTERN), F.lit(0))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _search(both: DataFrame, patience: int, step: float) -> tuple[DataFrame, bool]:
    """Vertices (x) reached from the vertex of highest degree, and whether they are its whole component.

    A round counts as progress if its frontier is ``step`` times wider than the widest before, or that much narrower than the
    narrowest since; ``patience`` rounds without progress end the search.
    """
    top = both.groupBy("u").count().orderBy(F.desc("count"), "u").limit(1).select(F.col("u").alias("x"))
    reached = frontier = checkpointed(top)
    widest, narrowest, idle = 0, 0, 0
    while idle < patience:
        frontier = checkpointed(both.join(frontier.select(F.col("x").alias("u")), "u").select(F.col("v").alias("x")).distinct().join(reached, "x", "left_anti"))
        size = frontier.count()
        if not size:
            return checkpointed(reached), True
        # the union of a few rounds; cut anew where it grows long
        reached = reached.unionByName(frontier)
        if size >= step * widest:
            widest = narrowest = size
            idle = 0
        elif size * step <= narrowest:
            narrowest, idle = size, 0
        else:
            idle += 1
    return checkpointed(reached), False


def _peel(edges: DataFrame, patience: int, step: float) -> tuple[DataFrame, DataFrame | None]:
    """Edges without the component of the vertex of highest degree, or with what was reached of it contracted, and (vertex, label) of that part."""
    reached, whole = _search(checkpointed(_both_ways(edges).distinct()), patience, step)
    least = reached.agg(F.min("x")).first()[0]
    if least is None:
        return edges, None
    labels = reached.select(F.col("x").alias("vertex"), F.lit(least).alias("label"))
    if whole:
        return edges.join(reached.select(F.col("x").alias("u")), "u", "left_anti"), labels
    in_u, in_v = reached.select(F.col("x").alias("u"), F.lit(True).alias("ru")), reached.select(F.col("x").alias("v"), F.lit(True).alias("rv"))
    moved = edges.join(in_u, "u", "left").join(in_v, "v", "left").filter("ru is null or rv is null")
    rest = moved.select(F.when(F.col("ru"), F.lit(least)).otherwise(F.col("u")).alias("u"), F.when(F.col("rv"), F.lit(least)).otherwise(F.col("v")).alias("v"))
    return rest.distinct(), labels


def components(edges: DataFrame, patience: int = 3, step: float = 1.25) -> DataFrame:
    """(vertex, label): the least vertex of the component of each vertex of ``edges`` (u long, v long)."""
    clean = checkpointed(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    stars, peeled = _peel(clean, patience, step)
    stars = checkpointed(stars)
    before = None
    while True:
        both = _both_ways(stars)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        stars = checkpointed(small.filter("u <> v").distinct())
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    labels = stars.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
    labels = labels.unionByName(labels.select(F.col("label").alias("vertex"), "label").distinct())
    if peeled is None:
        return labels
    # the contracted part moves with its least vertex
    final = peeled.join(labels.select(F.col("vertex").alias("label"), F.col("label").alias("lower")), "label", "left").select("vertex", F.coalesce("lower", "label").alias("label"))
    return labels.join(final.select("vertex"), "vertex", "left_anti").unionByName(final)


def reply_groups(mail: DataFrame) -> DataFrame:
    """(row_idx, group_row): rows in a group of at least two, with the smallest row_idx of the group."""
    rows = mail.select("row_idx", F.get(ids_in(F.col("message_id")), F.lit(0)).alias("own"), F.array_distinct(F.flatten(F.transform(F.concat(F.array("in_reply_to"), F.coalesce("ref_ids", F.array())), ids_in))).alias("named"))
    by_id = checkpointed(rows.filter("own is not null").groupBy("own").agg(F.min("row_idx").alias("vertex"), F.count_distinct("row_idx").alias("rows")))
    ids = by_id.select("own", "vertex")
    naming = rows.filter(F.size("named") > 0).select("row_idx", "own", F.explode("named").alias("name")).filter("own is null or own <> name")
    # only ids that some row has tie; then the naming row's own vertex
    tied = naming.join(ids.select(F.col("own").alias("name"), F.col("vertex").alias("v")), "name").select("row_idx", "own", "v")
    edges = tied.filter("own is not null").select("own", "v").distinct().join(ids, "own").select(F.col("vertex").alias("u"), "v")
    edges = edges.unionByName(tied.filter("own is null").select(F.col("row_idx").alias("u"), "v"))
    labels = components(edges)
    # rows without an id are their own vertex; the rows of one id share a vertex
    held = rows.join(by_id, "own", "left").select("row_idx", F.coalesce("vertex", "row_idx").alias("vertex"), F.coalesce("rows", F.lit(1)).alias("rows"))
    grouped = held.join(labels, "vertex", "left").filter("label is not null or rows > 1")
    return grouped.select("row_idx", F.coalesce("label", "vertex").alias("group_row")).distinct()
