"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Every source wants its share of a budget of words by weight, but gives at most ``most`` times its size. Sources over that cap are
clamped to it, and what they leave is shared again among the rest by weight, until no source is over its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, cut, ranked, small

#: The white space before a word.
BEFORE = r"[\x20\x09-\x0D]*"


def words(text_col: str) -> Column:
    """How many words a text has; none if it is null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source_col: str) -> Column:
    """A source's name as a key that is never null."""
    return F.when(F.col(source_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))


def order_key(id_col: str, size: Column, seed: int) -> Column:
    """Where a document stands in its source's seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), size.cast("string")))


def fill(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """``sources`` (``size``, ``weight``) with ``target``. The driver sees two sums a round; a round clamps one source at least."""
    held = sources.withColumn("cap", F.col("size") * F.lit(float(most))).withColumn("capped", F.col("size") == 0)
    while True:
        sums = held.agg(F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("w"), F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))), F.lit(0.0)).alias("c")).first()
        if not sums["w"]:
            return held.withColumn("target", F.col("cap"))
        level = max(0.0, budget - sums["c"]) / sums["w"]
        over = ~F.col("capped") & (F.col("weight") * F.lit(level) > F.col("cap"))
        if held.where(over).isEmpty():
            return held.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.lit(level)))
        held = cut(held.withColumn("capped", F.col("capped") | over))


def plan(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> tuple[DataFrame, int]:
    """One row for each source and how many there are. ``rows``: ``key``, ``place``, ``size`` of each document.

    ``whole``: how often every document is taken; ``edge``: in the seeded order, documents before it are taken once more, and those
    at it give ``edge_words`` words each (one document, but for repeated rows).
    """
    sums = cut(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")))
    totals = sums.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("k")).first()
    place = ranked(sums, F.col("key") == "", F.col("key"), name="place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = fill(place.select("key", "size", "n", weight.alias("weight")), totals["t"] * share, most)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    sources = cut(sources.withColumn("whole", whole).withColumn("part", F.round(F.col("target") - F.col("whole") * F.col("size")).cast("long")).select("key", "size", "n", "target", "whole", "part"))
    # The edge: sums of about sqrt(n) stretches of the order first, then the rows of the one stretch that holds it.
    wanted = sources.where("part > 0").select("key", "part", F.ceil(F.sqrt("n")).alias("stretches"))
    stretch = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("stretches") / F.lit(1 << 32))
    cells = rows.where("size > 0").join(small(wanted, totals["k"]), "key").withColumn("stretch", stretch)
    before = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums_of = cells.groupBy("key", "stretch", "part").agg(F.sum("size").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0)))
    holding = sums_of.where("before < part AND part <= before + s").select("key", "stretch", "before")
    equal = cells.join(small(holding, totals["k"]), ["key", "stretch"]).groupBy("key", "part", "before", "place", "size").agg(F.count(F.lit(1)).alias("m"))
    inside = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    equal = equal.withColumn("start", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("m")).over(inside), F.lit(0)))
    edges = equal.where(F.expr("start < part AND part <= start + size * m")).select("key", F.col("place").alias("edge"), F.expr("(part - start) div m").alias("edge_words"))
    return cut(sources.join(edges, "key", "left").select("key", F.col("size").alias("source_size"), "target", "whole", "edge", "edge_words")), totals["k"]


def taken(place: Column, size: Column) -> Column:
    more = F.when(place < F.col("edge"), size).when(place == F.col("edge"), F.col("edge_words")).otherwise(F.lit(0))
    return (F.col("whole") * size + F.coalesce(more, F.lit(0))).cast("long")


def amounts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """One row for each row of ``docs``: ``id``, ``size`` (words), ``source_size``, ``target`` (its source's), ``taken`` (words).

    Sources stand by code point, a null source last, and weigh ``weights`` in turn; the budget is ``share`` of all words. Each source
    reaches its target to a word: all its documents are taken whole as often as they fit, further ones in a seeded order once more,
    and one document gives only its first words. A null text has no words and is taken in none; ids may be null or repeat: equal
    (id, size) in a source stand at one place in the order and share alike. An empty table returns no rows.
    """
    size = words(text_col)
    rows = cut(docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("key"), order_key(id_col, size, seed).alias("place"), size.alias("size")))
    sources, n = plan(rows.select("key", "place", "size"), weights, share, most)
    return rows.join(small(sources, n), "key").select("id", "size", "source_size", "target", taken(F.col("place"), F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as ``amounts`` takes it.

    A document at the edge of its source's target appears once with its first words only, as they stand in the text. Documents without words
    are in no mix. See ``amounts`` for nulls, repeats and empty tables. The documents are not shuffled if the sources are few.
    """
    size = words(text_col)
    rows = cut(docs.select(source_key(source_col).alias("key"), order_key(id_col, size, seed).alias("place"), size.alias("size")))
    sources, n = plan(rows, weights, share, most)
    names = docs.columns
    held = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), source_key(source_col).alias("key"), order_key(id_col, size, seed).alias("place"), size.alias("size"))
    held = held.join(small(sources, n), "key").withColumn("taken", taken(F.col("place"), F.col("size"))).where("size > 0 AND taken > 0")
    each = held.select("row", "size", F.explode(F.expr("transform(sequence(0L, (taken - 1) div size), i -> least(size, taken - i * size))")).alias("give"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(f"row.{text_col}"), F.lit(BEFORE + WORD), 0), 1, F.col("give").cast("int")), "")
    return each.select(*[F.when(F.col("give") < F.col("size"), first).otherwise(F.col("row")[c]).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names])
