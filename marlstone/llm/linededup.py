"""Line dedup by content-defined chunks of lines; DataFrame functions only.

A document's lines are cut into chunks wherever a rolling hash over the last few line hashes is 0 modulo ``divisor``. The cuts depend
on the lines around them alone, so a passage is cut alike wherever it stands, but for its ends. Of chunks of ``least_lines`` lines or
more that occur again anywhere, byte for byte, only the first occurrence stays.

Cuts miss passages that hold no whole chunk, and the ends of others. So runs of lines are compared as well: for each line the shortest
run of more than ``over`` words that starts with it, and the shortest that ends with it. Of two equal passages of more words than that,
every line is in one of these runs, all within the passage; so repeated passages go from their first line to their last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, kept

#: Base of the rolling hash; line hashes have 32 bits, so sums over some lines stay below 63 bits.
BASE = 31


def chunks(text: Column, window: int, divisor: int) -> Column:
    """An array of (``first``, ``lines``, ``body``): where each chunk starts, how many lines it has, and its text."""
    lines = F.split(text, "\n", -1)
    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
    both = F.struct(lines.alias("lines"), hashes.alias("hashes"))

    def of(x: Column) -> Column:
        held, own = x["lines"], x["hashes"]
        n = F.size(held)

        def ends(i: Column) -> Column:
            rolling = sum((F.get(own, i - j) * F.lit(BASE**j) for j in range(1, window)), F.get(own, i))
            return (i == n - 1) | ((i >= window - 1) & (rolling % divisor == 0))

        last = F.filter(F.sequence(F.lit(0), n - 1), ends)
        first = F.concat(F.array(F.lit(0)), F.transform(F.slice(last, 1, F.size(last) - 1), lambda e: e + 1))
        return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), (b - a + 1).alias("lines"), F.array_join(F.slice(held, a + 1, b - a + 1), "\n").alias("body")))

    return F.element_at(F.transform(F.array(both), of), 1)


def runs(text: Column, over: int) -> Column:
    """An array of (``first``, ``until``, ``alone``, ``body``): the shortest runs of more than ``over`` words from each line and to it.

    Lines without words belong to no ``body``; ``alone`` says that the run is the text's only line.
    """
    base = over + 2
    lines = F.split(text, "\n", -1)
    counted = F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"), x.alias("line")))
    both = F.struct(F.filter(counted, lambda x: x["words"] > 0).alias("full"), F.size(lines).alias("n"))

    def of(x: Column) -> Column:
        full = x["full"]
        n = F.size(full)

        def taking(some: Column) -> Column:
            # One number holds the words and, below ``base``, the lines: structs would be made anew for each line.
            add = lambda s, y: F.when(s >= (over + 1) * base, s).otherwise(s + y["words"] * base + 1)
            return F.aggregate(some, F.lit(0).cast("long"), add, lambda s: F.when(s >= (over + 1) * base, (s % base).cast("int")))

        def reach(few: Column, all_: Column) -> Column:
            """How many of the lines it takes, mostly few; null if all are too few."""
            return F.coalesce(taking(few), taking(all_))

        every = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
        ahead = F.transform(every, lambda i: F.struct(i.alias("a"), (i + reach(F.slice(full, i + 1, 3), F.slice(full, i + 1, over + 1)) - 1).alias("b")))
        before = lambda i, n: F.reverse(F.slice(full, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)) + 1))
        back = F.transform(every, lambda i: F.struct((i - reach(before(i, 2), before(i, over)) + 1).alias("a"), i.alias("b")))
        found = F.filter(F.array_distinct(F.concat(ahead, back)), lambda r: r["a"].isNotNull() & r["b"].isNotNull())
        body = lambda r: F.array_join(F.transform(F.slice(full, r["a"] + 1, r["b"] - r["a"] + 1), lambda y: y["line"]), "\n")
        return F.transform(found, lambda r: F.struct(F.get(full, r["a"])["at"].alias("first"), F.get(full, r["b"])["at"].alias("until"), (x["n"] == 1).alias("alone"), body(r).alias("body")))

    return F.element_at(F.transform(F.array(both), of), 1)


def repeats(own: DataFrame) -> DataFrame:
    """``id``, ``mark``, ``first``, ``until`` of every passage ``c`` of ``own`` (``id``, ``mark``, ``c``) but the first of equal ones.

    Bodies are compared by digests of 256 bits. All are written once, by column; counting reads the digests alone, and only passages
    whose digest repeats go on. The join is never a broadcast, so that a passage in a great part of all documents can be split.
    """
    each = kept(own.select("id", "mark", "c.first", "c.until", "c.alone", F.unhex(F.sha2("c.body", 256)).alias("digest")))
    short = F.xxhash64("digest").alias("hash")
    again = kept(each.select(short).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    found = kept(each.withColumn("hash", F.xxhash64("digest")).join(again.hint("merge"), "hash", "left_semi").drop("hash"))
    place = F.struct("id", "mark", "first")
    first = kept(found.groupBy("digest").agg(F.min(F.struct("id", "mark", "first", "alone")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    both_alone = F.col("alone") & F.col("kept.alone")
    return found.join(first.hint("merge"), "digest").where((place != F.struct("kept.id", "kept.mark", "kept.first")) & ~both_alone).select("id", "mark", "first", "until")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 3, least_lines: int = 2, over: int = 50, copies: bool = True) -> DataFrame:
    """Rows of ``docs`` with all their columns, repeated passages cut out of the text, and ``lines``, ``removed_lines`` (long).

    Passages are chunks of ``least_lines`` lines or more and runs of lines of more than ``over`` words, lines without words within them
    not compared. The first occurrence, by id (nulls first), then text and place in it, stays; every line that goes has an equal one
    before it that stays. With ``copies`` off, a text of one line that is nothing but a copy of another such text is left alone, for a
    stage that removes copies as rows. Lines end at line feeds only; passages without anything but spaces and line feeds always stay; a
    text of which nothing is left becomes empty, its row stays. A null text stays null with no lines, the empty text has one empty
    line. Rows equal in id and text count as one document and are cut alike. Very long texts are cut whole; columns ``lines`` and
    ``removed_lines`` of ``docs`` are replaced; other columns pass unseen.
    """
    id_, text = F.col(id_col), F.col(text_col)
    solid = lambda c: (c["lines"] >= least_lines) & (F.translate(c["body"], " \n", "") != "")
    parts = F.transform(F.filter(chunks(text, window, divisor), solid), lambda c: F.struct(c["first"].alias("first"), (c["first"] + c["lines"] - 1).alias("until"), F.lit(False).alias("alone"), c["body"].alias("body")))
    longer = F.transform(runs(text, over), lambda c: F.struct(c["first"].alias("first"), c["until"].alias("until"), (c["alone"] & F.lit(not copies)).alias("alone"), c["body"].alias("body")))
    own = docs.where(text.isNotNull()).select(id_.alias("id"), F.xxhash64(text).alias("mark"), F.explode(F.concat(parts, longer)).alias("c"))
    gone = kept(repeats(own).groupBy("id", "mark").agg(F.collect_set(F.struct("first", "until")).alias("gone")))
    held = docs.drop("lines", "removed_lines").withColumn("_mark", F.xxhash64(text))
    many = gone.select(F.col("id").alias("_id"), F.col("mark").alias("_other"), "gone").hint("merge")
    held = held.join(many, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_other")), "left")
    n = F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.flatten(F.transform("gone", lambda g: F.sequence(g["first"], g["until"]))))
    left = F.transform(F.array(F.struct(F.split(text, "\n", -1).alias("lines"), stay.alias("stay"))), lambda x: F.struct(F.array_join(F.transform(x["stay"], lambda i: F.get(x["lines"], i)), "\n").alias("text"), F.size(x["stay"]).alias("n")))[0]
    cut_out = F.when(F.col("gone").isNull(), text).otherwise(left["text"])
    removed = F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - left["n"])
    return held.select(*[cut_out.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("lines", "removed_lines")], n.cast("long").alias("lines"), removed.cast("long").alias("removed_lines"))
