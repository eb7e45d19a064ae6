"""Chunks of paragraphs under their headings, as relations of lines, blocks, chunks and sentences.

Lines. A fence opens code, which reaches to the next fence or the end. Any other line is a table row, blank, a heading or text.
Blocks. Neighbouring lines of one class are a block; a heading is one by itself, each fenced part is one, blank lines only divide.
Packing. Blocks of a section are put together in order, with an empty line between, while they hold ``largest`` characters at most.
  A table or code ends its chunk.
Tail. The last chunk of a text joins the one before if both are in one section, it is shorter than ``smallest``, does not end with a table
  or code, and both fit into ``largest``.
Headings. A chunk begins with its section's heading, unless its text does; its place is that of its blocks, and the first chunk of a
  section begins where the heading stands. Places count blocks and the line ends between them: one after a heading, two after others.
Sentences. A chunk longer than ``largest`` is cut after sentence ends and at line ends, and packed again, a line end between sentences. A
  sentence longer than ``largest`` is cut into pieces of that size, which stand alone.

Windows over lines find the blocks, so a long text is a sequence of rows; what is folded in order are lengths alone. Rows of one id are told apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Sizes and patterns that decide the results.
LARGEST, SMALLEST = 1200, 250
HEADING = "^\\s{0,3}(?:#{1,6}\\s+|第[^\\n]{1,40}[章节条款]|[0-9]+(?:\\.[0-9]+)*\\s+).+"
TABLE_ROW = "^\\s*\\|.*\\|\\s*$"
FENCE = "^\\s*(```|~~~)"
STOPS = "(?<=[。！？；!?;])\\s*|\\n{2,}|\\n"
# End of fixed values.
KEY = "__row"


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, id, n, kind, block): heading, table, code and paragraph blocks of every text in order; ``__row`` names the row of ``docs``."""
    named = docs.select(F.monotonically_increasing_id().alias(KEY), F.col(id_col), F.split(text_col, "\\r?\\n").alias("lines"))
    base = named.select(KEY, id_col, F.posexplode("lines").alias("i", "line"))
    order = W.partitionBy(KEY).orderBy("i")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE)
    lines = base.withColumn("fence", fence).withColumn("fences", F.sum(fence.cast("int")).over(upto))
    kind = (
        F.when(F.col("fence") | (F.col("fences") % 2 == 1), "code")
        .when(F.col("line").rlike(TABLE_ROW), "table")
        .when(~F.col("line").rlike("\\S"), "blank")
        .when(F.col("line").rlike(HEADING), "heading")
        .otherwise("paragraph")
    )
    # the closing fence has an even number and belongs to the part before
    part = F.when(F.col("kind") == "code", F.ceil(F.col("fences") / 2)).otherwise(0)
    parted = lines.withColumn("kind", kind).withColumn("part", part)
    new = (F.col("kind") == "heading") | ~F.lag("kind").over(order).eqNullSafe(F.col("kind")) | (F.lag("part").over(order) != F.col("part"))
    runs = parted.withColumn("n", F.sum(new.cast("int")).over(upto)).where("kind <> 'blank'")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return runs.groupBy(KEY, id_col, "n", "kind").agg(_stripped(joined).alias("block")).where("block <> ''")


def fold(lengths: list[int], closes: list[bool], between: int, largest: int) -> list[int]:
    """The number of each member's run: a run holds what fits with ``between`` in its gaps, and ends after a member that closes it."""
    number, room, out = -1, -1, []
    for length, close in zip(lengths, closes, strict=True):
        if room < between + length:
            number, room = number + 1, largest + between
        out.append(number)
        room = -1 if close else room - between - length
    return out


def run_numbers(between: int, largest: int):
    @F.pandas_udf("array<int>")
    def numbers(lengths: pd.Series, closes: pd.Series) -> pd.Series:
        return pd.Series([fold(list(n), list(c), between, largest) for n, c in zip(lengths, closes, strict=True)], dtype=object)

    return numbers


def packed(found: DataFrame, id_col: str = "doc_id", largest: int = LARGEST, smallest: int = SMALLEST) -> DataFrame:
    """(__row, id, section, number, start, heading, size, chunk): the chunks of ``blocks`` by the rules of packing, tails and headings."""
    order = W.partitionBy(KEY).orderBy("n")
    heading = F.col("kind") == "heading"
    size = F.length("block")
    placed = (
        found.withColumn("section", F.sum(heading.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("place", F.coalesce(F.sum(size + F.when(heading, 1).otherwise(2)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    )
    closes = F.col("kind").isin("table", "code")
    member = F.struct("n", "block", "place", size.alias("size"), closes.alias("closes"))
    sections = placed.groupBy(KEY, id_col, "section").agg(F.max(F.when(heading, F.struct("block", "place"))).alias("head"), F.sort_array(F.collect_list(F.when(~heading, member))).alias("m"))
    numbers = run_numbers(2, largest)(F.transform("m", lambda x: x["size"]), F.transform("m", lambda x: x["closes"]))
    each = sections.where(F.size("m") > 0).withColumn("k", numbers).select(KEY, id_col, "section", "head", F.inline(F.arrays_zip("m", "k")))
    chunk = each.groupBy(KEY, id_col, "section", F.col("k").alias("number")).agg(F.first("head").alias("head"), F.sort_array(F.collect_list("m")).alias("m"))
    text = F.array_join(F.transform("m", lambda x: x["block"]), "\n\n")
    start = F.when(F.col("number") == 0, F.coalesce("head.place", F.element_at("m", 1)["place"])).otherwise(F.element_at("m", 1)["place"])
    whole = chunk.select(KEY, id_col, "section", "number", start.alias("start"), F.coalesce("head.block", F.lit("")).alias("heading"), text.alias("body"), F.element_at("m", -1)["closes"].alias("closed"))
    # tails
    shown = F.when((F.col("heading") == "") | F.col("body").startswith(F.col("heading")), F.col("body")).otherwise(F.concat_ws("\n\n", "heading", "body"))
    ends = W.partitionBy(KEY).orderBy("section", "number")
    tail = F.lead("body").over(ends)
    last = F.lead("body", 2).over(ends).isNull() & tail.isNotNull() & (F.lead("section").over(ends) == F.col("section")) & ~F.lead("closed").over(ends)
    takes = last & (F.length(tail) < smallest) & (F.length(F.col("chunk")) + 2 + F.length(tail) <= largest)
    told = whole.withColumn("chunk", shown).withColumn("size", F.length("body"))
    told = told.withColumn("takes", F.coalesce(takes, F.lit(False))).withColumn("tail", tail).withColumn("tail_end", F.lead(F.col("start") + F.col("size")).over(ends))
    told = told.withColumn("taken", F.coalesce(F.lag("takes").over(ends), F.lit(False)))
    joined = F.when(F.col("takes"), F.concat_ws("\n\n", "chunk", "tail")).otherwise(F.col("chunk"))
    size_ = F.when(F.col("takes"), F.col("tail_end") - F.col("start")).otherwise(F.col("size"))
    return told.where("NOT taken").select(KEY, id_col, "section", "number", "start", "heading", size_.alias("size"), joined.alias("chunk"))


def bounded(chunks: DataFrame, id_col: str = "doc_id", largest: int = LARGEST) -> DataFrame:
    """(id, start_index, end_index, section_path, chunk): the chunks, long ones by the rule of sentences."""
    parts = F.filter(F.transform(F.split("chunk", STOPS), _stripped), lambda x: x != "")
    pieces = F.flatten(F.transform(parts, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / largest).cast("int")), lambda k: F.struct(F.substring(p, k * largest + 1, F.lit(largest)).alias("p"), (F.length(p) > largest).alias("closes")))))
    numbers = run_numbers(1, largest)(F.transform("m", lambda x: F.length(x["p"])), F.transform("m", lambda x: x["closes"]))
    rows = chunks.withColumn("long", F.length("chunk") > largest)
    short = rows.where("NOT long").select(id_col, F.col("start").cast("int").alias("start_index"), (F.col("start") + F.col("size")).cast("int").alias("end_index"), F.col("heading").alias("section_path"), "chunk")
    held = rows.where("long").withColumn("m", pieces).withColumn("k", numbers)
    # the pieces of each run, found in the array where they stand
    runs = F.transform(F.sequence(F.lit(0), F.array_max("k")), lambda n: F.array_join(F.transform(F.filter(F.arrays_zip("m", "k"), lambda x: x["k"] == n), lambda x: x["m"]["p"]), "\n"))
    each = held.select(KEY, id_col, "section", "number", "start", "heading", F.posexplode(runs).alias("at", "chunk"))
    before = F.sum(F.length("chunk") + 1).over(W.partitionBy(KEY, "section", "number").orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    begin = F.col("start") + F.coalesce(before, F.lit(0))
    cut = each.withColumn("begin", begin).select(id_col, F.col("begin").cast("int").alias("start_index"), (F.col("begin") + F.length("chunk")).cast("int").alias("end_index"), F.col("heading").alias("section_path"), "chunk")
    return short.unionByName(cut)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, smallest: int = SMALLEST) -> DataFrame:
    """(id, start_index, end_index, section_path, chunk) of every text; null and blank texts have none."""
    return bounded(packed(blocks(docs, id_col, text_col), id_col, largest, smallest), id_col, largest)
