"""Records of delimited files whose quoted cells hold line breaks, found in all splits of a file at once.

Whether a line begins a record depends on the lines before it. But a line only maps one state (in a quoted cell or not)
to another, and such maps can be composed in any grouping: each split composes the maps of its own lines, one short row
for each split gives the state in which it begins, and only the lines of records over several lines move to one place.
Quotes that stand within a cell without opening it are told from those that do.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.table import stored

#: Where a line is: number of the part file, file, start of the split and place in the split.
PLACE = ("__o0", "__o1", "__o2", "__o3")
SPLIT = PLACE[1:3]


def left_open(line: Column, sep: str) -> Column:
    """Whether a line that begins a record ends within a quoted cell. A cell is quoted if a quote is the first of its
    characters that is not white space; doubled quotes belong to it, and what follows the closing quote is plain text."""
    s = re.escape(sep)
    white, body = rf"[\x00-\x20&&[^{s}]]*+", r'"(?:[^"]++|"")*+'
    return line.contains('"') & line.rlike(rf'\A(?:(?:{white}{body}"[^{s}]*+|(?!{white}")[^{s}]*+){s})*+{white}{body}\z')


def _with_before(df: DataFrame, w) -> DataFrame:
    """For rows that map a state to __outside if no cell is open before them, else to __inside: adds __known, whether the
    state before a row does not depend on that before all rows, and __state (where it depends: if none was open)."""
    outside, inside = F.col("__outside"), F.col("__inside")
    rows = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__upto", F.sum(F.when(outside & ~inside, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # How many rows before swap the states, and the last row that leads to one state from either.
    swaps = F.coalesce(F.max("__upto").over(rows), F.lit(0))
    last = F.last(F.when(outside == inside, F.struct(outside.alias("to"), F.col("__upto").alias("upto"))), ignorenulls=True).over(rows)
    state = F.when(last.isNull(), swaps % 2 == 1).otherwise(last["to"] != ((swaps - last["upto"]) % 2 == 1))
    return df.withColumns({"__known": last.isNotNull(), "__state": state}).drop("__upto")


def records(lines: DataFrame, sep: str) -> DataFrame:
    """__o0 to __o3, the place of a record's first line, and line, all its lines with \\n between them, of `lines` with
    the places of all lines. Lines are dealt out by split and written once, with what their place tells about their
    state. A quoted cell that is never closed goes on to the end of its file."""
    w = Window.partitionBy(*SPLIT).orderBy("__o3")
    line = F.col("line")
    quotes = line.contains('"')
    df = lines.withColumn("__outside", F.when(quotes, left_open(line, sep)).otherwise(False))
    df = df.withColumn("__inside", F.when(quotes, left_open(F.concat(F.lit('"'), line), sep)).otherwise(True))
    df = _with_before(df, w)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Records begun in the split up to the line, if the split begins outside a quoted cell and if inside.
    state = F.col("__state")
    other = F.when(F.col("__known"), state).otherwise(~state)
    df = df.withColumns({"__out": F.sum(F.when(~state, 1).otherwise(0)).over(upto), "__in": F.sum(F.when(~other, 1).otherwise(0)).over(upto)})
    df = stored(df, "lines")

    ends = df.groupBy("__o1", "__o2").agg(F.max_by(F.struct("__known", "__state", "__outside", "__inside", "__out", "__in"), "__o3").alias("e"))
    after = lambda s: F.when(s, F.col("e.__inside")).otherwise(F.col("e.__outside"))
    ends = ends.select("__o1", "__o2", after(F.col("e.__state")).alias("__outside"), after(F.when(F.col("e.__known"), F.col("e.__state")).otherwise(~F.col("e.__state"))).alias("__inside"), F.col("e.__out").alias("__out"), F.col("e.__in").alias("__in"))
    along = Window.partitionBy("__o1").orderBy("__o2")  # one row for each split of a file
    ends = _with_before(ends, along)
    begun = F.when(F.col("__state"), F.col("__in")).otherwise(F.col("__out"))
    owner = F.last(F.when(begun > 0, F.struct(F.col("__o2").alias("split"), begun.alias("record"))), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    # What a split needs to know is only where one begins inside a cell; Spark merges or broadcasts by size.
    inside = ends.select("__o1", "__o2", F.col("__state").alias("__starts"), owner.alias("__owner")).filter("__starts")
    df = df.join(inside, list(SPLIT), "left")
    starts = F.coalesce("__starts", F.lit(False))
    state = F.when(F.col("__known") | ~starts, F.col("__state")).otherwise(~F.col("__state"))
    df = df.withColumn("__here", state).withColumn("__record", F.when(starts, F.col("__in")).otherwise(F.col("__out")))
    alone = ~F.col("__here") & ~F.col("__outside")
    pieces = df.filter(~alone).withColumn("__key", F.when(F.col("__record") > 0, F.struct(F.col("__o2").alias("split"), F.col("__record").alias("record"))).otherwise(F.col("__owner")))
    whole = pieces.groupBy("__o0", "__o1", "__key").agg(F.sort_array(F.collect_list(F.struct("__o2", "__o3", "line"))).alias("p"))
    whole = whole.select("__o0", "__o1", F.col("p")[0]["__o2"].alias("__o2"), F.col("p")[0]["__o3"].alias("__o3"), F.concat_ws("\n", F.col("p")["line"]).alias("line"))
    return df.filter(alone).select(*PLACE, "line").unionByName(whole)
