"""Unique aliases: each arrival takes its base name if that is free, else base-1, base-2, ..., the first that is free then.

What the loop over arrivals gives, without the loop. A base's arrivals take free numbers in ascending order, so the j-th gets the
j-th number that isn't blocked: its rank among arrivals (at j) and blocked numbers (at the free numbers below them). A number is
blocked if its name was taken before, or if an arrival of that very name came before the base's turn at it. Such literal
names are settled between bounds: with at least and at most so many of the smaller ones blocked, the turn comes between two
arrivals; each round settles those for which both say the same, at least the smallest open one of each base. Bases go by the
number of suffixes of their names, as one's generated names are the next ones' competitors.

Ranks within a base come from one sort by ranges and the sizes of the partitions, so that a base that a third of all arrivals
share is spread like any other.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardwell.sources.shared import written

SUFFIX = r"-([1-9][0-9]{0,17})$"
SUFFIXES = r"((?:-[1-9][0-9]{0,17})*)$"


def ranked(rows: DataFrame, group: str, *order: str, name: str = "rank") -> DataFrame:
    """rows with their place (from 1) within the group, by the order, which must be total."""
    columns, keys = rows.columns, [F.col(c) for c in (group, *order)]
    placed = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "ranks")
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # a number a partition
    before = dict(zip([p for p, _ in sizes], accumulate([0, *(n for _, n in sizes)]), strict=False))
    offsets = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_p long, _before long")
    placed = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_at", F.col("_before") + local)
    first = placed.groupBy(group).agg(F.min("_at").alias("_first"))
    return placed.join(first, group).select(*columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def _settled(literal: DataFrame, arrivals: DataFrame) -> DataFrame:
    """base, number of the literal names that come before their base's turn. literal: base, number, s (its first arrival), taken (numbers
    below it that are taken). arrivals: base, j, t."""
    turns, most = arrivals.select("base", "j", "t"), arrivals.groupBy("base").agg(F.max("j").alias("m"))
    open_ = literal.join(most, "base").withColumn("skip", F.lit(None).cast("boolean"))
    below = Window.partitionBy("base").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # literal names of one base
    while True:
        least = F.coalesce(F.count_if(F.col("skip")).over(below), F.lit(0))
        largest = F.coalesce(F.count_if(F.coalesce("skip", F.lit(True))).over(below), F.lit(0))
        rows = open_.withColumn("late", F.col("number") - F.col("taken") - least).withColumn("soon", F.col("number") - F.col("taken") - largest)
        at = lambda turn: turns.select("base", F.col("j").alias(turn), F.col("t").alias(f"t_{turn}"))
        rows = rows.join(at("late"), ["base", "late"], "left").join(at("soon"), ["base", "soon"], "left")
        skip = F.when(F.col("skip").isNotNull(), F.col("skip")).when(F.col("soon") > F.col("m"), False).when(F.col("s") < F.col("t_soon"), True)
        skip = skip.when((F.col("late") <= F.col("m")) & (F.col("s") > F.col("t_late")), False)
        open_ = written(rows.select("base", "number", "s", "taken", "m", skip.alias("skip")), "literals")
        if open_.filter("skip IS NULL").isEmpty():
            return open_.filter("skip").select("base", "number")


def unique(arrivals: DataFrame, taken: DataFrame) -> DataFrame:
    """t, base, alias: arrivals (t, base; t orders them and is unique) after the names in taken (alias): used and reserved ones."""
    rows = written(arrivals.select("t", "base", F.size(F.regexp_extract_all(F.regexp_extract("base", SUFFIXES, 1), F.lit(r"-[0-9]+"), 0)).alias("depth")).filter("base IS NOT NULL"), "arrivals")
    known = taken.select("alias").filter("alias IS NOT NULL").distinct()
    number = lambda c: F.regexp_extract(c, SUFFIX, 1)
    stem = lambda c: F.regexp_replace(c, SUFFIX, "")
    split = lambda df, c, *more: df.filter(number(c) != "").select(stem(c).alias("base"), number(c).cast("long").alias("number"), *more)
    held = written(split(known, "alias"), "held")
    firsts = written(rows.groupBy("base").agg(F.min("t").alias("s"), F.max("depth").alias("depth")), "firsts")
    schema = f"alias string, made {dict(rows.dtypes)['t']}"
    made, out = rows.sparkSession.createDataFrame([], schema), None
    for (depth,) in sorted(firsts.select("depth").distinct().collect()):  # as many as a name has suffixes
        own = firsts.filter(F.col("depth") == depth)
        own = own.join(known.select(F.col("alias").alias("base"), F.lit(True).alias("gone")), "base", "left").join(made.select(F.col("alias").alias("base"), "made"), "base", "left")
        plain = written(own.filter("gone IS NULL AND (made IS NULL OR s < made)").select("base", F.col("s").alias("t")), "plain")
        rest = rows.filter(F.col("depth") == depth).select("base", "t").join(plain, ["base", "t"], "left_anti")
        turns = written(ranked(rest, "base", "t", name="j"), "turns")
        bases = turns.select("base").distinct()
        blocked = held.join(bases, "base", "left_semi").select("base", "number")
        literal = split(firsts.join(known.select(F.col("alias").alias("base")), "base", "left_anti"), "base", "s").join(bases, "base", "left_semi")
        both = ranked(blocked.withColumn("s", F.lit(None).cast(dict(rows.dtypes)["t"])).unionByName(literal), "base", "number").filter("s IS NOT NULL")
        alone = ranked(literal, "base", "number", name="own").select("base", "number", "own")
        literal = both.join(alone, ["base", "number"]).select("base", "number", "s", (F.col("rank") - F.col("own")).alias("taken"))
        blocked = written(blocked.unionByName(_settled(literal, turns)), "blocked")
        free = ranked(blocked, "base", "number", name="i").select("base", (F.col("number") - F.col("i")).alias("value"), F.lit(1).alias("kind"), F.col("i").alias("tie"), F.lit(None).cast(dict(rows.dtypes)["t"]).alias("t"))
        line = turns.select("base", F.col("j").alias("value"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), "t").unionByName(free)
        numbered = ranked(line, "base", "value", "kind", "tie", name="number").filter("kind = 0").select("t", "base", F.concat_ws("-", "base", F.col("number").cast("string")).alias("alias"))
        numbered = written(numbered, "numbered")
        made = made.unionByName(numbered.select("alias", F.col("t").alias("made")))
        done = plain.select("t", "base", F.col("base").alias("alias")).unionByName(numbered)
        out = done if out is None else out.unionByName(done)
    return out if out is not None else rows.select("t", "base", F.col("base").alias("alias"))
