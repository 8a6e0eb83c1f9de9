"""Mergeable quantile summaries: adaptive radix histograms whose leaves are points with known ranks, merged by their bounds."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vanika.llm.common import crc_mod, cut, drop, table

#: Bits of a digit: a prefix has at most 2 ** DIGIT children, so no join here has more rows of a key on either side.
DIGIT = 8
#: No leaf of several values has more than this share of a summary's distinct values, so a summary of many has over 10 points.
VALUES = 1 / 16
#: Points that a merged summary keeps at most.
MOST = 1000


def counted(rows: DataFrame, by: list[str], x: str = "x", weight: str | None = None) -> DataFrame:
    """k (a struct of the columns by), x, c: how often each integer is there. Rows without x are left out; null groups are groups."""
    own = rows.select(F.struct(*by).alias("k"), F.col(x).cast("long").alias("x"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return own.filter("x IS NOT NULL AND w > 0").groupBy("k", "x").agg(F.sum("w").alias("c"))


def _meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by shuffles, whatever the sizes: none of the sides is bounded."""
    return left.hint("merge").join(right.hint("merge"), on)


def _heavy(n: str, error: float) -> Column:
    """Whether a prefix of two values can be lighter than the error's share of n rows; if not, every value is a point by itself."""
    return F.col(n) * (error / 2) >= 2


def marked(counts: DataFrame, whole: Column) -> DataFrame:
    """counts (k, x, c) with n, the rows of the group, and most, those of the largest group of the same whole.

    A group of most rows is one key here: adaptive execution splits its side of the sorted join.
    """
    sums = counts.groupBy("k").agg(F.sum("c").alias("n")).withColumn("whole", whole)
    sums = _meet(sums, sums.groupBy("whole").agg(F.max("n").alias("most")), ["whole"]).drop("whole")
    return cut(_meet(counts, sums, ["k"]), "marked")


def values_as_points(marks: DataFrame) -> DataFrame:
    """k, lo, hi, c, rank, n: the points of groups (k, x, c, n) that are so small that all prefixes of several values are split."""
    upto = F.sum("c").over(Window.partitionBy("k").orderBy("x"))
    return marks.select("k", F.col("x").alias("lo"), F.col("x").alias("hi"), "c", upto.alias("rank"), "n")


class Radix:
    """Exact counts of a set of groups' integers by prefixes of their bits.

    A level has the prefixes without the last DIGIT * level bits, each with its rows c, distinct values d, least and greatest value. Counts of a level
    are sums of those of the level below, so a group of any size is summed up where its rows are before they are shuffled. levels[0] has the values
    themselves; at the last level all share one parent. x's span must fit into 63 bits. No rows: no groups.
    """

    def __init__(self, counts: DataFrame) -> None:
        """counts: k, x, c, a row for each value of a group."""
        base = cut(counts, "values")
        low, high = base.agg(F.min("x"), F.max("x")).first()
        self.low = low or 0
        top = max(1, ((high or 0) - self.low).bit_length())
        place = F.col("x") - self.low
        self.levels = [base.select("k", place.alias("p"), "c", F.lit(1).cast("long").alias("d"), F.col("x").alias("lo"), F.col("x").alias("hi"))]
        for level in range(1, -(-top // DIGIT)):
            up = self.levels[-1].groupBy("k", F.shiftright("p", DIGIT).alias("p")).agg(F.sum("c").alias("c"), F.sum("d").alias("d"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            self.levels.append(cut(up, f"prefixes-{level}"))

    def tree(self) -> DataFrame:
        """k, level, parent, p, c of all levels."""
        return reduce(DataFrame.union, (t.select("k", F.lit(i).alias("level"), F.shiftright("p", DIGIT).alias("parent"), "p", "c") for i, t in enumerate(self.levels)))

    def points(self, only: Column | None = None, error: float = 0.02) -> DataFrame:
        """k, lo, hi, c, rank, n of the groups (those of only, a condition on k): each leaf as the greatest value hi that it has, with the exact rank of it.

        From the top, each pass splits only the prefixes that hold over half the permitted error's share of the rows, or over VALUES of the distinct values; what is light
        enough, or one value, is a leaf. Neighbouring leaves become one point as long as that has less than error * n rows, so the point whose rank is the first at
        or above a target is off by less. There are at most 4 / error + 1 / VALUES + 1 points, and at least min(10, distinct values).
        """
        nodes = self.levels[-1] if only is None else self.levels[-1].filter(only)
        sums = nodes.groupBy("k").agg(F.sum("c").alias("n"), F.sum("d").alias("u"))
        nodes = cut(_meet(nodes, sums, ["k"]), "nodes")
        share, fair = F.col("n") * (error / 2), F.col("u") * VALUES
        heavy = (F.col("d") > 1) & ((F.col("c") > share) | (F.col("d") > fair))
        leaves = [nodes.filter(~heavy)]
        for below in self.levels[-2::-1]:
            split = nodes.filter(heavy).select("k", F.col("p").alias("parent"), "n", "u")
            nodes = cut(_meet(below.withColumn("parent", F.shiftright("p", DIGIT)), split, ["k", "parent"]).drop("parent"), "nodes")
            leaves.append(nodes.filter(~heavy))
        # A group has a bounded number of leaves: heavy prefixes of a level times 2 ** DIGIT.
        order = Window.partitionBy("k").orderBy("lo")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        found = reduce(DataFrame.unionByName, (x.select("k", "lo", "hi", "c", "d", "n", "u") for x in leaves))
        found = found.withColumns({"rows_before": F.coalesce(F.sum("c").over(before), F.lit(0)), "values_before": F.coalesce(F.sum("d").over(before), F.lit(0))})
        cell = F.struct((F.col("c") > share).alias("alone"), F.floor(F.col("rows_before") / share).alias("by_rows"), F.floor(F.col("values_before") / fair).alias("by_values"))
        merged = found.groupBy("k", cell.alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("c"), F.max(F.col("rows_before") + F.col("c")).alias("rank"), F.max("n").alias("n"))
        return merged.drop("cell")

    def nth(self, wanted: DataFrame) -> DataFrame:
        """wanted (k, i, target) with exact_x, the target-th smallest value: a descent by exact counts, one level a join."""
        at = wanted.select("k", "i", "target", F.col("target").alias("left"), F.lit(0).cast("long").alias("parent"))
        siblings = Window.partitionBy("k", "i").orderBy("p")
        for level in reversed(self.levels):
            met = _meet(at, level.select("k", F.shiftright("p", DIGIT).alias("parent"), "p", "c"), ["k", "parent"])
            met = met.withColumn("upto", F.sum("c").over(siblings)).filter("upto - c < left AND left <= upto")
            at = met.select("k", "i", "target", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("p").alias("parent"))
        return at.select("k", "i", "target", (F.col("parent") + self.low).alias("exact_x"))

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """wanted (k, i, answer) with n_below and n_upto, how many rows' values are below and at or below it: at each level, its smaller siblings."""
        top = len(self.levels)
        place = F.col("answer") - self.low
        paths = wanted.select("k", "i", "answer", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), F.shiftright(place, DIGIT * (i + 1)).alias("parent"), F.shiftright(place, DIGIT * i).alias("own")) for i in range(top)))).alias("s")).select("k", "i", "answer", "s.*")
        met = _meet(paths, self.tree(), ["k", "level", "parent"])
        below = F.sum(F.when(F.col("p") < F.col("own"), F.col("c")).otherwise(0))
        return met.groupBy("k", "i", "answer").agg(below.alias("n_below"), (below + F.sum(F.when((F.col("level") == 0) & (F.col("p") == F.col("own")), F.col("c")).otherwise(0))).alias("n_upto"))


def merge(points: DataFrame, most: int = MOST) -> DataFrame:
    """k, x, rmin, rmax, at, exact, n: one summary of the points (k, lo, hi, c) of several of a group.

    Every point's greatest value is a point of the whole. rmin counts the rows of points that end at or before it, rmax also those of points that it lies in: the true rank is between. Of
    each summary it lies in one point at most, of less than error * n rows, so the first rmin at or above a target is off by less than error times all rows. at: the rows of points that end
    there; exact: all points of the whole are single values, so at and rmin are true counts. Over most points: the last of each of most equal steps of rank, which adds n / most.
    """
    wide = F.col("hi") > F.col("lo")
    end = F.struct(F.col("hi").alias("x"), F.col("c").alias("low"), F.when(wide, 0).otherwise(F.col("c")).alias("up"), F.lit(1).alias("kept"), F.when(wide, 1).otherwise(0).alias("wide"))
    start = F.struct(F.col("lo").alias("x"), F.lit(0).cast("long").alias("low"), F.col("c").alias("up"), F.lit(0).alias("kept"), F.lit(1).alias("wide"))
    places = points.select("k", F.explode(F.when(wide, F.array(end, start)).otherwise(F.array(end))).alias("p")).select("k", "p.*")
    places = places.groupBy("k", "x").agg(F.sum("low").alias("low"), F.sum("up").alias("up"), F.max("kept").alias("kept"), F.max("wide").alias("wide"))
    upto, of = Window.partitionBy("k").orderBy("x"), Window.partitionBy("k")
    found = places.select("k", "x", "kept", F.col("low").alias("at"), F.sum("low").over(upto).alias("rmin"), F.sum("up").over(upto).alias("rmax"), F.sum("low").over(of).alias("n"), F.sum("kept").over(of).alias("m"), F.max("wide").over(of).alias("wide")).filter("kept = 1")
    step = F.floor((F.col("rmin") - 1) * most / F.col("n"))
    next_step = F.lead(step).over(upto)
    found = found.withColumn("last", F.when(F.col("m") > most, F.coalesce(next_step != step, F.lit(True))).otherwise(True)).filter("last")
    return found.select("k", "x", "rmin", "rmax", "at", ((F.col("wide") == 0) & (F.col("m") <= most)).alias("exact"), "n")


def quantiles(summary: DataFrame, parts: int = 4, least: int = 1) -> DataFrame:
    """k, i, n, target, points, answer, rmin, below (its rank, and that before it), exact for each i below parts: the first point (x, rmin, at, exact, n) whose rank is the target ceil(i * n / parts) or more. Groups under least rows have none."""
    target = [F.floor((F.lit(i) * F.col("n") + (parts - 1)) / parts).cast("long") for i in range(1, parts)]
    # The first such point has the least rank and the least value: ranks grow with values.
    first = [F.min(F.when(F.col("rmin") >= t, F.col("rmin"))).alias(f"r{i}") for i, t in enumerate(target, 1)]
    found = [F.min(F.when(F.col("rmin") >= t, F.col("x"))).alias(f"a{i}") for i, t in enumerate(target, 1)]
    low = [F.min(F.when(F.col("rmin") >= t, F.col("rmin") - F.col("at"))).alias(f"b{i}") for i, t in enumerate(target, 1)]
    rows = summary.groupBy("k").agg(F.count("*").alias("points"), F.max("n").alias("n"), F.min("exact").alias("exact"), *first, *found, *low).filter(F.col("n") >= least)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), t.alias("target"), F.col(f"a{i}").alias("answer"), F.col(f"r{i}").alias("rmin"), F.col(f"b{i}").alias("below")) for i, t in enumerate(target, 1))))
    return rows.select("k", "n", "points", "exact", each.alias("q")).select("k", "q.i", "n", "q.target", "points", "q.answer", "q.rmin", "q.below", "exact")


#: Batches that the two streams' rows fall into, and the largest money that counts.
BATCHES, LARGEST = 4, 1e13


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream, grp, batch, x, w of clicks (one row of each click_id) and of sale lines with their items; w: how many rows a row stands for.

    Rows of one click_id are copies; if they weren't, the one of the least hash counts.
    """
    chosen = F.xxhash64("arrived_at", "ts", "client_id", "value")
    first = table(spark, sf_dir, "clicks").groupBy("click_id").agg(F.min_by("client_id", chosen).alias("client_id"), F.min_by("value", chosen).alias("value"))
    clicks = first.select(F.lit("value").alias("stream"), F.col("client_id").cast("string").alias("grp"), crc_mod("click_id", BATCHES).alias("batch"), F.col("value").alias("money"), F.lit(1).cast("long").alias("w"))
    # An item's lines are summed up first: then no item has more than BATCHES of them.
    lines = table(spark, sf_dir, "sale_lines").groupBy("item_id", crc_mod("vendor_id", BATCHES).alias("batch")).agg(F.count("*").alias("w"))
    sold = _meet(lines, table(spark, sf_dir, "items").select("item_id", "brand", "price"), ["item_id"])
    sold = sold.select(F.lit("price").alias("stream"), F.col("brand").alias("grp"), "batch", F.col("price").alias("money"), "w")
    rows = clicks.unionByName(sold).filter(F.col("grp").isNotNull() & (F.abs("money") < LARGEST))
    return rows.select("stream", "grp", F.col("batch").cast("int").alias("batch"), (F.floor(F.col("money") * 100 + 0.5) + F.col("batch") * 1000).cast("long").alias("x"), "w")


#: Bits of a key that tell a whole's batches (from 0) apart; the whole itself has none of them.
BATCH_BITS = 8


def _named(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """stream, grp and their number (a key without its batch), and own with keys k: plain integers by the first hash that tells all groups apart."""
    for seed in itertools.count():
        number = F.shiftleft(F.xxhash64("stream", "grp", F.lit(seed)), BATCH_BITS)
        names = cut(own.select("stream", "grp").distinct().withColumn("whole", number), "names")
        if names.groupBy("whole").count().filter("count > 1").isEmpty():
            return names, own.select(number.bitwiseOR(F.col("batch").cast("long") + 1).alias("k"), "x", "c")
        drop(names)
    raise AssertionError


def report(rows: DataFrame, error: float = 0.02, parts: int = 4, least: int = 20) -> DataFrame:
    """Quantiles of every batch of each group and of the whole (batch -1), beside exact ranks.

    rows: stream, grp, batch (from 0, under 255), x, w. The whole's summary is merged of the batches' summaries only. exact_x, n_below and n_upto are exact: those of a summary that has
    every value are its own, the others come from counts of all rows, by descents of the same digits. Nulls in x or w: the row doesn't count; null groups are groups. No rows: no rows. Other columns
    are ignored.
    """
    counts = counted(rows, ["stream", "grp", "batch"], weight="w")
    own = cut(counts.select("k.stream", "k.grp", "k.batch", "x", "c"), "batches")
    names, base = _named(own)
    whole = F.shiftleft(F.shiftright("k", BATCH_BITS), BATCH_BITS)
    marks = marked(base, whole)
    heavy = _heavy("n", error)
    exact = Radix(marks.filter(heavy).select("k", "x", "c").union(marks.filter(_heavy("most", error)).groupBy(whole.alias("k"), "x").agg(F.sum("c").alias("c"))))
    points = cut(exact.points(F.col("k") != whole, error).unionByName(values_as_points(marks.filter(~heavy))), "points")
    each = points.select("k", F.col("hi").alias("x"), F.col("rank").alias("rmin"), F.col("c").alias("at"), (F.col("lo") == F.col("hi")).alias("exact"), "n")
    found = cut(quantiles(each, parts, least).union(quantiles(merge(points.select(whole.alias("k"), "lo", "hi", "c")), parts, least)), "quantiles")
    sure = found.filter("exact").select("k", "i", "n", "target", F.col("answer").alias("exact_x"), "points", "answer", F.col("below").alias("n_below"), F.col("rmin").alias("n_upto"))
    open_ = found.filter("NOT exact")
    met = _meet(_meet(open_, exact.nth(open_).drop("target"), ["k", "i"]), exact.ranks(open_).drop("answer"), ["k", "i"])
    rows = _meet(sure.unionByName(met.select(*sure.columns)).withColumn("whole", whole), names, ["whole"])
    off = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    batch = (F.col("k").bitwiseAND(F.lit((1 << BATCH_BITS) - 1)) - 1).cast("int")
    return rows.withColumn("rank_error", off).select("stream", "grp", batch.alias("batch"), "i", "n", "target", "exact_x", "points", "answer", "n_below", "n_upto", "rank_error", (1000 * F.col("rank_error") <= round(1000 * error) * F.col("n")).alias("within"))
