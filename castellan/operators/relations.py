"""Joins, windows and searches by place, over any columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .groups import tasks


def nearest_within(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, at: str, right_id: str, right_at: str, tolerance: float) -> DataFrame:
    """For each left row the right row of the same keys nearest in ``at``, if within ``tolerance``; the smallest id of equals.

    Right rows of one place fold into their smallest id and are copied to three
    buckets one tolerance wide. In each bucket, sorted by place, the last right
    row before a left one and the first after it compete, so no pairs form.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(tolerance)).cast("long")
    whole = lambda df: df.dropna(subset=keys)
    folded = whole(right).where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).alias("__at")).agg(F.min(right_id).alias("__r"))
    r = folded.select(*keys, "__at", F.explode(F.array(*(bucket("__at") + d for d in (-1, 0, 1)))).alias("__b"), "__r", F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.lit(False).alias("__left"))
    l = whole(left).where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("__at"), bucket(at).alias("__b"), F.lit(None).cast(right.schema[right_id].dataType).alias("__r"), left_id, F.lit(True).alias("__left"))  # noqa: E741
    place = F.when(~F.col("__left"), F.struct("__at", "__r"))
    w = W.partitionBy(*keys, "__b").rowsBetween(W.unboundedPreceding, 0)
    both = r.union(l).repartition(tasks(left.sparkSession), *keys, "__b")
    both = both.withColumn("__before", F.last(place, ignorenulls=True).over(w.orderBy("__at", "__left"))).withColumn("__after", F.last(place, ignorenulls=True).over(w.orderBy(F.desc("__at"), "__left")))
    away = lambda c: F.when(F.abs(F.col("__at") - F.col(f"{c}.__at")) <= tolerance, F.struct(F.abs(F.col("__at") - F.col(f"{c}.__at")).alias("distance"), F.col(f"{c}.__r").alias(right_id)))
    near = both.where("__left").select(left_id, F.least(away("__before"), away("__after")).alias("best")).where("best is not null")
    best = near.groupBy(left_id).agg(F.min("best").alias("best"))
    return left.join(best, left_id, "left").select(left_id, F.col(f"best.{right_id}").alias(right_id), F.col("best.distance").alias("distance"))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point_id: str, at: str, interval_id: str, start: str, end: str, width: int) -> DataFrame:
    """Each point with the interval of its keys that holds it (start <= at < end), else null.

    Intervals are copied to the cells of ``width`` that they touch.
    """
    p = points.select(*keys, point_id, at, F.floor(F.col(at) / width).alias("__c"))
    cells = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    i = intervals.where(F.col(end) > F.col(start)).select(*keys, interval_id, start, end, F.explode(cells).alias("__c"))
    held = p.join(i, [*keys, "__c"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    first = held.groupBy(point_id).agg(F.min(interval_id).alias(interval_id))
    return points.select(point_id).join(first, point_id, "left")


def boxes_overlap(a: DataFrame, b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs (a_id, b_id) of boxes (id, x, y, w, h) of the same keys that overlap, by square grid cells of side ``cell``.

    A pair is reported once, in the lowest and leftmost cell that both touch.
    """
    spans = lambda at, size: F.sequence(F.floor(F.col(at) / cell), F.floor((F.col(at) + F.col(size)) / cell))
    n = tasks(a.sparkSession)

    def rows(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in ("id", "x", "y", "w", "h")))
        tall = named.withColumn("__c", F.explode(spans(f"{p}_y", f"{p}_h")))
        return tall.withColumn("__d", F.explode(spans(f"{p}_x", f"{p}_w"))).repartition(n, *keys, "__c", "__d")

    j = rows(a, "a").join(rows(b, "b"), [*keys, "__c", "__d"])
    c = lambda n: F.col(n)
    meet = (F.least(c("a_x") + c("a_w"), c("b_x") + c("b_w")) > F.greatest(c("a_x"), c("b_x"))) & (F.least(c("a_y") + c("a_h"), c("b_y") + c("b_h")) > F.greatest(c("a_y"), c("b_y")))
    first = (c("__c") == F.floor(F.greatest(c("a_y"), c("b_y")) / cell)) & (c("__d") == F.floor(F.greatest(c("a_x"), c("b_x")) / cell))
    return j.where(meet & first).select(*keys, "a_id", "b_id")


def by_occurrence(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of a key on the left with the k-th on the right; unmatched left rows keep nulls."""
    number = lambda df, order: df.withColumn("occurrence", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [*keys, "occurrence"], "left")


def rule_pairs(rules: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Pairs of rules (id, y, x0, x1) whose gap is in [least, most] and whose reaches overlap by ``least``.

    The lower rule is copied to the narrow cells that its upper one may stand
    in, so few pairs outside the gaps meet. Pairs are many more than rules, so
    rows are dealt by cell to all tasks, whatever their bytes.
    """
    width = max(1, (most - least) // 8)
    cell = lambda y: F.floor(y / width)
    n = tasks(rules.sparkSession)
    a = rules.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("id", "y", "x0", "x1")), cell(F.col("y")).alias("__c")).repartition(n, *keys, "__c")
    b = rules.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("id", "y", "x0", "x1")), F.explode(F.sequence(cell(F.col("y") - most), cell(F.col("y") - least))).alias("__c")).repartition(n, *keys, "__c")
    reach = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    return a.join(b, [*keys, "__c"]).where((F.col("b_y") - F.col("a_y")).between(least, most) & (reach >= least)).select(*keys, "a_id", "b_id")


def misaligned(truth: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Keys on which both sides differ or one is missing."""
    t, f = truth.select(*keys, F.col(column).alias("want")), found.select(*keys, F.col(column).alias("got"))
    return t.join(f, keys, "full").where(~F.col("want").eqNullSafe(F.col("got")))


def unless_found(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first``, and of ``second`` what has keys that ``first`` lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def best_window(pages: DataFrame, book: str, page: str, starts: Column, numbers: Column, size: int) -> DataFrame:
    """Per book the run of ``size`` pages with the most game starts, then move numbers, the earliest of equals; a shorter book whole."""
    order = W.partitionBy(book).orderBy(page)
    frame = order.rowsBetween(0, size - 1)
    p = pages.select(F.col(book), F.col(page).alias("first_page"), F.sum(starts).over(frame).alias("starts"), F.sum(numbers).over(frame).alias("numbers"), F.max(page).over(frame).alias("last_page"), F.count("*").over(frame).alias("k"), F.row_number().over(order).alias("r"))
    whole = p.where((F.col("k") == size) | (F.col("r") == 1))
    best = F.max(F.struct((F.col("k") == size).alias("full"), "starts", "numbers", (-F.col("first_page")).alias("m"), "last_page")).alias("b")
    return whole.groupBy(book).agg(best).select(book, (-F.col("b.m")).alias("first_page"), "b.last_page", "b.starts", "b.numbers")


def with_context(rows: DataFrame, group: list[str], order: list[str], keep: Column, context: int = 1) -> DataFrame:
    """Rows that hold and the next ``context`` rows of their group."""
    frame = W.partitionBy(*group).orderBy(*order).rowsBetween(-context, 0)
    return rows.withColumn("__keep", F.max(keep.cast("int")).over(frame)).where("__keep = 1").drop("__keep")


def separated(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Boxes (y, h) whose top stops where the one before begins."""
    above = F.lag("y").over(W.partitionBy(*group).orderBy(*order))
    over = F.col("y") + F.col("h") - above
    return rows.withColumn("h", F.when(over > 0, F.col("h") - over).otherwise(F.col("h")))


def covered_width(intervals: DataFrame, group: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of each group's intervals."""
    frame = W.partitionBy(*group).orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(end).over(frame)
    part = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(reach, F.col(start))))
    return intervals.withColumn("__part", part).groupBy(*group).agg(F.sum("__part").alias("covered"))


def column_cut(boxes: DataFrame, group: list[str], width: Column, middle: Column) -> DataFrame:
    """Per group the integer x in the middle half that fewest boxes cross, nearest the middle; null where the guards refuse it.

    A box adds one where it begins and takes it away where it ends; a running
    sum over those few places says how many boxes cross any position. Between
    two of them that number stays, so only the position nearest the middle of
    each stretch competes.
    """
    span = boxes.select(*group, "x", "w", width.alias("width"), middle.alias("middle"))
    pages = span.groupBy(*group).agg(F.count("*").alias("n"), F.first("width").alias("width"), F.first("middle").alias("middle"))
    lo, hi = F.floor(F.col("width") * 0.25), F.floor(F.col("width") * 0.75) - 1
    first, last = F.greatest(F.floor(F.col("x")) + 1, lo), F.least(F.ceil(F.col("x") + F.col("w")) - 1, hi)
    crossed = span.where(first <= last)
    ends = crossed.select(*group, F.explode(F.array(F.struct(first.alias("at"), F.lit(1).alias("d")), F.struct((last + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*group, "e.*")
    # Every page also has a place of its own at the left end.
    edge = pages.where("n >= 8").select(*group, lo.alias("at"), F.lit(0).alias("d"))
    steps = ends.union(edge).groupBy(*group, "at").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*group).orderBy("at")
    steps = steps.withColumn("crossing", F.sum("d").over(order)).withColumn("next", F.lead("at").over(order))
    near = steps.join(pages.where("n >= 8"), group).withColumn("stop", F.least(F.coalesce(F.col("next") - 1, hi), hi)).where("at <= stop")
    # Of integers as near to the middle the smaller one counts.
    best_at = F.greatest(F.col("at"), F.least(F.col("stop"), F.ceil(F.col("middle") - 0.5)))
    scored = near.withColumn("cut", best_at)
    best = scored.groupBy(*group, "n").agg(F.min(F.struct("crossing", F.abs(F.col("cut") - F.col("middle")).alias("d"), "cut")).alias("b")).select(*group, "n", "b.crossing", "b.cut")
    sides = best.join(boxes.select(*group, "x", "w"), group).groupBy(*group, "n", "crossing", "cut").agg(F.count_if(F.col("x") + F.col("w") <= F.col("cut")).alias("left"), F.count_if(F.col("x") >= F.col("cut")).alias("right"))
    good = (F.col("crossing") <= F.greatest(F.lit(3.0), 0.05 * F.col("n"))) & (F.least("left", "right") >= 0.2 * F.col("n"))
    return pages.select(*group).join(sides.select(*group, F.when(good, F.col("cut")).alias("cut")), group, "left")


def runs(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal neighbours: (group, run, value, length, first)."""
    w = W.partitionBy(*group).orderBy(*order)
    changed = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    numbered = rows.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "run", value).agg(F.count("*").alias("length"), F.min(order[0]).alias("first"))


def spread(cells: DataFrame, group: list[str]) -> DataFrame:
    """Cells (row, col, char) whose char recurs on another row and another column, per group."""
    seen = cells.groupBy(*group, "char").agg(F.countDistinct("row").alias("r"), F.countDistinct("col").alias("c"), F.count("*").alias("n"))
    return seen.groupBy(*group).agg(F.coalesce(F.sum(F.when((F.col("r") > 1) & (F.col("c") > 1), F.col("n"))), F.lit(0)).alias("spread"))


def all_best(scored: DataFrame, by: list[str], score: str) -> DataFrame:
    """Every row with the greatest score of its group; none where that is 0."""
    top = F.rank().over(W.partitionBy(*by).orderBy(F.desc(score)))
    return scored.withColumn("__r", top).where(f"__r = 1 and {score} > 0").drop("__r")


def first_best(scored: DataFrame, by: list[str], score: list[str], ordinal: str) -> DataFrame:
    """One row per group: the greatest score, the first of equals."""
    order = W.partitionBy(*by).orderBy(*(F.desc(s) for s in score), ordinal)
    return scored.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def next_page(pages: DataFrame, by: list[str], page: str, current: Column) -> DataFrame:
    """The next annotated page after ``current``, the first one after the last."""
    return pages.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(page) > current, F.col(page))), F.min(page)).alias("next_page"))


def sweep(rows: DataFrame, thresholds: list[float], by: list[str], confidence: str, hit: Column) -> DataFrame:
    """Per threshold the accepted rows and how many of them hit, from one pass: every threshold is a conditional sum."""
    pairs = F.array(*(F.struct(F.lit(t).alias("threshold"), F.count_if(F.col(confidence) >= t).alias("accepted"), F.count_if((F.col(confidence) >= t) & hit).alias("hits")) for t in thresholds))
    return rows.groupBy(*by).agg(pairs.alias("p")).select(*by, F.explode("p").alias("p")).select(*by, "p.*")


def attached(rows: DataFrame, items: DataFrame, keys: list[str], name: str, *columns: str) -> DataFrame:
    """Rows with all their items as one ordered array, null without any."""
    held = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    return rows.join(held, keys, "left")


def without(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def together(first: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows of all tables, columns matched by name."""
    for other in more:
        first = first.unionByName(other)
    return first


def zipped(rows: DataFrame, keys: list[str], **arrays: Column) -> DataFrame:
    """A row for each position of arrays side by side, the first being 1; a shorter one is filled up with nulls."""
    both = F.arrays_zip(*(c.alias(n) for n, c in arrays.items()))
    return rows.select(*keys, F.posexplode(both).alias("__p", "__z")).select(*keys, (F.col("__p") + 1).alias("pos"), *(F.col(f"__z.{n}").alias(n) for n in arrays))


def around(rows: DataFrame, by: list[str], order: list[str], at: Column, reach: int) -> DataFrame:
    """Rows of each group that stand within ``reach`` of place ``at`` (from 0)."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn("__k", place).where(F.abs(F.col("__k") - at) <= reach).drop("__k")
