"""Joins by place against all pairs, and that crowded places form no more pairs than they report."""

import random

from pyspark.sql import functions as F

from castellan.operators import relations
from castellan.operators.groups import tasks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rule_pairs_meet_in_narrow_cells(spark):
    r = random.Random(1)
    rules = [(k, k % 2, r.randrange(-50, 400), r.randrange(40), r.randrange(40, 90)) for k in range(300)] + [(300, None, 5, 0, 90), (301, 0, None, 0, 90)]
    got = relations.rule_pairs(spark.createDataFrame(rules, "id int, page int, y int, x0 int, x1 int").coalesce(1), ["page"], 20, 60)
    whole = [x for x in rules if x[1] is not None and x[2] is not None]
    want = sorted((a[1], a[0], b[0]) for a in whole for b in whole if a[1] == b[1] and 20 <= b[2] - a[2] <= 60 and min(a[4], b[4]) - max(a[3], b[3]) >= 20)
    assert sorted(map(tuple, got.collect())) == want and want
    assert f"RepartitionByExpression [page#" in plan(got) and f", {tasks(spark)}" in plan(got)
    # Rules 65 apart are outside the gaps and in no common cell.
    apart = spark.createDataFrame([(k, 0, 60 + 65 * (k % 2), 0, 90) for k in range(200)], "id int, page int, y int, x0 int, x1 int")
    assert relations.rule_pairs(apart, ["page"], 20, 60).isEmpty()


def test_boxes_meet_in_two_dimensions(spark):
    r = random.Random(2)
    boxes = lambda n, w, h: [(k, k % 2, r.randrange(-100, 400), r.randrange(-100, 400), 1 + r.randrange(w), 1 + r.randrange(h)) for k in range(n)]
    a, b = boxes(200, 90, 20), boxes(100, 60, 100)
    made = lambda rows: spark.createDataFrame(rows, "id int, page int, x int, y int, w int, h int")
    got = relations.boxes_overlap(made(a), made(b), ["page"], 40.0)
    over = lambda p, q, at, size: min(p[at] + p[size], q[at] + q[size]) > max(p[at], q[at])
    want = sorted((p[1], p[0], q[0]) for p in a for q in b if p[1] == q[1] and over(p, q, 2, 4) and over(p, q, 3, 5))
    assert sorted(map(tuple, got.collect())) == want and want
    assert "__d" in plan(got)  # boxes side by side in one row of cells do not meet


def test_nearest_forms_no_pairs(spark):
    r = random.Random(3)
    left = [(k, k % 3, r.randrange(-200, 900)) for k in range(300)] + [(300, None, 5), (301, 0, None)]
    right = [(k, k % 3, r.randrange(-200, 900) // 4 * 4) for k in range(150)] + [(150, None, 5), (151, 0, None)]
    got = relations.nearest_within(spark.createDataFrame(left, "i int, page int, y int"), spark.createDataFrame(right, "p int, page int, ry int"), ["page"], "i", "y", "p", "ry", 30)
    found = lambda l: min(((abs(l[2] - x[2]), x[0]) for x in right if None not in (*l, *x) and l[1] == x[1] and abs(l[2] - x[2]) <= 30), default=(None, None))  # noqa: E731, E741
    assert sorted(map(tuple, got.collect())) == sorted((x[0], found(x)[1], found(x)[0]) for x in left)
    assert plan(got).count("Join ") == 1  # only the best of each row is joined back
    assert got.where(F.col("p").isNull()).count() > 0
