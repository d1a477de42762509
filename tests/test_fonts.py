"""Fonts of pages that are counted as text, and of those that are not."""

from castellan import schemas
from castellan.operators.notation import font_inventory


def test_pages_of_one_font_count_as_others(spark):
    made = lambda chars: [(c, (0.0, 0.0, 1.0, 1.0), f, 1.0, "") for c, f in chars]
    pages = {1: [(" ", "A"), ("x", "A"), ("\u0085", "A"), ("♘", "A"), (None, "A"), ("\U0001d400", "A")], 2: [("ab", "A"), ("", "A"), ("\u0000", "A")], 3: [(" ", "B"), ("\n", "B")], 4: [(" ", "C"), ("\t", "C"), ("y", "C")], 5: [("q", "A"), ("r", None)], 6: [("z", None)], 7: []}
    df = spark.createDataFrame([("b", p, 1.0, 1.0, "", made(c)) for p, c in pages.items()], schemas.PAGES)
    got = {r.font: (r.n, r.first.page, r.first.pos) for r in font_inventory(df).collect()}
    assert got == {"A": (6, 1, 1), "C": (1, 4, 2), None: (2, 5, 1)}
    # The pages of one font with single characters are counted without a step for every character.
    assert "regexp_replace(joined" in font_inventory(df)._jdf.queryExecution().optimizedPlan().toString()
