"""Panels of regions by their labels, on literal pages."""

from leafmill.operators import splits

REGION = ("d", 1, "r", 100.0, 100.0, 400.0, 200.0)


def panels(spark, labels, regions=(REGION,)):
    rows = [("d", 1, i, text, lines, float(x), float(y), 40.0, 10.0, "z") for i, (text, x, y, lines) in enumerate(labels)]
    blocks = spark.createDataFrame(rows, "doc string, page int, block int, text string, n_lines int, x double, y double, width double, height double, panel string")
    given = spark.createDataFrame(list(regions), "doc string, page int, region string, x double, y double, width double, height double")
    out = splits.split_regions(given, blocks, ["doc", "page"]).orderBy("region", "panel").collect()
    return [(r.panel, r.block, r.vertical, r.left_edge, r.top_edge, r.panel_width, r.panel_height) for r in out]


def test_rows_and_columns(spark):
    row = [("(b) right one", 380, 280, 1), ("(a)", 180, 285, 1), ("(c) long " + "x" * 200, 300, 280, 1), ("no label", 250, 280, 1), ("(d) outside", 700, 280, 1), ("(e) too many lines", 300, 280, 6)]
    assert panels(spark, row) == [(1, 1, True, 100.0, 100.0, 200.0, 200.0), (2, 0, True, 300.0, 100.0, 200.0, 200.0)]
    column = [("(A)", 180, 120, None), ("(b)", 185, 180, 1), ("(c)", 180, 260, 1)]
    assert panels(spark, column) == [(1, 0, False, 100.0, 100.0, 400.0, 55.0), (2, 1, False, 100.0, 155.0, 400.0, 70.0), (3, 2, False, 100.0, 225.0, 400.0, 75.0)]


def test_no_panels(spark):
    assert panels(spark, [("(a)", 180, 280, 1)]) == [] and panels(spark, []) == []
    assert panels(spark, [("(a)", 120, 120, 1), ("(b)", 400, 260, 1)]) == []  # neither a row nor a column
    assert panels(spark, [(f"({c})", 110 + 70 * i, 280, 1) for i, c in enumerate("abcde")]) == []
    assert panels(spark, [("(a)", 180, 280, 1), ("(b)", 183, 280, 1)]) == []  # too close
    assert panels(spark, [("(a)", 180, 280, 1), (None, 380, 280, 1)]) == []
    flat = ("d", 1, "r", 100.0, 280.0, 400.0, 11.0)
    assert panels(spark, [("(a)", 180, 281, 1), ("(b)", 380, 281, 1)], [flat]) == []  # a panel below twelve points
    odd = [("d", 1, "n", None, 1.0, 2.0, 3.0), ("d", 1, "m", float("nan"), 1.0, 2.0, 3.0)]
    assert panels(spark, [("(a)", 180, 280, 1), ("(b)", 380, 280, 1)], odd) == []
