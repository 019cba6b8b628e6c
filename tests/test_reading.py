"""Reading order: columns, bands, rows, headings inside bodies; no order contradicts itself."""

import random

from leafmill.operators import reading

SCHEMA = "doc string, page int, block int, x double, y double, width double, height double, page_width int, heading boolean, band string, text string"


def order(spark, blocks, page_width=600):
    rows = [("d", 1, i, *box, page_width, h, "mine", "t") for i, (*box, h) in enumerate(blocks)]
    got = reading.reading_order(spark.createDataFrame(rows, SCHEMA), ["doc"]).collect()
    assert sorted(r.place for r in got) == list(range(len(blocks)))
    return [r.block for r in sorted(got, key=lambda r: r.place)]


LEFT, RIGHT = 20.0, 320.0


def test_columns_and_bands(spark):
    blocks = [
        (RIGHT, 100.0, 200.0, 20.0, False), (LEFT, 100.0, 200.0, 20.0, False), (20.0, 10.0, 500.0, 20.0, False), (LEFT, 140.0, 200.0, 20.0, False), (RIGHT, 150.0, 200.0, 20.0, False),
        (20.0, 200.0, 500.0, 20.0, False), (RIGHT, 190.0, 200.0, 20.0, False), (LEFT, 240.0, 200.0, 20.0, False),
    ]
    assert order(spark, blocks) == [2, 1, 3, 0, 4, 5, 7, 6]  # the last right one begins beside the wide block: below it
    # one block at the right: no two columns; tops within two points are a row
    assert order(spark, [(RIGHT, 11.0, 200.0, 20.0, False), (LEFT, 10.0, 200.0, 20.0, False), (LEFT, 40.0, 200.0, 20.0, False)]) == [1, 0, 2]


def test_heading_goes_before_the_body_that_holds_it(spark):
    body, heading = (LEFT, 100.0, 200.0, 80.0), (LEFT, 120.0, 150.0, 10.0)
    assert order(spark, [(*heading, True), (*body, False)]) == [0, 1]
    assert order(spark, [(*body, False), (*heading, True)]) == [0, 1]  # the source gives the body first
    assert order(spark, [(*heading, False), (*body, False)]) == [1, 0]
    assert order(spark, [(LEFT, 300.0, 150.0, 10.0, True), (*body, False)]) == [1, 0]  # below the body
    # two headings keep their own order, and the block above stays above
    assert order(spark, [(LEFT, 150.0, 150.0, 10.0, True), (*heading, True), (LEFT, 10.0, 200.0, 10.0, False), (*body, False)]) == [2, 1, 0, 3]


def test_no_constraint_is_broken(spark):
    rng = random.Random(3)
    for _ in range(3):
        blocks = [(rng.choice([LEFT, RIGHT]), float(rng.randint(0, 300)), float(rng.randint(40, 250)), float(rng.randint(1, 90)), rng.random() < 0.4) for _ in range(60)]
        got = order(spark, blocks)
        place = {b: i for i, b in enumerate(got)}
        for i, (x, y, w, _, h) in enumerate(blocks):
            for j, (x2, y2, w2, h2, other) in enumerate(blocks):
                same = (x + w / 2 < 300) == (x2 + w2 / 2 < 300)
                if h and not other and i < j and same and y2 - 4 <= y <= y2 + max(1, h2) + 6 and abs(x + w / 2 - x2 - w2 / 2) < max(80, 0.75 * min(w, w2)):
                    assert place[i] < place[j]


def test_edges(spark):
    none = (None, None, None, None, None)
    assert order(spark, [none, (LEFT, 10.0, 100.0, 5.0, None), (float("nan"), 1.0, 1.0, 1.0, True), (LEFT, 10.0, 100.0, 5.0, False)], None) == [1, 3, 0, 2]
    empty = reading.reading_order(spark.createDataFrame([], SCHEMA), ["doc"])
    assert empty.collect() == [] and empty.columns == [c for c in ("doc page block x y width height page_width heading text").split()] + reading.ADDED
