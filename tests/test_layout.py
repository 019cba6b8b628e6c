"""Line groups and merged artifacts on literal pages."""

from leafmill.operators import layout

LINES = "doc long, page long, pos long, x double, y double, width double, height double, formula boolean, ends boolean, starts boolean, side string"
W = 600.0


def groups(spark, *lines):
    rows = [(1, 1, i, float(x), float(y), float(w), 10.0, *[k in flags for k in ("formula", "ends", "starts")], "s") for i, (x, y, w, *flags) in enumerate(lines)]
    got = {}
    for r in layout.line_groups(spark.createDataFrame(rows, LINES), ["doc", "page"], "pos", W).orderBy("pos").collect():
        got.setdefault(r.grp, []).append(r.pos)
    return got


def test_line_groups(spark):
    column = [(50, 100, 230), (50, 112, 230, "ends"), (50, 150, 230, "starts"), (50, 162, 230), (50, 174, 230, "formula"), (50, 186, 230)]
    assert groups(spark, *column) == {0: [0, 1], 1: [2, 3], 2: [5]}
    assert groups(spark, (50, 100, 230), (50, 140, 230)) == {0: [0, 1]}  # a gap without a cue
    assert groups(spark, (50, 100, 230), (70, 140, 230)) == {0: [0], 1: [1]}  # indented
    both = [(50, 100, 230), (330, 100, 230), (50, 112, 230), (330, 112, 230), (50, 60, 500)]
    assert groups(spark, *both) == {0: [4], 1: [0, 2], 2: [1, 3]}
    assert groups(spark, (50, 100, 230, "formula"), (50, 112, 0), (50, 112, 10)) == {0: [2]}
    assert layout.line_groups(spark.createDataFrame([], LINES), ["doc", "page"], "pos", W).collect() == []


ARTIFACTS = "doc long, page long, pos long, type string, region string, x double, y double, width double, height double, text string, n_lines int, label string, confidence string, target long"


def test_merged_artifacts(spark):
    box, far = (10.0, 10.0, 100.0, 50.0), (500.0, 0.0, 1.0, 1.0)
    rows = [
        ("formula", "", *box, "a  b", 2, "", "low"), ("formula", "", 11.0, *box[1:], "c", 5, "L", "high"), ("code", "", *box, "a b", 2, "", "low"), ("formula", "r", None, *box[1:], "x", 2, None, "low"), ("formula", "r", *far, "x y", None, "M", None),
        ("formula", "", 12.0, *box[1:], "b c", 1, "N", "medium"), (None, None, float("nan"), *box[1:], None, None, None, None),
    ]
    for doc in (1, None):
        df = spark.createDataFrame([(doc, 1, i, *r, 9) for i, r in enumerate(rows)], ARTIFACTS)
        got = [(r.pos, r.type, r.text, r.n_lines, r.label, r.confidence, r.merged) for r in layout.merged_artifacts(df, ["doc", "page"], "pos").orderBy("pos").collect()]
        assert got == [(0, "formula", "a b c", 5, "L", "high", 3), (2, "code", "a b", 2, "", "low", 1), (3, "formula", "x", 2, "M", "low", 2), (6, "", "", 1, "", "", 1)]


def test_what_is_merged_takes_nothing_in(spark):
    # each box shares 0.95 with the next, so the second goes into the first, and the third, too far from that, stays
    rows = [(1, 1, i, "t", "", 5.0 * i, 0.0, 100.0, 10.0, f"t{i}", 1, "", "") for i in range(5)]
    got = layout.merged_artifacts(spark.createDataFrame(rows, ARTIFACTS.rsplit(",", 1)[0]), ["doc", "page"], "pos").orderBy("pos").collect()
    assert [(r.pos, r.text) for r in got] == [(0, "t0 t1"), (2, "t2 t3"), (4, "t4")]
    assert layout.merged_artifacts(spark.createDataFrame([], ARTIFACTS), ["doc", "page"], "pos").collect() == []
