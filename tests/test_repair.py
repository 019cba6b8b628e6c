"""Local repair of stored paragraphs: what changes, what stays, and that a second run changes nothing."""

import pytest

from leafmill.operators import repair, segmentation

STORED = "doc string, id string, ord long, kind string, page long, page_end long, text string, hidden boolean, manual boolean"
PROSE = "This part tells what was done with all of the samples and why it matters"


@pytest.fixture(scope="module")
def rows():
    return [
        ("a", "p0", 0, "heading", 1, 1, "1 Introduction", False, None), ("a", "p1", 1, "paragraph", 1, 1, f"{PROSE} for", False, False), ("a", "p2", 2, "paragraph", 1, 1, "readers who follow along.", None, False),
        ("a", "p3", 3, "paragraph", 1, 1, "12", False, False), ("a", "p4", 4, "paragraph", 1, 1, "and a paragraph edited by hand", False, True), ("a", "p5", 5, "paragraph", 2, 2, "hidden before", True, False),
        ("a", "p6", 6, "paragraph", 2, 2, f"{PROSE}  in  the end.", False, False), ("a", "p7", 7, "paragraph", 2, 2, f"{PROSE} in the end.", False, False), ("a", "p8", 8, "paragraph", 2, 2, None, False, False),
        ("b", "q0", 0, "paragraph", 1, 1, f"{PROSE} once.", False, False),
    ]


def run(spark, df, last=None):
    plan, zone = segmentation.planned_sections(spark.createDataFrame([("a", 1, "1 Introduction\ntext"), ("a", 2, "more")], "doc string, page long, text string"), ["doc"])
    return repair.repair(df, plan, zone, ["doc"], last)


def listed(df):
    return [(r.doc, r.id, r.ord, r.page_end, r.text, r.hidden, r.status) for r in df.orderBy("doc", "ord").collect()]


def test_repair(spark, rows):
    got = listed(run(spark, spark.createDataFrame(rows, STORED).selectExpr("*", "'x' AS status", "1 AS run", "'y' AS fingerprint")))
    assert got == [
        ("a", "p0", 0, 1, "1 Introduction", False, "same"), ("a", "p1", 1, 1, f"{PROSE} for readers who follow along.", False, "changed"), ("a", "p3", 2, 1, "12", True, "hidden"), ("a", "p4", 3, 1, "and a paragraph edited by hand", False, "untouched"),
        ("a", "p5", 4, 2, "hidden before", True, "untouched"), ("a", "p6", 5, 2, f"{PROSE} in the end.", False, "changed"), ("a", "p7", 6, 2, f"{PROSE} in the end.", True, "hidden"), ("a", "p8", 7, 2, "", True, "hidden"), ("b", "q0", 0, 1, f"{PROSE} once.", False, "same"),
    ]


def test_a_second_run_changes_nothing(spark, rows):
    once = spark.createDataFrame(run(spark, spark.createDataFrame(rows, STORED)).collect())
    last = repair.fingerprints(once, ["doc"])
    again = run(spark, once.drop("status"), last)
    assert [r[:6] for r in listed(again)] == [r[:6] for r in listed(once)] and {r[6] for r in listed(again)} == {"untouched"}
    # a changed document is looked at again, the other isn't
    edited = once.drop("status").selectExpr("* EXCEPT (text)", "CASE WHEN id = 'q0' THEN 'too short' ELSE text END AS text")
    assert {(r[0], r[6]) for r in listed(run(spark, edited, last))} == {("a", "untouched"), ("b", "hidden")}


def test_empty(spark):
    empty = spark.createDataFrame([], STORED)
    assert run(spark, empty).collect() == [] and repair.fingerprints(empty, ["doc"]).collect() == []


def test_kept_paragraphs_are_written_once(spark, rows, tmp_path):
    """They are merged, and what isn't among them is hidden: both read one table."""
    pages = spark.createDataFrame([("a", 1, "1 Introduction\ntext"), ("a", 2, "more")], "doc string, page long, text string")
    df, names = spark.createDataFrame(rows, STORED), []

    def write(kept, name):
        names.append(name)
        kept.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = repair.repair(df, *segmentation.planned_sections(pages, ["doc"]), ["doc"], write=write)
    assert names == ["kept"] and listed(got) == listed(run(spark, df))
