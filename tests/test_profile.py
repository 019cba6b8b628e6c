"""Context profiles: order, first spellings, bounds."""

from leafmill.operators import profile

PARTS = "paper string, priority int, place long, keywords string, summary string, word string, nth int"


def test_profile(spark):
    rows = [
        ("a", 1, 5, "Graph, tree; NODE", "Third  text"), ("a", 0, 9, "node, Edge", "Second"), ("a", 0, 2, None, " \n"), ("a", 0, 3, "tree", "First"), ("a", 2, 0, "x" * 81 + ", last", None),
        (None, 0, 0, "own", "s"), ("b", 0, 0, None, None), ("c", 0, 0, ",".join(f"k{i}" for i in range(30)), "w " * 600), ("c", 0, 1, "z", "never seen, as the first is long"),
    ]
    got = {r.paper: (r.keywords, r.summary) for r in profile.context_profile(spark.createDataFrame([(*r, "w", 1) for r in rows], PARTS), ["paper"]).collect()}
    assert got["a"] == (["tree", "node", "Edge", "Graph", "last"], "First Second Third text") and got[None] == (["own"], "s") and got["b"] == ([], "")
    assert got["c"][0] == [f"k{i}" for i in range(24)] and len(got["c"][1]) <= 902 and got["c"][1].endswith("w...")
    assert profile.context_profile(spark.createDataFrame([], PARTS), ["paper"]).collect() == []


def test_six_summaries(spark):
    rows = [("a", 0, i, "", f"s{i}", "w", 1) for i in range(9)]
    assert profile.context_profile(spark.createDataFrame(rows, PARTS), ["paper"]).first().summary == "s0 s1 s2 s3 s4 s5"
