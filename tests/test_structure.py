"""Sections from headings, batched calls of external functions."""

import pandas as pd

from leafmill.operators import providers, structure


def test_sections(spark):
    rows = [
        ("a", 1, 0, "Abstract"), ("a", 1, 1, "some prose of the paper."), ("a", 2, 2, "2. Method"), ("a", 2, 3, "1. Introduction"), ("a", 3, 4, "2. Method"), ("a", 4, 5, "2. Method"), ("a", 5, 6, "3.10 Data"), ("a", 5, 7, "3.9 Setup"),
        ("a", 7, 8, "References"), ("a", 7, 9, "Appendix"), ("a", 8, 10, "[1] x"), ("b", 1, 0, "no heading here"), ("c", 4, 0, None), ("c", 4, 1, "Results"),
    ]
    df = spark.createDataFrame(rows, "doc string, page long, pos long, text string")
    got = [tuple(r) for r in structure.infer_sections(df, ["doc"]).orderBy("doc", "ord").collect()]
    assert got == [
        ("a", 0, "Abstract", 1, 1), ("a", 1, "Introduction", 2, 2), ("a", 2, "Method", 2, 3), ("a", 3, "Method", 4, 4), ("a", 4, "Setup", 5, 5), ("a", 5, "Data", 5, 6), ("c", 0, "Results", 4, 4),
    ]


def test_spaced(spark):
    df = spark.createDataFrame([("k", v) for v in (1, 2, 3, 3, 4, 7, 8)], "k string, v long")
    assert sorted(r.v for r in structure.spaced(df, ["k"], "v", 1).collect()) == [1, 3, 7]


def test_batched_calls(spark):
    def call(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"] == "bad").any():
            raise ValueError("bad row")
        out = batch[batch["text"] != "silent"]
        return pd.DataFrame({"id": out["id"], "answer": out["text"].str.upper(), "n": out["text"].str.len()})

    rows = [(i, "bad" if i == 7 else "silent" if i == 11 else f"t{i}") for i in range(40)]
    got = {r.id: r for r in providers.call_in_batches(spark.createDataFrame(rows, "id long, text string").coalesce(1), "id", call, "answer string, n long").collect()}
    assert len(got) == 40 and got[7].status == "error" and got[7].error == "ValueError: bad row" and got[11].status == "missing" and got[11].answer is None
    assert all(got[i].status == "done" and got[i].answer == f"T{i}" and got[i].n == len(f"t{i}") for i in range(40) if i not in (7, 11))
    assert got[39].calls == 1 and 2 <= got[6].calls <= 5


def test_reuse_of_results(spark):
    rows = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "id long, fp string")
    stored = spark.createDataFrame([(1, "f1", "x"), (2, "old", "y")], "id long, fp string, answer string")
    assert sorted(r.id for r in providers.unanswered(rows, stored, "id", "fp").collect()) == [2, 3]
    new = spark.createDataFrame([(2, "f2", "Y", "done"), (1, "f9", None, "error")], "id long, fp string, answer string, status string")
    assert sorted(tuple(r) for r in providers.latest_results(stored, new, "id").collect()) == [(1, "f1", "x"), (2, "f2", "Y")]


def test_references_titles_are_found_behind_the_quick_look(spark):
    from leafmill.functions import text as T
    from leafmill.functions.dual import x

    texts = ["References", "7. REFERENCES :", " 3.1  Bibliography.", "参考文献：", "References and notes", "Reference s", "see references", "9 References", "", None, "1 2 References"]
    got = [r.v for r in spark.createDataFrame([(v,) for v in texts], "c string").select(T.is_references_title(x("c")).col().alias("v")).collect()]
    assert got == [True, True, True, True, False, False, False, True, False, None, False]
    assert T.is_references_title(x("c")).s.count("regexp_replace(c,") <= 1
