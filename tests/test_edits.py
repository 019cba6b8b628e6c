"""Edits, digests, contexts and calls by chunks on literal rows."""

import pandas as pd
from pyspark.sql import functions as F

from leafmill.operators import edits, providers

PARAGRAPHS = "doc string, ord long, kind string, text string, section string, eligible boolean, analysis string"
EDITS = "doc string, ord long, at long, action string, first string, second string, section string"


def test_paragraph_edits(spark):
    rows = [("d", i, "heading" if i == 4 else "paragraph", f"t{i}" if i else "cut-", "s", True, "done") for i in range(9)]
    ed = [("d", 0, 1, "restore", None, None, None), ("d", 0, 2, "merge-next", None, None, None), ("d", 2, 1, "mark-noise", None, None, None), ("d", 3, 1, "merge-next", None, None, None), ("d", 4, 1, "mark-noise", None, None, None),
          ("d", 5, 1, "split", " a ", "b", None), ("d", 6, 1, "split", " ", "b", None), ("d", 7, 1, "set-section", None, None, "new"), ("d", 8, 1, "merge-next", None, None, None), ("d", 99, 1, "restore", None, None, None), ("e", 1, 1, "unknown", None, None, None)]
    got = edits.edit_paragraphs(spark.createDataFrame(rows, PARAGRAPHS), spark.createDataFrame(ed, EDITS)).orderBy("ord", "part").collect()
    assert [(r.ord, r.part, r.text, r.state) for r in got] == [(0, 0, "cutt1", "merge-next"), (2, 0, "t2", "mark-noise"), (3, 0, "t3", "refused"), (4, 0, "t4", ""), (5, 0, "a", "split"), (5, 1, "b", "split"), (6, 0, "t6", "refused"), (7, 0, "t7", "set-section"), (8, 0, "t8", "refused")]
    by = {(r.ord, r.part): r for r in got}
    assert not by[2, 0].eligible and by[7, 0].section == "new" and [k for k, r in by.items() if r.analysis] == [(3, 0), (4, 0), (6, 0), (8, 0)]


def test_runs_of_merges(spark):
    rows = [("d", i, "paragraph", f"t{i}", "s", True, None) for i in range(5)]
    ed = [("d", i, 1, "merge-next", None, None, None) for i in (0, 1, 2)]
    got = edits.edit_paragraphs(spark.createDataFrame(rows, PARAGRAPHS), spark.createDataFrame(ed, EDITS)).orderBy("ord").collect()
    assert [r.text for r in got] == ["t0 t1", "t2 t3", "t4"]


def test_artifact_edits(spark):
    rows = [(1, "formula", "x", "L", False, 1.0, 2.0, 3.0, 4.0), (2, "code", "y", "M", True, 1.0, 2.0, 3.0, 4.0)]
    art = spark.createDataFrame(rows, "artifact_id long, type string, text string, label string, hidden boolean, x double, y double, width double, height double")
    ed = spark.createDataFrame(
        [(1, 1, "hide", None, None, None, None, None), (1, 2, "restore", None, None, None, None, None), (1, 1, "set-text", "", None, None, None, None), (1, 1, "set-type", "", None, None, None, None), (1, 3, "set-crop", None, 9.0, 9.0, 9.0, 9.0)],
        "artifact_id long, at long, action string, value string, x double, y double, width double, height double",
    )
    got = {r.artifact_id: r for r in edits.edit_artifacts(art, ed).collect()}
    assert (got[1].type, got[1].text, got[1].label, got[1].hidden, got[1].x, got[1].height, list(got[1].edited)) == ("formula", "", "L", False, 9.0, 9.0, ["restore", "set-crop", "set-text"])
    assert (got[2].hidden, got[2].x, list(got[2].edited)) == (True, 1.0, [])


def test_digests_and_contexts(spark):
    par = spark.createDataFrame([("d", "a", 2, "beta alpha"), ("d", "a", 1, "alpha"), ("d", "b", 3, None)], "doc string, section string, ord long, text string")
    art = spark.createDataFrame([("d", "a", "f1", "formula"), ("d", "a", "t1", "table"), ("d", "a", "f1", "formula")], "doc string, section string, artifact_id string, kind string")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    got = {r.section: r for r in edits.section_digests(par, art, ["doc", "section"], words, F.array().cast("array<string>")).collect()}
    assert (got["a"].members, list(got["a"].terms), list(got["a"].formulas), list(got["a"].visuals)) == (2, ["alpha", "beta"], ["f1"], ["t1"]) and list(got["b"].formulas) == []
    again = edits.section_digests(par.orderBy("ord").withColumn("text", F.upper("text")), art, ["doc", "section"], words, words).collect()
    assert {r.section: r.fingerprint for r in again}["a"] != got["a"].fingerprint
    sec = spark.createDataFrame([("d", "a", "Intro", "s" * 400)], "doc string, section string, title string, summary string")
    ctx = {r.ord: r.context for r in edits.paragraph_context(par, sec, ["doc"]).collect()}
    assert ctx[1] == "Section: Intro\n\nSummary: " + "s" * 299 + "…\n\nAfter: beta alpha" and ctx[3] == "Before: beta alpha"


def test_calls_by_chunks(spark):
    rows = spark.createDataFrame([("d", i) for i in range(7)] + [("e", 0)], "doc string, page long")

    def call(frame):
        if (frame["page"] == 4).any():
            raise TimeoutError("slow")
        return pd.DataFrame({"text": [f"{len(frame)}:{p}" for p in frame["page"]]})

    local = lambda frame: pd.DataFrame({"text": [f"local {p}" for p in frame["page"]]})
    got = providers.call_by_chunks(rows, ["doc"], "page", 3, call, local, "text string")
    assert sorted((r.doc, r.first, r.last, r.text, r.source) for r in got.collect()) == sorted(
        [("d", 0, 2, f"3:{i}", "call") for i in range(3)] + [("d", 3, 5, "1:3", "call"), ("d", 3, 5, "local 4", "fallback"), ("d", 3, 5, "1:5", "call"), ("d", 6, 6, "1:6", "call"), ("e", 0, 0, "1:0", "call")]
    )
    assert [r.reason for r in got.filter("source = 'fallback'").collect()] == ["TimeoutError: slow"]
    new = got.filter("first = 3").withColumn("text", F.lit("new"))
    assert providers.merge_chunks(got, new, ["doc"]).filter("text = 'new'").count() == 3 and providers.merge_chunks(got, new, ["doc"]).count() == 8
