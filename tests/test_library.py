"""Sources, folds, boxes, text functions and streams on literal rows."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import x
from leafmill.operators import boxes, ordered
from leafmill.sources import layout
from leafmill.streaming import jobs

LAYOUT = """<doc><page width="300" height="200"><flow>
<block xMin="72" yMin="40" xMax="235" yMax="62"><line><word xMin="72" yMin="40" xMax="130" yMax="62">Fixture</word><word>title</word></line></block>
<block><line><word xMin="72" yMin="68" xMax="100" yMax="90">Alpha</word> <word xMin="104" yMin="68" xMax="110" yMax="90">&amp;</word></line><line><word xMin="70" yMin="92" xMax="245" yMax="99">&lt;Gamma&gt;</word></line></block>
<block><line><word>  </word></line></block></flow></page><page width="10" height="20"></page></doc>"""


def test_layout(spark):
    got = layout.parse_layout(spark.createDataFrame([("a", LAYOUT), ("b", None), ("c", "")], "path string, xml string")).orderBy("block_idx").collect()
    assert [(r.path, r.page_number, r.text, r.x, r.y, r.w, r.h, r.line_count) for r in got] == [("a", 1, "Fixture title", 72, 40, 163, 22, 1), ("a", 1, "Alpha & <Gamma>", 70, 68, 175, 31, 2)]


def test_papers(spark, tmp_path):
    paper = {"id": "p", "title": "t", "paragraphs": [{"id": "1", "kind": "heading", "sourceText": "H"}, {"id": "2", "order": 7, "sourceText": "x", "translation": "y"}]}
    (tmp_path / "a.json").write_text(json.dumps(paper))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"id": "no paragraphs"}))
    head, body = layout.flatten(layout.read_papers(spark, str(tmp_path))[0])
    assert [(r.paper_id, r.paragraph_count, r.analyzed_count) for r in head.collect()] == [("p", 2, 1)]
    assert [(r.paragraph_id, r.ord, r.kind) for r in body.orderBy("ord").collect()] == [("1", 0, "heading"), ("2", 7, "paragraph")]
    assert layout.markdown(body).first().markdown == "## H\n\nx"
    new = spark.createDataFrame([("p", "9", "paragraph", 0, 1, "z")], body.schema)
    assert [r.paragraph_id for r in layout.replace_children(body, new, "paper_id").collect()] == ["9"]
    assert layout.upsert(body, new, ["paper_id", "paragraph_id"]).count() == 3


def test_chunks_and_merges(spark):
    sizes = [5000, 3000, 1000, 8000, 10, 10, 10, 10]
    df = spark.createDataFrame([("d", i, n) for i, n in enumerate(sizes)], "doc string, pos long, n long")
    assert [r.chunk for r in ordered.greedy_chunks(df, ["doc"], "pos", "n", 3, 8500).orderBy("pos").collect()] == [0, 0, 1, 2, 2, 2, 3, 3]
    parts = [("d", 0, "An exam-", 1), ("d", 1, "ple of text", 2), ("d", 2, "that goes on.", 2), ("d", 3, "next", 2), ("d", 4, "", 2), ("d", 5, "far", 9)]
    got = ordered.merge_fragments(spark.createDataFrame(parts, "doc string, pos long, line string, page long"), ["doc"], "pos", "line", "page").orderBy("pos").collect()
    assert [(r.pos, r.page_end, r.text, r.n) for r in got] == [(0, 2, "An example of text that goes on.", 3), (3, 2, "next", 1), (5, 9, "far", 1)]


def test_boxes(spark):
    b = "struct<x:double,y:double,width:double,height:double>"
    row = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 5.0, 10.0, 20.0))], f"a {b}, b {b}")
    a, c = F.col("a"), F.col("b")
    got = row.select(boxes.overlap_of_own(a, c), boxes.overlap_of_smaller(c, a), boxes.symmetric_overlap(a, c), boxes.axis_gap(a, c, "x", "width"), boxes.vertical_distance(a, c), boxes.clamp(c, F.lit(12.0), F.lit(9.0))).first()
    assert tuple(got)[:5] == (0.25, 0.25, 0.125, 0.0, 2.0) and tuple(got[5]) == (5, 5, 7, 4)
    blocks = [("d", 0, 0.0, 0.0, 10.0, 10.0), ("d", 1, 12.0, 0.0, 10.0, 10.0), ("d", 2, 24.0, 5.0, 2.0, 2.0), ("d", 3, 0.0, 90.0, 1.0, 1.0)]
    df = spark.createDataFrame(blocks, "doc string, block long, x double, y double, width double, height double")
    assert [r.cluster for r in boxes.grow_clusters(df, ["doc"], 3.0).orderBy("block").collect()] == [0, 0, 0, 1]


CASES = [
    ("Figure 2a: An overview", {"caption"}), ("Fig. 7 shows", set()), ("[12] A. Author, Title", {"bibliography"}), ("3 / 12", {"page_header"}), ("page 4 of 9", {"page_header"}), ("Smith et al.", {"page_header"}),
    ("References", {"references_title"}), ("4. Bibliography:", {"references_title"}), ("a@b.org, c@d.org", {"author"}), ("https://github.com/x/y", {"link"}), ("Copyright held by the owner", {"metadata"}),
    ("model mae mse 0.1 0.2 | 0.3", {"table_body"}), ("A plain sentence, with été and naïve words.", set()), ("x\x01 garbage in a line of text here", {"garbage"}), ("", set()),
]


@pytest.mark.parametrize("line,want", CASES)
def test_noise(spark, line, want):
    df = spark.createDataFrame([(line, 1)], "line string, page long")
    reasons = T.noise_reasons(x("line"), x("page"), x("1"))
    got = df.select(*[e.col().alias(k) for k, e in reasons.items()]).first().asDict()
    assert {k for k, v in got.items() if v} == want
    duck = duckdb.connect().execute("SELECT " + ", ".join(f"{e.d}" for e in reasons.values()) + " FROM (SELECT ? AS line, 1 AS page)", [line]).fetchone()
    assert list(duck) == list(got.values())


@pytest.mark.parametrize("label,key", [("Fig. 7(b)", "figure:7b"), ("Figure 2a", "figure:2a"), ("TABLE 3:", "table:3"), ("Equation (4)", "equation:4"), ("Appendix A", ""), ("eq. 05", "equation:5")])
def test_labels(spark, label, key):
    assert spark.createDataFrame([(label,)], "c string").select(T.label_key(x("c")).col()).first()[0] == key


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 5} 10:00:0{i % 7}", i % 4, ["view", "click", "purchase", "other"][i * 7 % 4]) for i in range(60)]
    log = spark.createDataFrame(rows, "event_id long, t string, user_id long, event_type string").withColumn("ts", F.to_timestamp("t")).drop("t")
    path = str(tmp_path / "log.parquet")
    log.repartition(5).write.parquet(path)
    stream = jobs.drain(jobs.latest_status(jobs.read_log(spark, path)), "latest_stream", "update").collect()
    final = {r.user_id: (r.event_id, r.status) for r in stream}
    batch = {r.user_id: (r.event_id, r.status) for r in jobs.latest_status_batch(spark.read.parquet(path)).collect()}
    assert final == batch
    counts = jobs.drain(jobs.windowed_counts(jobs.read_log(spark, path)), "counts_stream", "complete")
    assert sum(r.n for r in counts.collect()) == 60
