"""Loose JSON, packages, uploads and SQLite tables."""

import io
import json
import sqlite3
import zipfile
from xml.etree import ElementTree

from leafmill.sources import packages, regions


def test_items_of_answers(spark):
    items = [{"paragraphId": "p1", "t": 1}]
    for text in (json.dumps(items), json.dumps({"items": items}), "Sure:\n```json\n" + json.dumps({"results": items}) + "\n```", json.dumps({"p1": {"t": 1}, "note": "x"}), json.dumps({"paragraphs": [*items, "x", 3]})):
        assert regions.items_of(text) == items
    assert all(regions.items_of(t) == [] for t in ("", None, "no", "{broken", "[1]", "3", "{" * 9999))
    df = spark.createDataFrame([(1, json.dumps({"items": [{"id": 7, "b": "é", "a": None}]})), (2, None)], "k long, text string")
    assert [tuple(r) for r in regions.model_items(df, ["k"]).collect()] == [(1, "7", '{"a":null,"b":"é","id":7}')]


def test_regions(spark):
    r = regions.region_of({"type": " Chart", "bbox": [10, 20, 700, 30], "probability": 44, "label": "Fig 1!"}, 3, 612, 792, 2)
    assert r == {"id": "model_3_fig_1_2", "kind": "figure", "label": "Fig 1!", "x": 10, "y": 20, "width": 602, "height": 30, "score": 0.44, "confidence": "low"}
    assert regions.region_of({"type": "table", "left": 1, "top": "2", "w": 3, "h": 4}, 1, 612, 792, 1)["confidence"] == "high"
    for bad in ({"type": "map", "bbox": [0, 0, 1, 1]}, {"type": "table"}, {"type": "table", "bbox": [0, 0, -1, 1]}, {"type": "table", "bbox": [0, 0, "x", 1]}, {"type": "table", "bbox": [700, 0, 5, 5]}, {"type": "table", "bbox": [float("nan"), 0, 5, 5]}, {"type": "table", "bbox": [1, 2]}):
        assert regions.region_of(bad, 1, 612, 792, 1) is None
    df = spark.createDataFrame([(1, 2, 612.0, 792.0, json.dumps({"regions": [{"type": "math", "box": [1, 1, 5, 5]}, 3]})), (2, 1, None, None, "[]"), (3, 1, 612.0, 792.0, None)], "k long, page long, width double, height double, regions string")
    assert [(r.k, r.kind, r.score) for r in regions.page_regions(df, ["k"]).collect()] == [(1, "formula", None)]


def test_layouts(spark):
    doc = {"layout": {"pages": [{"page": 2, "width": 600, "height": 800}, {"number": 1, "w": 600, "h": 800}, {"page": 3}], "structure": {"sections": [{"name": " A  b ", "page": 2}, {}]}, "regions": [{"type": "paragraph", "page": 1, "bbox": [0, 0, 5, 5], "text": " x\ny "}, {"type": "fig", "page": 2, "bbox": [0, 0, 5, 5]}, {"page": 9}, {"page": 1}]}}
    got = regions.layout_of(json.dumps(doc))
    assert [p["page"] for p in got["pages"]] == [1, 2] and got["sections"] == [{"title": "A b", "start_page": 2, "end_page": 2}] and [r["kind"] for r in got["regions"]] == ["paragraph", "figure"]
    assert got["paragraphs"] == [{"ord": 0, "page": 1, "text": "x y"}] and got["status"] == "warn" and len(got["warnings"]) == 4
    assert regions.layout_of(None)["status"] == "ok" and regions.layout_of("[1]")["pages"] == []
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, None)], "k long, text string")
    assert [(r.k, r.text, r.n_regions) for r in regions.layout_paragraphs(df, ["k"]).collect()] == [(1, "x y", 2)]


def test_docx(spark):
    rows = [("a", 2, "paragraph", "x < y & z\nnext\x01"), ("a", 1, "heading", "Title é"), ("b", 0, "paragraph", None)]
    df = spark.createDataFrame(rows, "paper_id string, ord long, kind string, source_text string")
    got = {r.paper_id: bytes(r.docx) for r in packages.docx(df, "paper_id").collect()}
    z = zipfile.ZipFile(io.BytesIO(got["a"]))
    assert z.testzip() is None and set(z.namelist()) == {"[Content_Types].xml", "_rels/.rels", "word/document.xml"}
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    paragraphs = [[t.text for t in p.iter(f"{w}t")] for p in ElementTree.fromstring(z.read("word/document.xml")).iter(f"{w}p")]
    assert paragraphs == [["Title é"], ["x < y & z", "next"]] and got["b"] == packages.docx_bytes([("paragraph", "")])


def test_multipart(spark):
    body = b'--b\r\nContent-Disposition: form-data; name="f"; filename="a.PDF"\r\nContent-Type: application/pdf\r\n\r\n%PDF\r\n--x\r\n\x00\r\n--b\r\nContent-Disposition: form-data; name="n"\r\n\r\nv\r\n--b\r\nContent-Disposition: form-data; name="g"; filename="b.txt"\r\n\r\n\r\n--b--\r\nrest'
    parts = packages.multipart(body, "b")
    assert [(p["name"], p["filename"], p["data"]) for p in parts] == [("f", "a.PDF", b"%PDF\r\n--x\r\n\x00"), ("n", "", b"v"), ("g", "b.txt", b"")]
    assert packages.multipart(b"", "b") == [] and packages.multipart(b"--b\r\nno headers", "b") == []
    df = spark.createDataFrame([(1, body, "b"), (2, None, None)], "k long, body binary, boundary string")
    assert sorted((r.k, r.filename, r.status, r["size"]) for r in packages.uploads(df, ["k"]).collect()) == [(1, "a.PDF", "ok", 12), (1, "b.txt", "wrong-type", 0)]
    assert [r.status for r in packages.uploads(df, ["k"], most_bytes=3).collect()] == ["too-large", "wrong-type"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "p.sqlite")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE papers (id TEXT, favorite INTEGER, updated_at TEXT, created_at TEXT)")
        c.execute("CREATE TABLE none (id TEXT)")
        c.executemany("INSERT INTO papers VALUES (?, ?, ?, ?)", [(f"p{i}", i % 2, f"2024-01-{i % 5 + 1:02d}", f"2023-01-{i + 1:02d}") for i in range(20)] + [(None, 0, None, None)])
    df = packages.read_sqlite(spark, path, "papers", "id string, favorite int, updated_at string, created_at string")
    assert df.count() == 21 and df.filter("id IS NULL").count() == 1 and df.rdd.getNumPartitions() == 4
    assert [r.id for r in packages.papers_in_order(df).limit(3).collect()] == ["p19", "p9", "p13"]
    assert packages.read_sqlite(spark, path, "none", "id string").count() == 0
