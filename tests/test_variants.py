"""Layouts and stable JSON by VARIANT, on literal texts."""

import json

from pyspark.sql import functions as F

from leafmill.sources import variants


def test_stable_json(spark):
    texts = ['{"b": 1, "a": {"d": [1, {"z": null, "y": "\\u00e9"}], "c": true}}', '{"a":{"c":true,"d":[1,{"y":"é","z":null}]},"b":1}', " [ ] ", '"x"', "{", None, ""]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(variants.stable_json(F.col("t")).alias("v")).collect()]
    assert got == ['{"a":{"c":true,"d":[1,{"y":"é","z":null}]},"b":1}'] * 2 + ["[]", '"x"', None, None, None]


def regions(spark, *texts):
    df = spark.createDataFrame([(i, t if t is None or isinstance(t, str) else json.dumps(t), "k", 1.0) for i, t in enumerate(texts)], "id int, text string, kind string, x double")
    return [tuple(r) for r in variants.layout_regions(df, ["id"]).orderBy("id", "nth").collect()]


def test_regions(spark):
    layout = {
        "pages": [
            {"pageNumber": 1, "width": 100, "height": 200, "regions": [{"type": "Body ", "text": " a\n b ", "bbox": [-5, 10, 500, 20.12345], "confidence": 87}, {"role": "page_header", "x": 1, "top": 2, "w": 3, "height": 4, "id": "own", "confidence": -1}]},
            {"page": 2, "layoutRegions": [{"kind": "math", "left": 1, "y": 2, "width": 3, "h": 4, "content": "x", "order": 7, "confidence": 0.5}, {"type": "weird", "bbox": [1, 2, 3, 4]}, {"bbox": [1, 2, 0, 4]}]}, {"width": 3},
        ],
        "regions": [{"pageNumber": 1, "title": "T", "bbox": [1, 2, 3, 4]}, {"page": 9, "bbox": [1, 2, 3, 4]}, {"bbox": [1, 2, 3, 4]}],
    }
    want = [
        (0, 1, "paragraph", None, "a b", "", None, 0.87, 0.0, 10.0, 100.0, 20.123, None), (1, 1, "header-footer", "own", "", "", None, 0.0, 1.0, 2.0, 3.0, 4.0, None), (2, 2, "formula", None, "x", "", 7, 0.5, 1.0, 2.0, 3.0, 4.0, None),
        (3, 2, "weird", None, "", "", None, None, None, None, None, None, "type"), (4, 2, "paragraph", None, "", "", None, None, None, None, None, None, "box"), (5, 1, "paragraph", None, "", "T", None, None, 1.0, 2.0, 3.0, 4.0, None),
        (6, 9, "paragraph", None, "", "", None, None, None, None, None, None, "page"), (7, None, "paragraph", None, "", "", None, None, None, None, None, None, "page"),
    ]
    assert regions(spark, layout, {"layout": layout}) == [(i, *w) for i in (0, 1) for w in want]


def test_what_has_no_regions(spark):
    assert regions(spark, None, "", "no json", [], {"pages": "x", "regions": {"a": 1}}, {"layout": 3}, {"pages": []}) == []
    assert variants.layout_regions(spark.createDataFrame([], "id int, text string"), ["id"]).collect() == []
