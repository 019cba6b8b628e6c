"""Rule tables: scores and findings in Spark and in DuckDB."""

import duckdb
from pyspark.sql import functions as F

from leafmill.functions import scoring as S
from leafmill.functions import text as T
from leafmill.functions.dual import x


def both(spark, schema, rows, layers, cols):
    df = spark.createDataFrame(rows, schema)
    df.createOrReplaceTempView("scoring_rows")
    got = [tuple(r) for r in spark.sql(f"SELECT {', '.join(cols)} FROM {S.layered(x('scoring_rows'), layers).s} q").collect()]
    con = duckdb.connect()
    con.register("b", df.toPandas())
    names = ", ".join(f"CAST({f.name} AS {'VARCHAR' if f.dataType.simpleString() == 'string' else f.dataType.simpleString()}) AS {f.name}" for f in df.schema)
    duck = con.execute(f"SELECT {', '.join(cols)} FROM {S.layered(x(f'(SELECT {names} FROM b)'), layers).d} q").fetchall()
    assert duck == got
    return got


def test_crops(spark):
    rows = [(-12.0, -4.0, 720.0, 900.0, 612.0, 792.0, "figure", False, False), (90.0, 150.0, 360.0, 180.0, 612.0, 792.0, "figure", True, False), (35.0, 84.0, 545.0, 410.0, 612.0, 792.0, "figure", False, False), (10.0, 10.0, 5.0, 5.0, 612.0, 792.0, "formula", False, False)]
    got = both(spark, "x double, y double, width double, height double, page_width double, page_height double, kind string, refined boolean, algorithm boolean", rows, S.CROP, ["crop_width", "crop_height", "crop_score", "crop_confidence", "round(area, 3)", "round(wide, 3)", "round(high, 3)"])
    assert got[0][:2] == (612.0, 792.0) and got[1][2:] == (86, "high", 0.134, 0.588, 0.227) and [g[2] for g in got[2:]] == [28, 44]


def test_merge(spark):
    schema = "prev string, next string, prev_page long, next_page long, prev_section string, next_section string, continues boolean, bottom double, top double, manual boolean"
    rows = [
        ("The model is", "trained on data.", 3, 4, "m", "m", True, 0.9, 0.1, False), ("The model is", "trained on data.", 3, 4, "m", "e", False, None, None, False), ("It ends.", "A new one.", 3, 4, "m", "m", False, None, None, False),
        ("an exam-", "ple here", 3, 4, "m", "e", False, None, None, False), ("open", "text", 3, 5, "", "", False, None, None, False), ("open text", "Introduction", 3, 4, "", "", False, None, None, True),
    ]
    got = both(spark, schema, rows, S.MERGE, ["merged", "merge_score", "blocked", "stopped"])
    assert [g[0] for g in got] == [True, False, False, True, False, False]
    assert got[0][1] == 24 and got[1][3] == ["section-mismatch", "score-below-threshold"] and got[2][3] == ["no-text-continuation"] and got[4][2] == ["non-consecutive-page"] and got[5][2] == ["manual-edit", "next-section-opening"]


def test_verify(spark):
    schema = "source string, translation string, explanation string, covered boolean, told_all boolean, told_role boolean, told_reference boolean, confidence double"
    long = "One sentence here is long enough. Another sentence follows it now. A third sentence ends the paragraph. " * 3
    rows = [(long, long, "x" * 100 + " 方法. And more.", True, True, True, True, 0.9), (long, "brief", "", None, None, None, None, None), (long, "word " * 12, "generic words only", True, False, None, None, 0.2), ("", "", "", True, None, None, None, None)]
    got = both(spark, schema, rows, S.VERIFY, ["status", "issues"])
    assert got[0] == ("ok", []) and got[1] == ("error", ["coverage-missing", "translation-too-short", "explanation-missing", "translation-likely-summary"])
    assert got[2][1] == ["coverage-translation-incomplete", "coverage-low-confidence", "translation-too-short", "explanation-too-short", "translation-likely-summary", "explanation-one-generic-sentence", "section-role-not-evident"] and got[3][1] == ["translation-missing", "explanation-missing"]


def test_budget(spark):
    got = both(spark, "n long, tok long", [(2, 1200), (0, 0)], S.budget("n", "tok"), ["tokens_in", "tokens_out", "tokens_total", "usd"])
    assert got == [(2210, 2460, 4670, 0.0072), (0, 0, 0, 0.0)]
    assert both(spark, "n long, tok long", [(2, 1200)], S.budget("n", "tok", rate_in=0.3, rate_out=1.2), ["usd"]) == [(0.0036,)]


def test_text_lists(spark):
    df = spark.createDataFrame([("Alpha, beta；ALPHA\n x  y ,#Tag",)], "c string")
    c = x("c")
    assert tuple(df.select(T.keywords(c).col(), T.tags(c).col()).first()) == (["Alpha", "beta", "x y", "#Tag"], ["Alpha", "beta；ALPHA", "x y", "Tag"])
    refs = spark.createDataFrame([("See Figure 2a, fig. 2a and Table 3; eq. (4) and [1, 2] [1, 2].",)], "c string").select(T.reference_tokens(c).col()).first()[0]
    assert refs == ["Figure 2a", "Table 3", "eq. (4)", "[1, 2]"]
    row = spark.createDataFrame([("arXiv:2401.01234v2 [cs.LG] 3 Jan 2024 We show results such as",)], "c string").select(T.strip_metadata(c).col(), T.is_publication_metadata(c).col()).first()
    assert tuple(row) == ("We show results", False)
    meta = spark.createDataFrame([("ICML ’24, July 21-27, 2024, Vienna, Austria",), ("36th Conference on Things",), ("A plain line",)], "c string").select(T.is_publication_metadata(c).col()).collect()
    assert [m[0] for m in meta] == [True, True, False]
    heads = [("Scaling laws for neural language models", "Scaling Laws for Neural Language Models", 3), ("Scaling laws for neural language models", "Scaling Laws for Neural Language Models", 1), ("An unrelated line of text here", "Scaling Laws for Neural Language Models", 2)]
    h = spark.createDataFrame(heads, "c string, title string, page long").select(T.is_title_header(c, x("title"), x("page")).col(), F.lit(1)).collect()
    assert [r[0] for r in h] == [True, False, False]
    hints = spark.createDataFrame([("3.1 Method:",), ("body",), ("x",)], "c string").select(T.section_hint(c).col()).collect()
    assert [r[0] for r in hints] == ["Method", "", ""]
    kinds = spark.createDataFrame([("the loss function below",), ("this table",), ("as shown above",), ("none",)], "c string").select(T.cue_kind(c).col()).collect()
    assert [r[0] for r in kinds] == ["equation", "table", "figure", ""]
