"""LaTeX repair and names of formula signs, on literal texts."""

import pytest

from leafmill.functions import latex as L
from leafmill.functions.dual import x
from leafmill.operators import latex

BROKEN = "x 1\n:\n=\ny , { a }\n\\ alpha"


def mended(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "1 AS run", "2 AS pos", "'x' AS line")
    return [(r.text, r.n_formulas) for r in latex.repair(df, ["id"]).orderBy("id").collect()]


def test_repair(spark):
    got = mended(
        spark, f"A line of prose, with words beyond ASCII: é.\n{BROKEN}\nAnd é again.", f"é\r\n{BROKEN}\r\né\r\n{BROKEN}", "a\n=", None, "", "x\n=\n1", "one word more here\ntwo words more here\nx =\n1\n+\n2", "这\nx\n=\n1\n中\n2",
        "y\n=\n" + "long expression that is too long for a shard of a formula\n" * 4 + "z",
    )
    assert got == [
        ("A line of prose, with words beyond ASCII: é.\n$x_{1}:=y,{a}\\alpha$\nAnd é again.", 1), ("é\n$x_{1}:=y,{a}\\alpha$\né\n$x_{1}:=y,{a}\\alpha$", 2), ("a\n=", 0), (None, 0), ("", 0), ("x\n=\n1", 0),
        ("one word more here\ntwo words more here\nx =\n1\n+\n2", 0), ("这\nx\n=\n1\n中\n2", 0), ("y\n=\n" + "long expression that is too long for a shard of a formula\n" * 4 + "z", 0),
    ]
    again = mended(spark, *[t for t, _ in got])
    assert again == [(t, 0) for t, _ in got]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("𝑥𝑡+1 = log ( θ )", "xt+1=\\log ( \\theta )"), ("WQL + FP8", "\\mathrm{WQL}+\\mathrm{FP8}"), ("xmax , smin", "x_{\\mathrm{max}},s_{\\mathrm{min}}"), ("a1:t − b2", "a_{1:t}-b_{2}"), ("ℓ≤𝟗", "\\ell≤9"), ("hL+1", "h_{L+1}"), ("", ""),
    ],
)
def test_formula_names(spark, text, want):
    assert spark.createDataFrame([(text,)], "c string").select(L.formula_latex(x("c")).col().alias("v")).first().v == want


def test_empty(spark):
    assert latex.repair(spark.createDataFrame([], "id int, text string"), ["id"]).collect() == []
