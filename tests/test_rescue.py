"""Rescue of body text from mixed blocks, on literal blocks."""

import pytest

from leafmill.operators import rescue

BODY = "However, the proposed method keeps the accuracy of the model in every setting that we tried here."
LINE = "This design was built for the training of models, and the results were good throughout."


def run(spark, lines, page=1, text=None):
    made = [("d", i, v, 0.0, 12.0 * i, 100.0, 10.0) if isinstance(v, str) or v is None else ("d", i, *v) for i, v in enumerate(lines)]
    blocks = spark.createDataFrame([("d", page, "\n".join(r[2] or "" for r in made) if text is None else text, "x")], "doc string, page int, text string, noise string")
    rows = spark.createDataFrame(made, "doc string, line int, text string, x double, y double, width double, height double")
    return [(r.nth, r.reason[12:], r.text, r.start, r.end, r.n_lines, r.y, r.height) for r in rescue.rescue(blocks, rows, ["doc"]).orderBy("nth").collect()]


MAIL = "someone@place.edu and other@place.edu"


@pytest.mark.parametrize(
    ("lines", "want"),
    [
        # noise, then body; a line that goes on stays in, one that says nothing ends it, and the next begins another
        ([MAIL, BODY, "and goes on in lower case with a few more words", "Short Words", LINE], [(f"{BODY} and goes on in lower case with a few more words", 2), (LINE, 1)]),
        # body before any noise isn't taken; noise in between cuts
        ([LINE, MAIL, LINE + " One.", "Keywords: a, b", LINE + " Two."], [(LINE + " One.", 1), (LINE + " Two.", 1)]),
        # a line that only goes on begins nothing
        (["goes on but nothing is there to go on from, so it is left", MAIL, "goes on but nothing is there to go on from, so it is left", BODY], [(BODY, 1)]),
        # measured results need 45 characters
        ([MAIL, "12.5 % reduction of cost.", "It gives a 12.5 % reduction of cost over all of the earlier systems that we know about today."], [("It gives a 12.5 % reduction of cost over all of the earlier systems that we know about today.", 1)]),
    ],
)
def test_lines(spark, lines, want):
    got = run(spark, lines)
    assert [(t, n) for _, _, t, _, _, n, _, _ in got] == want and [g[0] for g in got] == list(range(len(want)))
    whole = " ".join(lines)
    assert all(whole[s : s + 20] == t[:20] and e == s + len(t) for _, _, t, s, e, _, _, _ in got)


def test_boxes_and_lines_without(spark):
    got = run(spark, [MAIL, (BODY, 5.0, 20.0, 50.0, 10.0), ("and it goes on for a while in this box", 1.0, 35.0, 50.0, 9.0), (BODY, 0.0, 50.0, 0.0, 10.0), (BODY, float("nan"), 50.0, 1.0, 10.0), None])
    assert [(t, n, y, h) for _, _, t, _, _, n, y, h in got] == [(f"{BODY} and it goes on for a while in this box", 2, 20.0, 24.0)]


def test_text_branch(spark):
    head = "A Title of Some Length by A. Author and B. Author, University of Somewhere, Department of Things, a.author@some.edu "
    got = run(spark, [], text=head + "some words. " + BODY + " More of it follows here. Keywords: left, out")
    assert got == [(0, "body-tail", f"{BODY} More of it follows here.", len(head) + 12, len(head) + 12 + len(BODY) + 25, None, None, None)]
    # an opening before the last address doesn't count, one inside a word neither
    assert run(spark, [], text=BODY + " then " + "x" * 60 + " a.b@c.org and no more text after it.") == []
    assert run(spark, [], text=head + "xHowever, it is all one long sentence of many letters and words, in which no other opening stands.") == []


def test_nothing_to_rescue(spark):
    assert run(spark, [MAIL, "short"]) == [] and run(spark, [LINE] * 3) == [] and run(spark, [None]) == []
    places = ["University of A, Institute of B, College of C", LINE, LINE + " Second."]
    assert len(run(spark, places)) == 1 and run(spark, places, page=3) == []
    empty = spark.createDataFrame([], "doc string, page int, text string, line int, x double, y double, width double, height double")
    assert rescue.rescue(empty, empty, ["doc"]).collect() == []
