"""Patterns as they are rewritten for Spark find what they find as they are spelled."""

import pytest

from leafmill.functions import blocks, merging
from leafmill.functions import dual as D
from leafmill.functions import text as T

LOOK = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
PATTERNS = [
    r"(?i)\b(?:ab|c\d+|e\.g\.,?|©)\b", r"(?i)\b(?:ab|cd)s?\b", r"\b\d+(?:[.,]\d+)*%?\b", r"[^\s-]+@[\w.]+", r"(?:^|\s)[|:](?:\s|$)", r"(?i)(?:->|→|\bto\b)", r"[a-c≤α-ω^-]+", r"\bp(?:_?\{?x\}?)?\b", "[=≤≥≈∈~]", r"(?i)x?y\b|z",
    T.VENUE_DATE_PLACE, T.ARXIV_STAMP, blocks.EQUATION, blocks.CONNECTOR, blocks.DIAGRAM, merging.INPUT_NUMBERED, "(?i)" + T.URL,
]
TEXTS = [
    "", "ab", "AB, c12 abs cabs _ab ab_ éab abé", "x©x © a©", "e.g. e.g.,z", "1,2.5% 3% a4 5_ ５", "a@b.c d@e　f@g h@", " | a:b :\n|", "to -> TO→tot ſ to", "a-^≤β😀γ é", "p p_ px p{x} p_{x}q", "a = b, c ≤ 2 ∈ α~", "xY zy yx",
    "ICML '24, May 3-5, 2024, Vienna, Austria. arXiv:2401.12345v2 [cs.CL] 3 Jan 2024 end", "2.1 Our Way", "see https://a.b/c d www.x", "İı K ai Graph",
]


@pytest.mark.parametrize("p", PATTERNS)
def test_rewritten_patterns_find_the_same(spark, p):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(TEXTS)] + [(-1, None)], "i int, v string")
    plain = D._spelled(p).replace(r"\b", LOOK)
    both = [f"regexp_replace(v, r'{plain}', '<$0>') AS a, {D.replace(D.x('v'), p, '<$0>').s} AS b", f"CAST(regexp_count(v, r'{plain}') AS BIGINT) AS a, {D.count(D.x('v'), p).s} AS b", f"v rlike r'{plain}' AS a, {D.matches(D.x('v'), p).s} AS b"]
    for exprs in both:
        assert [r for r in df.selectExpr("i", *exprs.replace(" AS a, ", " AS a\0").split("\0")).collect() if r.a != r.b] == []


def test_places_are_told_apart_quickly():
    """No alternation of looks where letters begin or end a word, no search without the sign or digit that a match must hold."""
    raw = D.x("raw")
    assert LOOK not in D.matches(raw, blocks.DIAGRAM).s and "|(?<!" not in D.matches(raw, blocks.DIAGRAM).s
    assert D.count(raw, r"(?i)[A-Z]+@[A-Z]+").s.startswith("(CASE WHEN NOT contains(raw, '@') THEN 0")
    assert D.matches(raw, T.VENUE_DATE_PLACE).s.startswith("((raw rlike '[0-9]') AND ")
    assert D.matches(raw, "a=b|c").s == "(raw rlike r'(?=[ac])(?:a=b|c)')"


def test_noise_of_merged_text_is_searched_by_need():
    """The folds judge the text merged so far at every fragment: e-mails and links are looked for only where their signs are."""
    noise = merging.is_noise(D.x("a.cur.text"), D.x("a.cur.page")).s
    assert "contains(clean, '@')" in noise and "contains(a.cur.text, ':')" in noise


@pytest.mark.parametrize("p", [r"(?i)\b(?:data\s+type|data|type|dog|end\s+for|end|ei)\b", r"\b(?:in|int|into|is|a)(?:s|to)?\b", r"(?i)\b(?:for|Forest|fo|x)\b", r"(?:ab|a|b|c)+"])
def test_words_by_their_first_letters_find_the_same(spark, p):
    texts = ["data type, data  TYPE database data", "end for ends end dog ei e", "into ints in int intos isto a", "FOREST for fo forests x", "aabbcab", "", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "i int, v string")
    plain = D._spelled(p).replace(r"\b", LOOK)
    assert [r for r in df.selectExpr(f"regexp_replace(v, r'{plain}', '<$0>') AS a", f"{D.replace(D.x('v'), p, '<$0>').s} AS b").collect() if r.a != r.b] == []


def test_words_are_tried_by_their_first_letters():
    assert D._parsed(r"\b(?:agent|ai|token|x)\b").spark.endswith("(?:a(?:gent|i)|token|x)(?!\\w)")
    assert "c(?:hunk|o(?:ntroller|arse|de))" in D._parsed(blocks.DIAGRAM).spark


def test_a_computed_text_is_computed_once():
    """What a rule reads often is one value: the collapsed text of a note's rule, a key and a cleaned line."""
    from leafmill.plans import context as plans

    assert plans._ROWS.s.count(T.collapse(plans.LINE).s) <= 4
    for e in (T.strip_metadata(T.TEXT), T.repeated_key(T.TEXT), T.is_publication_metadata(T.paragraph(T.TEXT))):
        assert e.s.count("regexp_replace(text, ") <= 2, e.s
