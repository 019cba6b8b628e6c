"""Scores and findings from rule tables: crops, merges over a page break, verification, budgets.

A rule table lists (code, condition, ...) over named columns; it becomes an array of the codes that
hold, or a sum of points. Thresholds, points and rates are fixed values.
"""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.dual import E, any_of, matches, t, x


def codes(rules: list[tuple[str, E]]) -> E:
    """Array of the codes whose condition holds, in order."""
    parts = [t(f"CASE WHEN <c> THEN '{k}' END", c=c) for k, c in rules]
    return E(f"array_compact(array({', '.join(p.s for p in parts)}))", f"list_filter([{', '.join(p.d for p in parts)}], lambda v: v IS NOT NULL)")


def points(rules: list[tuple[int, E]]) -> E:
    """Sum of the points whose condition holds."""
    return E(*("(" + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for n, c in pairs) + ")" for pairs in ([(n, e.s) for n, e in rules], [(n, e.d) for n, e in rules])))


# -- crops: columns x, y, width, height, page_width, page_height, kind, refined, algorithm ----------

CROP_CLAMP = {
    "left_edge": x("greatest(0.0, least(x, CASE WHEN page_width > 1 THEN page_width - 1 ELSE page_width END))"),
    "top_edge": x("greatest(0.0, least(y, CASE WHEN page_height > 1 THEN page_height - 1 ELSE page_height END))"),
}
CROP_SIZE = {
    "crop_width": x("least(page_width, greatest(left_edge + 1, x + width)) - left_edge"),
    "crop_height": x("least(page_height, greatest(top_edge + 1, y + height)) - top_edge"),
}
CROP_RATIOS = {
    "area": x("crop_width * crop_height / greatest(1.0, page_width * page_height)"), "wide": x("crop_width / greatest(1.0, page_width)"), "high": x("crop_height / greatest(1.0, page_height)"),
}
CROP_OVERSIZED = {
    "oversized": x(
        "CASE kind WHEN 'table' THEN area > 0.38 OR high > 0.62 WHEN 'formula' THEN area > 0.12 OR high > 0.18 "
        "WHEN 'code' THEN CASE WHEN algorithm THEN area > 0.34 OR high > 0.68 OR (wide > 0.72 AND high > 0.52) ELSE area > 0.2 OR high > 0.36 END "
        "ELSE area > 0.28 OR (wide > 0.62 AND high > 0.46) OR (wide > 0.9 AND high > 0.34) END"
    )
}
_crop_points = points([
    (14, x("refined")), (-32, x("oversized AND kind = 'formula'")), (-24, x("oversized AND kind <> 'formula'")), (-28, x("area <= 0.002 OR wide <= 0.015 OR high <= 0.015")),
    (-12, x("CASE kind WHEN 'formula' THEN high > 0.18 WHEN 'code' THEN high > CASE WHEN algorithm THEN 0.68 ELSE 0.36 END WHEN 'table' THEN high > 0.62 ELSE high > 0.46 AND wide > 0.62 END")),
    (-6, x("wide > 0.94 AND kind = 'table'")), (-10, x("wide > 0.94 AND kind <> 'table'")), (-14, x("area > 0.5")), (-8, x("area > 0.35 AND area <= 0.5")),
])
CROP_SCORE = {
    "crop_score": t("CAST(greatest(0, least(100, 72 + <p>)) AS BIGINT)", p=_crop_points),
    "crop_confidence": x("CASE WHEN oversized AND refined THEN 'medium' WHEN oversized THEN 'low' WHEN refined THEN 'high' WHEN kind IN ('formula', 'code') OR (wide > 0.02 AND high > 0.02) THEN 'medium' ELSE 'low' END"),
}
CROP = [CROP_CLAMP, CROP_SIZE, CROP_RATIOS, CROP_OVERSIZED, CROP_SCORE]

# -- merge over a page break: columns prev, next (texts), prev_page, next_page, prev_section, next_section,
#    continues (told so), bottom, top (share of the page height, null if unknown), manual ------------

_prev, _next = x("prev"), x("next")


def _no_reading(c: E) -> E:
    return any_of(T.is_extraction_garbage(c), T.is_caption(T.collapse(c)), T.is_publication_metadata(c), T.is_link_line(c), T.is_bibliography_entry(c))


MERGE_SIGNS = {
    "prev_open": t("(NOT <e>)", e=T.ends_sentence(_prev)), "next_goes_on": T.starts_continuation(_next), "opening": any_of(T.is_heading(_next), T.is_section_opening(_next)), "no_reading": any_of(_no_reading(_prev), _no_reading(_next)),
    "garbage": any_of(T.is_extraction_garbage(_prev), T.is_extraction_garbage(_next)), "capitals": matches(_next, r"^[A-Z][A-Z\s]{2,}$"), "hyphen": x("(prev LIKE '%-')"),
    "same_section": x("coalesce(prev_section = next_section AND prev_section <> '', false)"), "mismatch": x("coalesce(prev_section <> next_section AND prev_section <> '' AND next_section <> '', false)"),
}
MERGE_SEGMENT = {
    "segment": x(
        "(trim(prev) <> '' AND trim(next) <> '' AND NOT mismatch AND NOT opening AND NOT garbage AND ((hyphen AND next_goes_on) OR continues OR (length(prev) <= 2200 AND "
        "((prev_open AND next_goes_on) OR (next_goes_on AND length(next) <= 260) OR (prev_open AND length(next) <= 420 AND NOT capitals)))))"
    ),
    "blocked": codes([("non-consecutive-page", x("next_page <> prev_page + 1")), ("manual-edit", x("next_page = prev_page + 1 AND manual")), ("next-section-opening", x("next_page = prev_page + 1 AND opening")), ("non-reading-text", x("next_page = prev_page + 1 AND no_reading"))]),
}
MERGE_RULES = [
    (7, "explicit-continuation", "continues"), (6, "hyphen-continuation", "hyphen"), (3, "previous-open-sentence", "prev_open"), (3, "next-starts-continuation", "next_goes_on"), (4, "segmented-text-continuation", "segment"),
    (1, "same-section", "same_section"), (3, "previous-at-page-bottom", "coalesce(bottom >= 0.88, false)"), (2, "previous-near-page-bottom", "coalesce(bottom >= 0.78 AND bottom < 0.88, false)"),
    (3, "next-at-page-top", "coalesce(top <= 0.16, false)"), (2, "next-near-page-top", "coalesce(top > 0.16 AND top <= 0.24, false)"),
]
MERGE_SCORE = {
    "free": E("(size(blocked) = 0)", "(len(blocked) = 0)"),
    "base_score": points([(n, x(c)) for n, _, c in MERGE_RULES]),
    "reasons": codes([(k, x(c)) for _, k, c in MERGE_RULES]),
    "textual": x("(continues OR hyphen OR prev_open OR next_goes_on OR segment)"),
    "boundary": x("coalesce(bottom >= 0.78 AND top <= 0.24, false)"),
}
MERGE_WISH = {"wished": x("(free AND (continues OR (base_score >= 6 AND textual) OR (base_score >= 7 AND boundary AND prev_open)))")}
MERGE_END = {
    "merged": x("(wished AND (NOT mismatch OR continues OR hyphen))"),
    "merge_score": x("CAST(CASE WHEN NOT free THEN 0 WHEN wished AND mismatch AND (continues OR hyphen) THEN base_score + 1 ELSE base_score END AS BIGINT)"),
    "stopped": codes([("section-mismatch", x("free AND mismatch AND NOT (wished AND (continues OR hyphen))")), ("score-below-threshold", x("free AND textual AND NOT (wished AND (NOT mismatch OR continues OR hyphen))")), ("no-text-continuation", x("free AND NOT textual"))]),
}
MERGE = [MERGE_SIGNS, MERGE_SEGMENT, MERGE_SCORE, MERGE_WISH, MERGE_END]

# -- verification of an analysis: columns source, translation, explanation, covered (null: none told),
#    told_all, told_role, told_reference (true, false or null), confidence ---------------------------

ROLE_CUE = "作用|承接|铺垫|引出|支持|证明|对应|说明|解释|用于|为.+提供|本节|这一节|该节|论文|方法|实验|结论|贡献|论证"
VERIFY_MEASURES = {f"{k}_{n}": f(x(k)) for k in ("source", "translation", "explanation") for n, f in (("chars", T.meaningful_chars), ("sentences", T.sentences))} | {"role_cue": matches(x("explanation"), ROLE_CUE)}
#: (severity, code, condition).
VERIFY_RULES = [
    ("warn", "coverage-missing", "covered IS NULL"), ("error", "coverage-translation-incomplete", "covered AND told_all = false"), ("warn", "coverage-section-role-missing", "covered AND told_role = false"),
    ("warn", "coverage-reference-missing", "covered AND told_reference = false"), ("warn", "coverage-low-confidence", "covered AND confidence < 0.55"),
    ("error", "translation-missing", "translation_chars = 0"), ("warn", "translation-too-short", "translation_chars > 0 AND source_chars >= 120 AND translation_chars < greatest(36, floor(source_chars * 0.2))"),
    ("error", "explanation-missing", "explanation_chars = 0"), ("warn", "explanation-too-short", "explanation_chars > 0 AND source_chars >= 90 AND explanation_chars < 42"),
    ("warn", "translation-likely-summary", "source_chars >= 180 AND source_sentences >= 3 AND translation_sentences <= 1 AND translation_chars < source_chars * 0.34"),
    ("warn", "explanation-one-generic-sentence", "source_chars >= 120 AND explanation_chars >= 1 AND explanation_sentences <= 1 AND explanation_chars < 90"),
    ("warn", "section-role-not-evident", "source_chars >= 160 AND explanation_chars >= 1 AND coalesce(told_role, true) AND NOT role_cue"),
]
VERIFY_CODES = {"issues": codes([(k, x(f"coalesce({c}, false)")) for _, k, c in VERIFY_RULES]), "errors": points([(1, x(f"coalesce({c}, false)")) for s, _, c in VERIFY_RULES if s == "error"])}
VERIFY_STATUS = {"status": E("CASE WHEN errors > 0 THEN 'error' WHEN size(issues) > 0 THEN 'warn' ELSE 'ok' END", "CASE WHEN errors > 0 THEN 'error' WHEN len(issues) > 0 THEN 'warn' ELSE 'ok' END")}
VERIFY = [VERIFY_MEASURES, VERIFY_CODES, VERIFY_STATUS]


def budget(n: str, tokens: str, fast: bool = False, rate_in: float = 0.6, rate_out: float = 2.4) -> list[dict[str, E]]:
    """Tokens in and out and cost for n paragraphs; rates are USD for a million tokens. Nothing for no paragraphs."""
    more, floor = (1.05, 260) if fast else (1.35, 420)
    return [
        {"tokens_in": x(f"CAST({tokens} + CASE WHEN {n} > 0 THEN 650 + 180 * {n} ELSE 0 END AS BIGINT)"), "tokens_out": x(f"CAST(CASE WHEN {n} > 0 THEN ceil(round({tokens} * {more} + {floor} * {n}, 6)) ELSE 0 END AS BIGINT)")},
        {"tokens_total": x("tokens_in + tokens_out"), "usd": x(f"round(CAST(tokens_in AS DOUBLE) / 1000000 * CAST({rate_in} AS DOUBLE) + CAST(tokens_out AS DOUBLE) / 1000000 * CAST({rate_out} AS DOUBLE), 4)")},
    ]


def layered(source: E, layers: list[dict[str, E]]) -> E:
    """source as a subquery with the layers' columns added, each layer over the one before."""
    for layer in layers:
        source = E(f"(SELECT *, {', '.join(f'{e.s} AS {k}' for k, e in layer.items())} FROM {source.s} l)", f"(SELECT *, {', '.join(f'{e.d} AS {k}' for k, e in layer.items())} FROM {source.d} l)")
    return source

