"""Formulas and exported artifacts: LaTeX risks, confidence and render mode, crops, type conflicts.

Input columns of `nested`: raw (text or LaTeX), formula (role and reason of `blocks`), manual, generated
and ocr (where the text comes from), has_crop. Codes and patterns are fixed values.
"""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.blocks import decide
from leafmill.functions.dual import E, all_of, count, extract_all, matches, replace, t, x
from leafmill.functions.scoring import layered

_ONE = r"[A-Za-z0-9_{}()\[\],.:;=+\-*/^<>≤≥≠≈⋯…|]"
_OPERATOR = "[:=+\\-*/^<>≤≥≠≈⋯…|]"


def _tokens(c: E, pattern: str) -> E:
    m = matches(x("v"), f"^{pattern}$")
    clean = T.collapse(c)
    return E(f"size(filter(split({clean.s}, ' '), v -> {m.s}))", f"len(list_filter(string_split({clean.d}, ' '), lambda v: {m.d}))")


def latex_risks(c: E) -> dict[str, E]:
    """By code, in order: whether the LaTeX of a text has it."""
    bare = replace(c, r"(?s)\\.", "")  # without escaped characters
    names = [extract_all(c, rf"\x5C{w}\{{([^}}]+)\}}", 1) for w in ("begin", "end")]
    n, short, ops = _tokens(c, r"\S+"), _tokens(c, _ONE), _tokens(c, _OPERATOR)
    return {
        "unbalanced-dollar": t("(<n> % 2 = 1)", n=count(bare, r"\$")),
        "unbalanced-display-delimiter": t("(<a> <> <b>)", a=count(c, r"\\\["), b=count(c, r"\\\]")),
        "unbalanced-inline-delimiter": t("(<a> <> <b>)", a=count(c, r"\\\("), b=count(c, r"\\\)")),
        "unbalanced-environment": t("(<a> <> <b>)", a=names[0], b=names[1]),
        "broken-pdf-spacing": t("(<n> >= 8 AND <s> >= 0.68 * <n> AND <o> >= 2)", n=n, s=short, o=ops),
        "placeholder-text": is_placeholder(c),
    }


def is_placeholder(c: E) -> E:
    return matches(T.collapse(c), r"(?i)^(?:model formula \d+|formula(?:\s+\d+)?)$")


def risk_list(c: E) -> E:
    """The codes of all risks, in order; none for a blank text."""
    risks = latex_risks(c)
    s = "array_compact(array(" + ", ".join(f"CASE WHEN {e.s} THEN '{k}' END" for k, e in risks.items()) + "))"
    d = "list_filter([" + ", ".join(f"CASE WHEN {e.d} THEN '{k}' END" for k, e in risks.items()) + "], lambda v: v IS NOT NULL)"
    return t("CASE WHEN <c> = '' THEN <none> ELSE <all> END", c=T.collapse(c), none=E("array()", "[]::VARCHAR[]"), all=E(s, d))


_CLEAN = x("clean")
#: Columns by layer: risks, structure, then confidence and how the formula is shown.
LAYERS: list[dict[str, E]] = [
    {
        "risks": risk_list(x("raw")), "placeholder": is_placeholder(_CLEAN), "latex": matches(_CLEAN, r"\\[A-Za-z]+|\\[()\[\]]|[_^{}]|[≤≥≠≈∑∏∫√∞→←↔±×÷∂]"), "delimited": matches(_CLEAN, r"\\\[|\\\]|\\\(|\\\)|\$\$|(?:^|[^\\])\$"),
        "plain_equation": matches(_CLEAN, r"[A-Za-zα-ωΑ-Ω][\wα-ωΑ-Ω()\[\]^+\-−*/|′˜ˆ<>]*\s*[=≤≥≈]\s*[^=]"),
        "source": decide([("'none'", "clean = ''"), ("'manual'", "manual"), ("'model-label'", "generated OR lower(clean) LIKE 'model formula %'"), ("'ocr-text'", "ocr")], "'pdf-text'"),
    },
    {"n_risks": E("size(risks)", "len(risks)"), "risk": E("coalesce(get(risks, 0), '')", "coalesce(risks[1], '')")},
    {"latex_confidence": decide([
        ("'none'", "clean = '' OR placeholder"), ("'low'", "n_risks > 0"), ("'low'", "formula LIKE 'inline-math:%'"), ("'none'", "formula NOT LIKE 'display-formula:%'"), ("'high'", "manual AND latex"), ("'high'", "delimited AND latex"),
        ("'none'", "source = 'model-label'"), ("'medium'", "latex OR plain_equation"),
    ], "'low'")},
    {"render_mode": decide([
        ("'image'", "(clean = '' OR latex_confidence = 'none') AND has_crop"), ("'latex'", "clean = '' OR latex_confidence = 'none'"), ("'image-latex'", "latex_confidence = 'low' AND has_crop"),
        ("'image-latex'", "latex_confidence = 'medium' AND has_crop AND source IN ('pdf-text', 'ocr-text')"),
    ], "'latex'")},
]


def nested(source: E) -> E:
    """source (a subquery with the columns of `blocks` and the inputs) with the columns of LAYERS."""
    return layered(source, LAYERS)


def is_export_relevant(kind: E, visual: E, visible: E) -> E:
    return t("(<ok> AND (<k> IN ('caption', 'formula', 'code') OR <v> IN ('figure', 'table', 'formula', 'code')))", ok=visible, k=kind, v=visual)


def has_crop(image: E, box: list[E], size: list[E]) -> E:
    """An image, and a crop (x, y, width, height) on a page (width, height) with finite numbers and positive extents."""
    finite = [E(f"({v.s} IS NOT NULL AND abs({v.s}) < double('infinity') AND NOT isnan({v.s}))", f"({v.d} IS NOT NULL AND isfinite({v.d}))") for v in [*box, *size]]
    return all_of(t("coalesce(<i>, '') <> ''", i=image), *finite, *[t("<v> > 0", v=v) for v in [*box[2:], *size]])


def type_conflict(kind: E, visual: E, label: E) -> E:
    """Does the kind of an artifact contradict its visual type or its label? An empty visual type contradicts nothing."""
    table, figure = matches(label, r"(?i)^table\b"), matches(label, r"(?i)^fig(?:ure)?\b")
    return t(
        "CASE WHEN <k> NOT IN ('caption', 'formula', 'code', 'figure-text') THEN true WHEN <v> = '' THEN false WHEN <k> = 'caption' THEN <v> NOT IN ('figure', 'table') OR (<t> AND <v> <> 'table') OR (<f> AND <v> = 'table') "
        "WHEN <k> IN ('formula', 'code') THEN <v> <> <k> ELSE <v> NOT IN ('figure', 'figure-text') END",
        k=kind, v=visual, t=table, f=figure,
    )


def is_useful_artifact(kind: E, generated: E, useful: E) -> E:
    """Formulas must be useful, all else is."""
    return t("(<g> OR <k> <> 'formula' OR <u>)", g=generated, k=kind, u=useful)


def is_low_resolution(width: E, height: E) -> E:
    return t("(<w> > 0 AND <h> > 0 AND (<w> < 900 OR <h> < 1100))", w=width, h=height)


