"""Checks of a document's state as rule tables: pipeline, layout, export and visual quality, planning.

A rule is a code with a condition over columns; a check's result is the list of the rules that hold, in
order. Conditions are SQL that both dialects read alike. Codes, severities and thresholds are fixed values.
"""

from __future__ import annotations

from typing import NamedTuple

from leafmill.functions.blocks import decide
from leafmill.functions.dual import E, matches, t, x


class Rule(NamedTuple):
    severity: str
    category: str
    code: str
    holds: str


#: Over: ocr_required, reading, planning_status, reuse_level, partial_fallback, mode, high_issues, medium_issues, recoverable, source_box_percent, short_fragments, visual_issues, formulas, formula_risks,
#: failed, total, completion, pending, deep_plan, digests, digest_percent, drafts, draft_percent, complete, weak, drift, missing_references, export_available, export_status, visual_provider, visual_status, visual_errors.
PIPELINE = [
    Rule("error", "ocr", "ocr-required", "ocr_required"),
    Rule("error", "segmentation", "no-reading-paragraphs", "reading = 0 AND NOT ocr_required"),
    Rule("warn", "planning", "planning-missing", "reading >= 8 AND planning_status = 'missing'"),
    Rule("warn", "planning", "planning-weak", "reading >= 8 AND planning_status <> 'missing' AND reuse_level = 'weak'"),
    Rule("warn", "planning", "planning-fallback", "partial_fallback"),
    Rule("warn", "segmentation", "non-ai-segmentation", "mode <> 'ai' AND reading > 30"),
    Rule("warn", "segmentation", "debug-issues", "high_issues > 0 OR medium_issues >= 2"),
    Rule("info", "segmentation", "recoverable-filtered-content", "recoverable > 0"),
    Rule("warn", "segmentation", "low-sourcebox-coverage", "reading >= 8 AND source_box_percent < 70"),
    Rule("warn", "segmentation", "many-short-fragments", "reading >= 8 AND 100 * short_fragments > 22 * reading"),
    Rule("warn", "visual", "visual-artifact-issues", "visual_issues > 0"),
    Rule("warn", "formula", "formula-risk", "formulas > 0 AND formula_risks > 0"),
    Rule("error", "analysis", "analysis-failed", "failed > 0"),
    Rule("warn", "analysis", "analysis-incomplete", "total > 0 AND completion < 80 AND pending > 0"),
    Rule("warn", "analysis", "section-digest-low-coverage", "deep_plan AND digests > 0 AND digest_percent < 85 AND reading >= 8"),
    Rule("info", "analysis", "section-draft-low-coverage", "deep_plan AND drafts > 0 AND draft_percent < 85 AND reading >= 8"),
    Rule("info", "analysis", "deep-plan-missing", "NOT deep_plan AND reading >= 8 AND complete > 0"),
    Rule("warn", "analysis", "weak-analysis", "weak > 0"),
    Rule("warn", "analysis", "terminology-drift", "drift > 0"),
    Rule("warn", "analysis", "analysis-reference-missing", "missing_references > 0"),
    Rule("error", "export", "export-errors", "export_available AND export_status = 'error'"),
    Rule("warn", "export", "export-warnings", "export_available AND export_status = 'warn'"),
    Rule("warn", "provider", "visual-provider-error", "visual_provider <> 'heuristic' AND visual_status = 'error'"),
    Rule("warn", "provider", "visual-provider-partial", "visual_provider <> 'heuristic' AND visual_status <> 'error' AND visual_errors > 0"),
]

#: Over a paragraph: unfinished, failed, weak, latex_risks, broken_refs; a row for each.
EXPORT_PARAGRAPH = [
    Rule("warn", "paragraph", "unfinished-paragraph", "unfinished"),
    Rule("error", "paragraph", "analysis-error", "failed"),
    Rule("warn", "paragraph", "weak-analysis", "weak"),
    Rule("warn", "paragraph", "latex-risk", "latex_risks > 0"),
    Rule("error", "paragraph", "broken-artifact-reference", "broken_refs > 0"),
]

#: Over an artifact: has_crop, has_asset, confidence, oversized, render_mode, latex_risks. Without a crop nothing else is checked.
EXPORT_ARTIFACT = [
    Rule("warn", "artifact", "missing-artifact-crop", "NOT has_crop"),
    Rule("error", "artifact", "missing-artifact-asset", "has_crop AND NOT has_asset"),
    Rule("warn", "artifact", "low-confidence-crop", "has_crop AND (confidence = 'low' OR oversized)"),
    Rule("info", "artifact", "formula-image-only", "has_crop AND render_mode = 'image'"),
    Rule("warn", "artifact", "low-confidence-formula-latex", "has_crop AND render_mode = 'image-latex'"),
    Rule("warn", "artifact", "artifact-latex-risk", "has_crop AND render_mode NOT IN ('image', 'image-latex') AND latex_risks > 0"),
]

#: Over an artifact, besides: conflict, type, manual, split, hidden, in_context.
VISUAL = [
    Rule("warn", "issue", "missing-crop", "NOT has_crop"),
    Rule("warn", "issue", "missing-asset", "has_crop AND NOT has_asset"),
    Rule("warn", "issue", "low-confidence", "confidence = 'low'"),
    Rule("warn", "issue", "oversized", "oversized"),
    Rule("warn", "issue", "type-conflict", "conflict"),
    Rule("warn", "issue", "low-confidence-formula", "type = 'formula' AND render_mode = 'image-latex'"),
    Rule("info", "info", "manual", "manual"),
    Rule("info", "info", "split-candidate", "split"),
    Rule("info", "info", "hidden", "hidden"),
    Rule("info", "info", "ai-context", "in_context"),
]


def codes(rules: list[Rule]) -> E:
    """severity:category:code of each rule that holds."""
    each = ", ".join(f"CASE WHEN {r.holds} THEN '{r.severity}:{r.category}:{r.code}' END" for r in rules)
    return E(f"array_compact(array({each}))", f"list_filter([{each}], lambda v: v IS NOT NULL)")


def counts(rules: list[Rule]) -> dict[str, str]:
    """By code, the SQL of how many rows it holds for."""
    return {r.code.replace("-", "_"): f"CAST(sum(CASE WHEN {r.holds} THEN 1 ELSE 0 END) AS BIGINT)" for r in rules}


def status(errors: str, warnings: str) -> E:
    return x(f"CASE WHEN {errors} > 0 THEN 'error' WHEN {warnings} > 0 THEN 'warn' ELSE 'ok' END")


#: Over: has_ai_layout, ai_status, ai_warnings, visual_provider, visual_status, visual_errors, fallback (reason), partial_fallback.
LAYOUT_MODE = decide([("'ai-layout'", "has_ai_layout"), ("'hybrid'", "visual_provider NOT IN ('', 'heuristic')"), ("'fallback'", "fallback <> '' OR partial_fallback")], "'local'")
LAYOUT_STATUS = decide([("'error'", "ai_status = 'error' OR visual_status = 'error'"), ("'warn'", "ai_status = 'warn' OR visual_status = 'warn' OR visual_errors > 0 OR ai_warnings > 0 OR fallback <> '' OR partial_fallback")], "'ok'")

#: Over: structure_reusable, memory_reusable, plan_items.
REUSE_LEVEL = decide([("'strong'", "structure_reusable AND memory_reusable"), ("'partial'", "structure_reusable OR (plan_items > 0 AND memory_reusable)")], "'weak'")
PLANNING_STATUS = decide([("'ready'", "structure_reusable AND memory_reusable"), ("'partial'", "structure_reusable OR plan_items > 0 OR memory_reusable")], "'missing'")


def section_role(c: E) -> E:
    """The part that a section plays, by the words of its title."""
    low = t("lower(<c>)", c=c)
    words = [
        ("abstract", "abstract|摘要"), ("background", "introduction|background|related work|motivation|背景|引言|相关"), ("method", "method|approach|design|architecture|system|algorithm|方法|设计|架构|系统"),
        ("result", "experiment|evaluation|result|analysis|实验|评估|结果|分析"), ("discussion", "discussion|limitation|讨论|局限"), ("conclusion", "conclusion|future|总结|结论|未来"),
    ]
    rules = [(k, matches(low, p)) for k, p in words]
    return E("CASE " + " ".join(f"WHEN {m.s} THEN '{k}'" for k, m in rules) + " ELSE '' END", "CASE " + " ".join(f"WHEN {m.d} THEN '{k}'" for k, m in rules) + " ELSE '' END")


VISUAL_TYPES = {"figure": ["figure", "fig", "image", "picture", "diagram", "plot", "chart"], "formula": ["formula", "equation", "math", "display-formula"], "code": ["code", "algorithm", "listing"], "table": ["table"]}


def visual_type(c: E) -> E:
    """The type of a region by its name or an alias; empty if unknown."""
    names = " ".join(f"WHEN v IN ({', '.join(repr(a) for a in v)}) THEN '{k}'" for k, v in VISUAL_TYPES.items())
    clean = t("lower(trim(coalesce(<c>, '')))", c=c)
    return E(f"CASE {names} ELSE '' END".replace("WHEN v", f"WHEN {clean.s}"), f"CASE {names} ELSE '' END".replace("WHEN v", f"WHEN {clean.d}"))


def escape_markdown(c: E) -> E:
    r"""A backslash before each of \ ` * _ { } [ ] ( ) # + . ! | -."""
    marks = r"([\\`*_{}\[\]()#+.!|-])"
    return E(f"regexp_replace({c.s}, r'{marks}', '\\\\\\\\$1')", f"regexp_replace({c.d}, '{marks}', '\\\\\\1', 'g')")
