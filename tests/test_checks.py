"""Rule tables of checks on literal rows."""

from leafmill.functions import checks
from leafmill.functions.dual import x

QUIET = {
    "ocr_required": "false", "reading": "40", "planning_status": "'ready'", "reuse_level": "'strong'", "partial_fallback": "false", "mode": "'ai'", "high_issues": "0", "medium_issues": "1", "recoverable": "0", "source_box_percent": "90.0", "short_fragments": "2",
    "visual_issues": "0", "formulas": "3", "formula_risks": "0", "failed": "0", "total": "40", "completion": "100.0", "pending": "0", "deep_plan": "true", "digests": "3", "digest_percent": "90.0", "drafts": "3", "draft_percent": "90.0", "complete": "40", "weak": "0",
    "drift": "0", "missing_references": "0", "export_available": "true", "export_status": "'ok'", "visual_provider": "'heuristic'", "visual_status": "'error'", "visual_errors": "5",
}


def found(spark, **change):
    row = QUIET | change
    sql = f"SELECT {checks.codes(checks.PIPELINE).s} AS v FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in row.items())}) m"
    return [c.split(":")[2] for c in spark.sql(sql).first().v]


def test_pipeline_checks(spark):
    assert found(spark) == []
    assert found(spark, ocr_required="true", reading="0") == ["ocr-required"] and found(spark, reading="0") == ["no-reading-paragraphs"]
    assert found(spark, planning_status="'missing'", reuse_level="'weak'") == ["planning-missing"] and found(spark, reuse_level="'weak'") == ["planning-weak"]
    assert found(spark, mode="'local'", reading="30") == [] and found(spark, mode="'local'") == ["non-ai-segmentation"]
    assert found(spark, medium_issues="2", short_fragments="9", source_box_percent="69.9") == ["debug-issues", "low-sourcebox-coverage", "many-short-fragments"]
    assert found(spark, deep_plan="false", digest_percent="1.0") == ["deep-plan-missing"] and found(spark, digest_percent="1.0", draft_percent="1.0") == ["section-digest-low-coverage", "section-draft-low-coverage"]
    assert found(spark, export_status="'error'", failed="1") == ["analysis-failed", "export-errors"] and found(spark, export_status="'warn'") == ["export-warnings"]
    assert found(spark, visual_provider="'x'") == ["visual-provider-error"] and found(spark, visual_provider="'x'", visual_status="'ok'") == ["visual-provider-partial"]
    assert len({r.code for r in checks.PIPELINE}) == 24


def test_artifact_checks(spark):
    quiet = {"has_crop": "true", "has_asset": "true", "confidence": "'high'", "oversized": "false", "render_mode": "'latex'", "latex_risks": "0", "conflict": "false", "type": "'formula'", "manual": "false", "split": "false", "hidden": "false", "in_context": "false"}
    of = lambda rules, **c: [v.split(":")[2] for v in spark.sql(f"SELECT {checks.codes(rules).s} AS v FROM (SELECT {', '.join(f'{v} AS {k}' for k, v in (quiet | c).items())}) m").first().v]
    assert of(checks.EXPORT_ARTIFACT) == of(checks.VISUAL) == []
    assert of(checks.EXPORT_ARTIFACT, has_crop="false", has_asset="false", confidence="'low'") == ["missing-artifact-crop"]
    assert of(checks.EXPORT_ARTIFACT, render_mode="'image-latex'", latex_risks="2") == ["low-confidence-formula-latex"] and of(checks.EXPORT_ARTIFACT, latex_risks="2") == ["artifact-latex-risk"]
    assert of(checks.VISUAL, has_crop="false", has_asset="false", confidence="'low'", render_mode="'image-latex'", hidden="true") == ["missing-crop", "low-confidence", "low-confidence-formula", "hidden"]


def test_small_tables(spark):
    one = lambda e: spark.sql(f"SELECT {e.s} AS v").first().v
    q = lambda s: x(f"'{s}'")
    assert [one(checks.visual_type(x(v))) for v in ("' Chart '", "'EQUATION'", "'listing'", "'table'", "'map'", "NULL")] == ["figure", "formula", "code", "table", "", ""]
    assert [one(checks.section_role(q(v))) for v in ("Abstract", "Related Work", "System Design", "Results and analysis", "Limitations", "Conclusion", "Foo")] == ["abstract", "background", "method", "result", "discussion", "conclusion", ""]
    assert one(checks.escape_markdown(q("a*b_[c](d) #1."))) == r"a\*b\_\[c\]\(d\) \#1\."
