"""Quality and planning of documents: pipeline checks, export and visual quality, layout, plans, progress, edits.

A source is a paper, its documents are the paragraphs; states that the tables lack (modes, providers,
crops, edits) follow from ids and lengths.
"""

from __future__ import annotations

from leafmill.functions import checks, formulas
from leafmill.functions import text as T
from leafmill.functions.dual import E, t, x
from leafmill.plans.base import Plan

_joined = lambda a, sep=",": E(f"array_join({a.s}, '{sep}')", f"coalesce(array_to_string({a.d}, '{sep}'), '')")
_risk_count = formulas.risk_list(x("text"))
_RISKS = T.size(_risk_count)

#: A row for each paper with the metrics that checks read.
_METRICS = t(
    "(SELECT source, sum(CASE WHEN n_chars >= 80 THEN 1 ELSE 0 END) = 0 AS ocr_required, sum(CASE WHEN n_chars >= 80 THEN 1 ELSE 0 END) AS reading, CASE WHEN min(d.doc_id) % 3 = 0 THEN 'missing' ELSE 'ready' END AS planning_status, CASE WHEN min(d.doc_id) % 4 = 1 THEN 'weak' ELSE 'strong' END AS reuse_level, "
    "min(d.doc_id) % 5 = 2 AS partial_fallback, CASE WHEN min(d.doc_id) % 2 = 0 THEN 'ai' ELSE 'local' END AS mode, sum(CASE WHEN n_chars < 20 THEN 1 ELSE 0 END) AS high_issues, sum(CASE WHEN n_chars BETWEEN 20 AND 60 THEN 1 ELSE 0 END) AS medium_issues, sum(CASE WHEN n_chars BETWEEN 70 AND 79 THEN 1 ELSE 0 END) AS recoverable, "
    "100.0 * count(l.doc_id) / count(*) AS source_box_percent, sum(CASE WHEN n_chars BETWEEN 80 AND 160 THEN 1 ELSE 0 END) AS short_fragments, sum(coalesce(toxic, 0)) AS visual_issues, count(*) AS formulas, sum(CASE WHEN contains(text, '$') THEN 1 ELSE 0 END) AS formula_risks, "
    "sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS failed, count(*) AS total, 100.0 * sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) / count(*) AS completion, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS pending, min(d.doc_id) % 3 <> 1 AS deep_plan, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS digests, "
    "100.0 * sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) / count(*) AS digest_percent, sum(CASE WHEN lang = 'de' THEN 1 ELSE 0 END) AS drafts, 100.0 * sum(CASE WHEN lang <> 'de' THEN 1 ELSE 0 END) / count(*) AS draft_percent, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS complete, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS weak, "
    "sum(CASE WHEN n_chars % 97 = 0 THEN 1 ELSE 0 END) AS drift, sum(CASE WHEN n_chars % 89 = 0 THEN 1 ELSE 0 END) AS missing_references, min(d.doc_id) % 2 = 1 AS export_available, CASE WHEN sum(coalesce(toxic, 0)) > 2 THEN 'error' ELSE 'warn' END AS export_status, "
    "CASE WHEN min(d.doc_id) % 2 = 0 THEN 'heuristic' ELSE 'external' END AS visual_provider, CASE WHEN min(d.doc_id) % 7 = 3 THEN 'error' WHEN min(d.doc_id) % 7 = 5 THEN 'warn' ELSE 'ok' END AS visual_status, min(d.doc_id) % 3 AS visual_errors, min(d.doc_id) % 4 = 0 AS has_ai_layout, CASE WHEN min(d.doc_id) % 9 = 8 THEN 'warn' ELSE '' END AS ai_status, "
    "min(d.doc_id) % 11 - 9 AS ai_warnings, CASE WHEN min(d.doc_id) % 6 = 5 THEN 'timeout' ELSE '' END AS fallback FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source)",
)
_EACH = E("LATERAL VIEW OUTER explode(found) e AS k", ", unnest(found) e(k)")
_PART = lambda i: E(f"split(k, ':')[{i}]", f"string_split(k, ':')[{i + 1}]")

_PARAGRAPHS = t(
    "(SELECT d.doc_id, d.source, l.quality IS NULL AS unfinished, coalesce(l.toxic = 1 AND l.quality = 0, false) AS failed, coalesce(l.quality = 0, false) AS weak, <risks> AS latex_risks, CASE WHEN a.doc_id IS NULL AND d.doc_id % 3 = 0 THEN 1 ELSE 0 END AS broken_refs "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 200) a ON a.doc_id = d.doc_id + 1 WHERE d.n_chars >= 80)", risks=_RISKS,
)
_ARTIFACTS = t(
    "(SELECT *, <conflict> AS conflict FROM (SELECT doc_id, source, doc_id % 5 <> 0 AS has_crop, doc_id % 7 <> 1 AS has_asset, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, n_chars > 2000 AS oversized, CASE doc_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'image-latex' ELSE 'latex' END AS render_mode, "
    "<risks> AS latex_risks, CASE doc_id % 6 WHEN 0 THEN 'formula' WHEN 1 THEN 'code' WHEN 2 THEN 'figure-text' WHEN 3 THEN 'other' ELSE 'caption' END AS type, CASE doc_id % 8 WHEN 0 THEN 'formula' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE '' END AS visual, text AS label, "
    "doc_id % 9 = 4 AS manual, doc_id % 10 = 3 AS split, doc_id % 11 = 2 AS hidden, doc_id % 2 = 0 AS in_context, doc_id % 12 = 5 AS pixel_refined, doc_id % 13 = 6 AS generated FROM documents) d)",
    risks=_RISKS, conflict=formulas.type_conflict(x("type"), x("visual"), x("label")),
)
_issue = checks.counts(checks.VISUAL)
_ERRORS, _WARNINGS = ("sum(CASE WHEN severity = '" + s + "' THEN 1 ELSE 0 END)" for s in ("error", "warn"))
_paragraph_codes, _artifact_codes = checks.codes(checks.EXPORT_PARAGRAPH), checks.codes(checks.EXPORT_ARTIFACT)
_ISSUES = t(
    "(SELECT source, <sev> AS severity, <code> AS code FROM (SELECT source, <p> AS found FROM <paragraphs> p UNION ALL SELECT source, <a> AS found FROM <artifacts> a WHERE NOT hidden) u <each> WHERE k IS NOT NULL)",
    sev=_PART(0), code=_PART(2), p=_paragraph_codes, a=_artifact_codes, paragraphs=_PARAGRAPHS, artifacts=_ARTIFACTS, each=_EACH,
)

#: Paragraphs of dialogues: system turns are headings, a conversation is a section.
_SPOKEN = "(SELECT conv_id, turn, role, text, CASE WHEN role = 'system' THEN 'heading' ELSE 'paragraph' END AS kind FROM conversations)"

_TITLE = T.section_hint(x("title"))
_PLAN_ROWS = t(
    "(SELECT doc_id, pos, <title> AS title, start_page, end_page, first_page, last_page FROM (SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN '1. Introduction' WHEN 1 THEN 'Method:' WHEN 2 THEN 'introduction' WHEN 3 THEN 'References' WHEN 4 THEN 'x' ELSE concat('Results ', line) END AS title, CASE WHEN pos % 5 = 4 THEN NULL ELSE page - pos % 2 END AS start_page, page + pos % 3 AS end_page, "
    "min(page) OVER (PARTITION BY doc_id) AS first_page, max(page) OVER (PARTITION BY doc_id) AS last_page FROM <blocks> b) r)", title=_TITLE,
)
_PLANNED = t(
    "(SELECT doc_id, pos, title, greatest(first_page, least(last_page, coalesce(start_page, first_page))) AS start_page, greatest(first_page, least(last_page, end_page)) AS end_page FROM <rows> r WHERE title <> '' AND NOT <refs>)", rows=_PLAN_ROWS, refs=T.is_references_title(x("title")),
)


QUERIES = {
    "pipeline_checks": Plan("SELECT source, <sev> AS severity, <cat> AS category, <code> AS code FROM (SELECT source, <found> AS found FROM <metrics> m) f <each> WHERE k IS NOT NULL", metrics=_METRICS, found=checks.codes(checks.PIPELINE), each=_EACH, sev=_PART(0), cat=_PART(1), code=_PART(2)),
    "layout_diagnostics": Plan("SELECT source, <mode> AS mode, <status> AS status, greatest(ai_warnings, 0) AS warnings FROM (SELECT * FROM <metrics> m) q", metrics=_METRICS, mode=checks.LAYOUT_MODE, status=checks.LAYOUT_STATUS),
    "export_qa": Plan("SELECT source, severity, code, count(*) AS n FROM <issues> i GROUP BY source, severity, code", issues=_ISSUES),
    "export_status": Plan(f"SELECT source, count(*) AS issues, CAST({_ERRORS} AS BIGINT) AS errors, CAST({_WARNINGS} AS BIGINT) AS warnings, <status> AS status FROM <issues> i GROUP BY source", issues=_ISSUES, status=checks.status(_ERRORS, _WARNINGS)),
    "visual_qa": Plan("SELECT doc_id, <found> AS found, CASE WHEN <n> THEN 'warn' ELSE 'ok' END AS status FROM <artifacts> a", artifacts=_ARTIFACTS, found=_joined(checks.codes(checks.VISUAL)), n=E(f"exists({checks.codes(checks.VISUAL).s}, v -> v LIKE 'warn:%')", f"len(list_filter({checks.codes(checks.VISUAL).d}, lambda v: v LIKE 'warn:%')) > 0")),
    "visual_stats": Plan(
        "SELECT source, count(*) AS total, CAST(sum(CASE WHEN hidden THEN 0 ELSE 1 END) AS BIGINT) AS artifacts, " + ", ".join(f"CAST(sum(CASE WHEN NOT hidden AND type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for k, n in (("caption", "captions"), ("formula", "formulas"), ("code", "code_blocks"), ("figure-text", "figure_text")))
        + ", " + ", ".join(f"CAST(sum(CASE WHEN NOT hidden AND {k} THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for k, n in (("pixel_refined", "pixel_refined"), ("confidence = 'low'", "low_confidence"), ("oversized", "oversized"), ("split", "split_candidates"), ("generated", "model_generated"), ("manual", "manual_crops")))
        + ", " + ", ".join(f"{v} AS issue_{k}" for k, v in _issue.items()) + " FROM <artifacts> a GROUP BY source", artifacts=_ARTIFACTS,
    ),
    "planning_snapshot": Plan(
        "SELECT source, plan_items, structure_reusable, memory_reusable, <reuse> AS reuse_level, <status> AS status FROM (SELECT source, sum(CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END) AS plan_items, max(n_chars) > 9000 AS structure_reusable, count(DISTINCT lang) > 3 AS memory_reusable FROM documents GROUP BY source) s",
        reuse=checks.REUSE_LEVEL, status=checks.PLANNING_STATUS,
    ),
    "segmentation_plan": Plan(
        "SELECT doc_id, nth AS ord, concat('planned_section_', CAST(nth + 1 AS STRING)) AS id, title, start_page, greatest(start_page, end_page) AS end_page, <role> AS role FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS nth FROM "
        "(SELECT *, row_number() OVER (PARTITION BY doc_id, lower(title), start_page ORDER BY pos) AS again FROM <planned> p) q WHERE again = 1) r WHERE nth < 32", planned=_PLANNED, role=checks.section_role(x("title")),
    ),
    "matching_section": Plan(
        "SELECT doc_id, pos, section FROM (SELECT e.doc_id, e.pos, s.pos AS section, row_number() OVER (PARTITION BY e.doc_id, e.pos ORDER BY CASE WHEN lower(e.title) = lower(s.title) THEN 0 WHEN s.pos IS NOT NULL THEN 1 ELSE 2 END, s.pos) AS rn FROM (SELECT * FROM <planned> q WHERE pos % 4 = 1) e "
        "LEFT JOIN (SELECT * FROM <planned> q WHERE pos % 4 <> 1) s ON e.doc_id = s.doc_id AND (lower(e.title) = lower(s.title) OR (e.start_page >= s.start_page AND e.start_page <= s.end_page))) r WHERE rn = 1", planned=_PLANNED,
    ),
    "section_opener": Plan(f"SELECT conv_id, turn, CASE WHEN turn = first_turn THEN second_turn ELSE first_turn END AS opener FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first_turn, min(CASE WHEN rn > 1 THEN turn END) OVER (PARTITION BY conv_id) AS second_turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM {_SPOKEN} s WHERE kind = 'paragraph') r) q"),
    "manual_neighbour": Plan(f"SELECT conv_id, turn, CASE WHEN next_kind = 'paragraph' THEN next_turn END AS neighbour FROM (SELECT conv_id, turn, kind, lead(kind) OVER (PARTITION BY conv_id ORDER BY turn) AS next_kind, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM {_SPOKEN} s) r WHERE kind = 'paragraph'"),
    "reading_progress": Plan(f"SELECT conv_id, turn, CAST(greatest(0, least(100, round(100.0 * (turn + 1) / greatest(1, count(*) OVER (PARTITION BY conv_id))))) AS BIGINT) AS percent FROM {_SPOKEN} s WHERE kind = 'paragraph'"),
    "insert_position": Plan(
        "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, band, x, is_new, pos) - 1 AS place, is_new FROM (SELECT doc_id, pos, page, CAST(floor(y / 3) AS BIGINT) AS band, CAST(pos % 2 AS BIGINT) AS x, CASE WHEN length(line) < 40 THEN 1 ELSE 0 END AS is_new FROM <blocks> b) s",
    ),
    "restorable_rows": Plan(
        "SELECT doc_id, pos, concat('para_rf_', substring(sha1(concat('recoverable-filtered|', CAST(page AS STRING), '|', CAST(pos AS STRING), '|', reason, '|', '0,', CAST(CAST(y AS BIGINT) AS STRING), ',100,12', '|', substring(<key>, 1, 520))), 1, 12)) AS id FROM (SELECT *, CASE WHEN length(line) < 30 THEN 'filtered' ELSE 'visual-text' END AS reason FROM <blocks> b) s WHERE length(line) < 60",
        key=T.coverage_key(x("line")),
    ),
    "match_order": Plan(
        "SELECT doc_id, artifact, source, row_number() OVER (PARTITION BY doc_id ORDER BY score, page, label) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, artifact ORDER BY pref) AS rn FROM ("
        "SELECT doc_id, doc_id % 5 AS artifact, 'stored' AS source, -1000 AS score, 0 AS pref, doc_id % 3 AS page, concat('A', CAST(doc_id % 5 AS STRING)) AS label FROM documents WHERE doc_id % 2 = 0 UNION ALL "
        "SELECT doc_id, doc_id % 4, 'exact', CAST(doc_id % 2 AS INT), 1, doc_id % 3, concat('A', CAST(doc_id % 4 AS STRING)) FROM documents WHERE n_chars % 3 = 0 UNION ALL "
        "SELECT doc_id, doc_id % 6, 'fallback', 50, 2, doc_id % 3, concat('A', CAST(doc_id % 6 AS STRING)) FROM documents WHERE n_chars % 3 <> 0) u) r WHERE rn = 1",
    ),
    "page_image": Plan("SELECT p.page_id, coalesce(p.image, i.image) AS image, CASE WHEN p.image IS NOT NULL THEN p.width ELSE coalesce(p.width, i.width) END AS width FROM (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url END AS image, CASE WHEN page_id % 3 = 0 THEN 900 END AS width FROM pages) p "
                       "LEFT JOIN (SELECT page_id, image, width FROM (SELECT page_id, concat('img-', CAST(page_id AS STRING)) AS image, 612 AS width, row_number() OVER (PARTITION BY page_id ORDER BY url) AS rn FROM pages WHERE page_id % 5 <> 0) f WHERE rn = 1) i ON p.page_id = i.page_id"),
    "unique_ids": Plan("SELECT doc_id, pos, CASE WHEN rn = 1 THEN slug ELSE concat(slug, '-', CAST(rn AS STRING)) END AS id FROM (SELECT doc_id, pos, slug, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) AS rn FROM (SELECT doc_id, pos, <slug> AS slug FROM <blocks> b) s) r", slug=T.slug(x("line"))),
    "markdown_escape": Plan("SELECT doc_id, pos, <e> AS escaped FROM (SELECT doc_id, pos, concat('a*b_[c](d) #1 ', line) AS line FROM <blocks> b) s", e=checks.escape_markdown(x("line"))),
    "visual_types": Plan("SELECT page_id, <v> AS visual FROM (SELECT page_id, CASE page_id % 8 WHEN 0 THEN ' Chart' WHEN 1 THEN 'equation' WHEN 2 THEN 'LISTING' WHEN 3 THEN 'table' WHEN 4 THEN 'map' WHEN 5 THEN NULL WHEN 6 THEN 'fig' ELSE 'code' END AS name FROM pages) p", v=checks.visual_type(x("name"))),
    "items_by_page": Plan(
        "SELECT conv_id, turn FROM (SELECT conv_id, turn, page, lo, hi, sum(CASE WHEN page IS NULL OR page BETWEEN lo AND hi THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS n_in FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN NULL ELSE turn END AS page, 2 + conv_id % 7 AS lo, 4 + conv_id % 7 AS hi FROM conversations) c) q WHERE n_in = 0 OR page IS NULL OR page BETWEEN lo AND hi",
    ),
    "window_state": Plan(
        f"SELECT conv_id, turn, <title> AS active_title, <sums> AS summaries FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text END AS title, concat('p. ', CAST(turn AS STRING), ': ', text) AS summary FROM {_SPOKEN} s) q",
        title=E("coalesce(last(title, true) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')", "coalesce(last_value(title IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')"),
        sums=E("array_join(collect_list(summary) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ' / ')", "string_agg(summary, ' / ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    ),
}
