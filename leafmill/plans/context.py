"""Blocks in their surroundings: noise audit, drop reasons, page input, formulas and exported artifacts.

The lines of documents are the blocks. The first line of a document is its title, the last heading
before a block its section's title; pages 9 to 12 are no body, a region covers two lines of every fifth page, and
three readers' notes stand for those of a document.
"""

from __future__ import annotations

from leafmill.functions import blocks, context, formulas
from leafmill.functions import text as T
from leafmill.functions.dual import E, t, x
from leafmill.plans.base import Plan

LINE = x("line")
_joined = lambda a, sep=",": E(f"array_join({a}, '{sep}')", f"coalesce(array_to_string({a}, '{sep}'), '')")

_NOTES = E("array('p.2: page header', 'Page 3 lists the references', 'p.1 author names')", "['p.2: page header', 'Page 3 lists the references', 'p.1 author names']")
_LAST = E("last(<h>, true)", "last_value(<h> IGNORE NULLS)")
#: Lines with the title of their section: the last heading up to them.
FILLED = t(
    "(SELECT *, coalesce(<last> OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS hint FROM (SELECT *, CASE WHEN <is> THEN <hint> END AS head FROM <blocks> b) h)",
    last=E(_LAST.s.replace("<h>", "head"), "last_value(head IGNORE NULLS)"), hint=T.section_hint(LINE), **{"is": T.is_heading(LINE)},
)
_KEYED = t("(SELECT *, first_value(line) OVER (PARTITION BY doc_id ORDER BY pos) AS title, <key> AS rep FROM <filled> f)", key=T.repeated_key(LINE), filled=FILLED)
_ONCE = t("(SELECT *, CASE WHEN rep <> '' AND row_number() OVER (PARTITION BY doc_id, rep, page ORDER BY pos) = 1 THEN 1 ELSE 0 END AS once FROM <keyed> k)", keyed=_KEYED)
_ROWS = t(
    "(SELECT doc_id, source, pos, line AS raw, 1 AS n_lines, page, y, hint, title, sum(once) OVER (PARTITION BY doc_id, rep) AS n_pages, page BETWEEN 9 AND 12 AS in_zone, page % 5 = 0 AND y BETWEEN 36 AND 71 AS covered, <note> AS suppressed FROM <told> k)",
    told=E(f"(SELECT *, {T.collapse(LINE).s} AS told FROM {_ONCE.s} o)", _ONCE.d), note=context.any_note(x("page"), E("told", T.collapse(LINE).d), _NOTES),
)
_JUDGED = context.nested(_ROWS)
# OUTER: else the whole list would be computed a second time, as a filter before it is made
_EACH = E("LATERAL VIEW OUTER explode(audit_reasons) e AS reason", ", unnest(audit_reasons) e(reason)")

_FORMULA_ROWS = blocks.nested(t("(SELECT doc_id, pos, 1 AS n_lines, <raw> AS raw, pos % 7 = 0 AS manual, pos % 5 = 0 AS generated, pos % 3 = 0 AS ocr, pos % 2 = 0 AS has_crop FROM <blocks> b)", raw=E(
    r"concat(CASE pos % 9 WHEN 0 THEN 'L(x) = \\sum_i $a_i$ ' WHEN 1 THEN '\\[ y = x + 1 \\]' WHEN 2 THEN 'loss = max(a, b) ' WHEN 3 THEN '\\begin{align} x \\end{matrix} = 2' WHEN 4 THEN 'x = 1 + 2 - 3 * 4 / 5 ' WHEN 5 THEN 'Model formula 3' WHEN 6 THEN 'price \\$5 = $x' ELSE '' END, CASE WHEN pos % 9 IN (1, 5) THEN '' ELSE line END)",
    r"concat(CASE pos % 9 WHEN 0 THEN 'L(x) = \sum_i $a_i$ ' WHEN 1 THEN '\[ y = x + 1 \]' WHEN 2 THEN 'loss = max(a, b) ' WHEN 3 THEN '\begin{align} x \end{matrix} = 2' WHEN 4 THEN 'x = 1 + 2 - 3 * 4 / 5 ' WHEN 5 THEN 'Model formula 3' WHEN 6 THEN 'price \$5 = $x' ELSE '' END, CASE WHEN pos % 9 IN (1, 5) THEN '' ELSE line END)",
)))
_FORMULAS = formulas.nested(_FORMULA_ROWS)

_KIND = x("CASE page % 5 WHEN 0 THEN 'caption' WHEN 1 THEN 'formula' WHEN 2 THEN 'code' WHEN 3 THEN 'figure-text' ELSE 'region' END")
_VISUAL = x("CASE pos % 6 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' WHEN 3 THEN 'code' ELSE '' END")
_BOX = [x("CAST(y AS DOUBLE)"), x("CAST(y AS DOUBLE)"), x("CAST(length(line) AS DOUBLE)"), x("CAST(length(line) - 3 AS DOUBLE)")]

QUERIES = {
    "noise_audit": Plan("SELECT source, reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM <judged> j <each> WHERE reason IS NOT NULL GROUP BY source, reason", judged=_JUDGED, each=_EACH),
    "noise_context": Plan("SELECT doc_id, pos, <r> AS reasons, audit_action AS action, audit_confidence AS confidence FROM <judged> j", judged=_JUDGED, r=_joined("audit_reasons")),
    "drop_reasons": Plan("SELECT doc_id, pos, <r> AS reasons FROM <judged> j", judged=_JUDGED, r=_joined("drop_reasons")),
    "non_reading": Plan("SELECT doc_id, pos, non_reading_validated, non_reading_input, non_reading_block FROM <judged> j", judged=_JUDGED),
    "filtered_blocks": Plan("SELECT doc_id, pos, CASE WHEN non_reading_block THEN filtered_reason ELSE '' END AS reason, non_reading_block AND recoverable AS recoverable FROM <judged> j", judged=_JUDGED),
    "structure_headings": Plan("SELECT doc_id, pos, line FROM (SELECT doc_id, pos, readable AS line FROM <judged> j WHERE structure_heading) h", judged=_JUDGED),
    "section_fill": Plan("SELECT doc_id, pos, hint AS section, CAST(count(head) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS nth FROM <filled> f", filled=FILLED),
    "embedded_text": Plan("SELECT doc_id, pos, <v> AS visual, <e> AS embedded FROM <blocks> b", v=_VISUAL, e=context.is_embedded_visual_text(LINE, x("1 + pos % 4"), _VISUAL)),
    "latex_risk": Plan("SELECT doc_id, pos, <r> AS risks FROM <formulas> f", formulas=_FORMULAS, r=_joined("risks")),
    "formula_fields": Plan("SELECT doc_id, pos, formula AS role, risk, source, latex_confidence, render_mode FROM <formulas> f", formulas=_FORMULAS),
    "useful_artifacts": Plan("SELECT doc_id, pos, <u> AS useful FROM <formulas> f", formulas=_FORMULAS, u=formulas.is_useful_artifact(x("CASE WHEN pos % 2 = 0 THEN 'formula' ELSE 'code' END"), x("generated"), x("useful_formula"))),
    "export_artifacts": Plan(
        "SELECT doc_id, pos, <rel> AS relevant, <crop> AS has_crop, <bad> AS conflict FROM <blocks> b",
        rel=formulas.is_export_relevant(_KIND, _VISUAL, x("(pos % 11 <> 0)")), bad=formulas.type_conflict(_KIND, _VISUAL, LINE), crop=formulas.has_crop(x("CASE WHEN pos % 4 = 0 THEN '' ELSE 'page.png' END"), _BOX, [x("CAST(612 AS DOUBLE)"), x("CAST(page % 9 AS DOUBLE)")]),
    ),
    "low_resolution_pages": Plan("SELECT page_id, width, height FROM (SELECT page_id, 500 + length(html) % 900 AS width, 700 + length(url) * 20 AS height FROM pages) p WHERE <low>", low=formulas.is_low_resolution(x("width"), x("height"))),
}
