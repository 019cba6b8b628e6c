"""Block classes, crops, merges over page breaks, verification, budgets, sections and nearest artifacts.

Pages of eight lines stand for layout blocks; some carry a formula, code or table in front, so that
every class occurs. Ranges, titles and boxes come from line numbers.
"""

from __future__ import annotations

from leafmill.functions import blocks, scoring
from leafmill.functions import text as T
from leafmill.functions.dual import E, t, x
from leafmill.plans.base import Plan

LINE = x("line")


def _listed(array: E, sep: str = ",") -> E:
    return E(f"array_join({array.s}, '{sep}')", f"coalesce(array_to_string({array.d}, '{sep}'), '')")


#: Lines of a page in one text, all of them, after a stand-in head by page and document.
_BR = E("'\\n'", "chr(10)")
_HEAD = t(
    "concat(CASE (doc_id + page) % 9 WHEN 0 THEN concat('1: x <- 0', <br>, '2: while x < n', <br>, '3: x <- x + 1', <br>) WHEN 1 THEN concat('L(θ) = Σ log p(x | θ)', <br>) WHEN 2 THEN concat('Model MAE MSE', <br>, '0.1 0.2', <br>, '0.3 0.4', <br>, '5 6', <br>) "
    "WHEN 3 THEN concat('query -> encoder', <br>, 'memory', <br>, 'agent', <br>, 'answer', <br>) WHEN 4 THEN concat('Table 3: Results.', <br>) WHEN 5 THEN concat('(12)', <br>) ELSE '' END, txt)", br=_BR,
)
_TEXTS = E("array_join(transform(array_sort(collect_list(struct(pos, line))), v -> v.line), '\\n')", "string_agg(line, chr(10) ORDER BY pos)")
_PAGE_TEXT = t("(SELECT doc_id, page, n_lines, <head> AS raw FROM (SELECT doc_id, page, count(*) AS n_lines, <texts> AS txt FROM <blocks> b GROUP BY doc_id, page) g)", head=_HEAD, texts=_TEXTS)
_PAIRS = (
    "(SELECT doc_id, pos, prev, line AS next, prev_page, page AS next_page, CASE WHEN prev_page % 3 = 0 THEN 'm' ELSE '' END AS prev_section, CASE WHEN pos % 4 = 0 THEN 'e' ELSE 'm' END AS next_section, pos % 11 = 0 AS continues, "
    "CAST(prev_y / 150 AS DOUBLE) AS bottom, CAST(y / 150 AS DOUBLE) AS top, pos % 29 = 0 AS manual FROM (SELECT doc_id, pos, line, page, y, lag(line) OVER w AS prev, lag(page) OVER w AS prev_page, lag(y) OVER w AS prev_y FROM <blocks> b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) q WHERE prev_page <> page)"
)
_ANALYSES = (
    "(SELECT d.doc_id, d.text AS source, CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE substring(d.text, 1, CAST(floor(length(d.text) / (1 + d.doc_id % 7)) AS INT)) END AS translation, CASE WHEN d.doc_id % 6 = 0 THEN '' ELSE concat(substring(d.text, 1, 40), CASE WHEN d.doc_id % 2 = 0 THEN ' 方法' ELSE '' END) END AS explanation, "
    "CASE WHEN l.doc_id IS NOT NULL THEN true END AS covered, l.quality = 1 AS told_all, l.toxic = 0 AS told_role, CAST(NULL AS BOOLEAN) AS told_reference, CAST(d.doc_id % 10 AS DOUBLE) / 10 AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
_CROPS = (
    "(SELECT doc_id, pos, CAST(pos % 60 - 20 AS DOUBLE) AS x, CAST(y * 4 AS DOUBLE) AS y, CAST(40 + length(line) AS DOUBLE) AS width, CAST(5 + pos % 13 * 50 AS DOUBLE) AS height, 612.0D AS page_width, 792.0D AS page_height, "
    "CASE pos % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' WHEN 2 THEN 'formula' ELSE 'code' END AS kind, pos % 3 = 0 AS refined, pos % 5 = 0 AS algorithm FROM <blocks> b)"
)
_BUDGET_ROWS = t("(SELECT source, count(*) AS n, <k> AS tok FROM documents GROUP BY source)", k=T.token_estimate(x("sum(length(text))")))
#: Rates of a million tokens in and out by class of provider.
RATES = {"general": (0.6, 2.4), "low": (0.3, 1.2), "direct": (0.4, 1.6), "agent": (3.0, 15.0)}
_plan = "(SELECT doc_id, id, title, a, z FROM documents CROSS JOIN (SELECT 's1' AS id, 'Method' AS title, 1 AS a, 2 AS z UNION ALL SELECT 's2', 'Results', 2, 4 UNION ALL SELECT 's3', 'References', 8, 99) three)"
_items = "(SELECT doc_id, min(page) AS page, max(page) AS page_end, CASE doc_id % 4 WHEN 0 THEN 's2' WHEN 1 THEN 's9' ELSE '' END AS told, CASE doc_id % 3 WHEN 0 THEN 'METHOD' WHEN 1 THEN 'Result' ELSE '' END AS hint, CAST(pos DIV 24 AS BIGINT) AS part FROM <blocks> b GROUP BY doc_id, CAST(pos DIV 24 AS BIGINT))"
_arts = "(SELECT doc_id, pos, page, y, CASE pos % 3 WHEN 0 THEN 'figure' WHEN 1 THEN 'table' ELSE 'equation' END AS kind, CAST(length(line) AS DOUBLE) AS w FROM <blocks> b WHERE pos % 5 = 0)"
_gap = "CASE WHEN a.page <> p.page THEN 420.0 WHEN p.y + 12 < a.y THEN a.y - p.y - 12 WHEN a.y + 40 < p.y THEN p.y - a.y - 40 ELSE 0.2 * abs(p.y + 6 - a.y - 20) END"


def _plan_over(columns: str, source: E, layers: list) -> Plan:
    return Plan(f"SELECT {columns} FROM <layers> q", layers=scoring.layered(source, layers))


def _duck_double(e: str) -> E:
    return E(e, e.replace("612.0D", "612.0::DOUBLE").replace("792.0D", "792.0::DOUBLE"))


def _div(e: str) -> E:
    return E(e, e.replace("pos DIV 24", "pos // 24"))


#: Lines with the first one of their document as its title; keys and words once a line.
_TITLED_LINES = scoring.layered(
    x("(SELECT doc_id, pos, page, line, first_value(line) OVER (PARTITION BY doc_id ORDER BY pos) AS title FROM <blocks> b)"),
    [
        {"body": T.paragraph(LINE), "name": T.paragraph(x("title"))}, {"body_key": T.letters_key(x("body")), "name_key": T.letters_key(x("name"))},
        {"body_words": T.title_tokens(x("body"), x("body_key")), "name_words": T.title_tokens(x("name"), x("name_key"))},
    ],
)

QUERIES = {
    "block_classes": _plan_over("doc_id, page, is_code, formula, is_table, is_diagram, useful_formula, artifact_type, labels, math, table_words", _PAGE_TEXT, blocks.LAYERS),
    "artifact_counts": Plan("SELECT artifact_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM <layers> q GROUP BY artifact_type", layers=scoring.layered(_PAGE_TEXT, blocks.LAYERS)),
    "cross_page_merge": Plan("SELECT doc_id, pos, merged, merge_score, <r> AS reasons, <b> AS blocked, <s> AS stopped FROM <layers> q", layers=scoring.layered(x(_PAIRS), scoring.MERGE), r=_listed(x("reasons")), b=_listed(x("blocked")), s=_listed(x("stopped"))),
    "verify_one": Plan("SELECT doc_id, status, <i> AS issues, source_chars, translation_sentences FROM <layers> q", layers=scoring.layered(x(_ANALYSES), scoring.VERIFY), i=_listed(x("issues"))),
    "verify_batch": Plan("SELECT status, count(*) AS n, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(<n>) AS BIGINT) AS issues FROM <layers> q GROUP BY status", layers=scoring.layered(x(_ANALYSES), scoring.VERIFY), n=T.size(x("issues"))),
    "crop_quality": _plan_over("doc_id, pos, left_edge, top_edge, crop_width, crop_height, crop_score, crop_confidence, oversized, round(area, 3) AS area", _duck_double(_CROPS), scoring.CROP),
    "budget_by_class": Plan(
        " UNION ALL ".join(f"SELECT '{k}' AS class, source, tokens_in, tokens_out, tokens_total, usd FROM <{k}> {k}" for k in RATES),
        **{k: scoring.layered(_BUDGET_ROWS, scoring.budget("n", "tok", k == "low", *r)) for k, r in RATES.items()},
    ),
    "strip_metadata": Plan(
        "SELECT doc_id, pos, <s> AS stripped, <m> AS metadata FROM (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN concat('arXiv:2401.01234v2 [cs.LG] 3 Jan 2024 ', line) WHEN 1 THEN concat(line, ' ICML 24, July 21-27, 2024, Vienna, Austria') ELSE line END AS line FROM <blocks> b) q",
        s=T.strip_metadata(LINE), m=T.is_publication_metadata(LINE),
    ),
    "title_headers": Plan(
        "SELECT doc_id, pos, <h> AS header, <o> AS opening, <l> AS resource FROM <rows> q", rows=_TITLED_LINES, o=T.is_section_opening(LINE), l=T.is_resource_link(LINE),
        h=T.is_title_header(x("body"), x("name"), x("page"), (x("body_key"), x("name_key"), x("body_words"), x("name_words"))),
    ),
    "keyword_lists": Plan("SELECT doc_id, <k> AS keywords, <g> AS tags, <h> AS hint, <c> AS comparable FROM (SELECT doc_id, text AS line FROM documents) q", k=_listed(T.keywords(LINE), "|"), g=_listed(T.tags(LINE), "|"), h=T.section_hint(LINE), c=T.comparable(LINE)),
    "reference_tokens": Plan(
        "SELECT doc_id, <r> AS refs, <k> AS cue FROM (SELECT doc_id, concat(text, ' as Figure ', CAST(doc_id % 7 AS STRING), 'a, fig. 2 and FIG. 2; eq. (', CAST(doc_id % 3 AS STRING), ') see [1, 2]', CASE doc_id % 4 WHEN 0 THEN ' shown above' WHEN 1 THEN ' table' ELSE '' END) AS line FROM documents) q",
        r=_listed(T.reference_tokens(LINE), "|"), k=T.cue_kind(LINE),
    ),
    # Ways in order: told id, equal title, title contained (of the ranges that overlap), range that overlaps, last start before the page, first row.
    "section_by_plan": Plan(
        "SELECT doc_id, part, id AS section, way FROM (SELECT doc_id, part, id, way, row_number() OVER (PARTITION BY doc_id, part ORDER BY way, CASE WHEN way = 4 THEN -a ELSE a END, id) AS rn FROM (SELECT *, CASE WHEN id = told THEN 0 WHEN hint <> '' AND lower(title) = hint THEN 1 "
        "WHEN over AND hint <> '' AND (contains(lower(title), hint) OR contains(hint, lower(title))) THEN 2 WHEN over AND (n_over = 1 OR hint <> '') THEN 3 WHEN a <= page THEN 4 ELSE 5 END AS way FROM (SELECT *, count(CASE WHEN over THEN 1 END) OVER (PARTITION BY doc_id, part) AS n_over FROM "
        "(SELECT i.doc_id, i.part, i.page, i.told, lower(i.hint) AS hint, s.id, s.title, s.a, s.a <= i.page_end AND s.z >= i.page AS over FROM <items> i JOIN <plan> s ON s.doc_id = i.doc_id) m) n) o) r WHERE rn = 1",
        items=_div(_items), plan=x(_plan),
    ),
    "nearest_artifact": Plan(
        "SELECT doc_id, pos, artifact, round(score, 6) AS score FROM (SELECT p.doc_id, p.pos, a.pos AS artifact, 1000 * abs(a.page - p.page) + <gap> + 0.12 * abs(a.w - p.w) / 2 AS score, row_number() OVER (PARTITION BY p.doc_id, p.pos ORDER BY 1000 * abs(a.page - p.page) + <gap> + 0.12 * abs(a.w - p.w) / 2, a.pos) AS rn FROM "
        "(SELECT doc_id, pos, page, y, CAST(length(line) AS DOUBLE) AS w, <cue> AS kind FROM (SELECT doc_id, pos, page, y, concat(line, CASE pos % 6 WHEN 0 THEN ' see the plot' WHEN 1 THEN ' this table' ELSE '' END) AS line FROM <blocks> b) t) p "
        "JOIN (SELECT *, page + d AS near FROM <arts> t CROSS JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) ds) a ON a.doc_id = p.doc_id AND a.near = p.page AND a.kind = p.kind) r WHERE rn = 1",
        gap=x(_gap), cue=T.cue_kind(LINE), arts=x(_arts),
    ),
}
