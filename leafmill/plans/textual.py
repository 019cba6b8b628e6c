"""Scalar text operators, predicates and their rollups over the lines of documents."""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.dual import E, count, matches, replace, t, x
from leafmill.plans.base import Plan

LINE, PAGE, ONE = x("line"), x("page"), x("1")
_noise = T.noise_reasons(LINE, PAGE, ONE)
_flags = ", ".join(f"<{k}> AS {k}" for k in _noise)
_sums = ", ".join(f"CAST(sum(CASE WHEN {k} THEN 1 ELSE 0 END) AS BIGINT) AS {k}" for k in _noise)
_first = "CASE " + " ".join(f"WHEN <{k}> THEN '{k}'" for k in _noise) + " ELSE 'kept' END"
_scripts = T.script_counts(x("substring(text, 1, 80000)"))
_compact = t("length(<r>)", r=replace(x("substring(text, 1, 80000)"), r"\s+", ""))
_html = x("html")


def _list(array: E, sep: str = ",") -> E:
    return E(f"array_join({array.s}, '{sep}')", f"coalesce(array_to_string({array.d}, '{sep}'), '')")


QUERIES = {
    "noise_flags": Plan(f"SELECT doc_id, count(*) AS n_lines, {_sums} FROM (SELECT doc_id, {_flags} FROM <blocks> b) f GROUP BY doc_id", **_noise),
    "text_normalize": Plan(
        "SELECT doc_id, pos, sha1(<a>) AS collapsed, sha1(<b>) AS paragraph, sha1(<c>) AS heading, sha1(<d>) AS coverage, sha1(<e>) AS letters, <q> AS query FROM <blocks> b",
        a=T.collapse(LINE), b=T.paragraph(LINE), c=T.heading_text(LINE), d=T.coverage_key(LINE), e=T.letters_key(LINE), q=T.query_text(LINE),
    ),
    "text_keys": Plan(
        "SELECT doc_id, pos, <r> AS repeat_key, <d> AS dedupe_key, <f> AS fingerprint, <k> AS reference_key, <s> AS slug FROM <blocks> b",
        r=T.repeated_key(LINE), d=T.dedupe_key(x("'paragraph'"), PAGE, LINE), f=T.fingerprint(LINE), k=T.reference_key(LINE), s=T.slug(LINE),
    ),
    "text_edges": Plan(
        "SELECT doc_id, pos, <t> AS truncated, <e> AS escaped, <j> AS joined FROM (SELECT doc_id, pos, line, coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS nxt FROM <blocks> b) w",
        t=T.truncate(LINE, 60), e=T.escape_xml(T.truncate(LINE, 100)), j=t("sha1(<v>)", v=T.join_fragments(x("concat(line, '-')"), x("lower(nxt)"))),
    ),
    "script_counts": Plan("SELECT doc_id, " + ", ".join(f"<{k}> AS {k}" for k in _scripts) + " FROM documents", **T.script_counts(T.TEXT)),
    "lang_detect": Plan(
        "SELECT doc_id, CASE WHEN n < 80 THEN 'unknown' WHEN kana > greatest(24, 0.18 * han) THEN concat(p, 'jpn') WHEN hangul > 24 THEN concat(p, 'kor') WHEN han > 24 THEN concat(p, 'chi_sim') WHEN latin > 0.45 * n THEN 'eng' ELSE 'unknown' END AS language "
        "FROM (SELECT doc_id, <n> AS n, <latin> AS latin, <han> AS han, <kana> AS kana, <hangul> AS hangul, CASE WHEN <latin> > 0.18 * <n> THEN 'eng+' ELSE '' END AS p FROM documents) s", n=_compact, **_scripts,
    ),
    "sentence_stats": Plan("SELECT doc_id, <s> AS sentences, <m> AS meaningful, <k> AS tokens FROM documents", s=t("CAST(<s> AS BIGINT)", s=T.sentences(T.TEXT)), m=T.meaningful_chars(T.TEXT), k=T.token_estimate(x("length(text)"))),
    "repeated_lines": Plan(
        "SELECT source, k AS line_key, count(*) AS n, count(DISTINCT concat(CAST(doc_id AS STRING), ':', CAST(page AS STRING))) AS n_pages, min(doc_id) AS first_doc FROM (SELECT source, doc_id, page, <k> AS k FROM <blocks> b) r WHERE k <> '' GROUP BY source, k HAVING count(*) > 1",
        k=T.repeated_key(LINE),
    ),
    "url_types": Plan("SELECT page_id, <n> AS url, <t> AS kind FROM pages", n=T.normal_url(x("url")), t=T.resource_type(x("url"))),
    "link_lines": Plan("SELECT page_id, <l> AS link_line, <a> AS artifact_link, <u> AS urls FROM (SELECT page_id, concat('code at ', url, ' see ', url, ').') AS line FROM pages) p", l=T.is_link_line(LINE), a=T.is_artifact_link(LINE), u=_list(T.urls(LINE), " ")),
    "markup_tags": Plan(
        "SELECT page_id, <o> AS n_open, <c> AS n_close, <a> AS n_attributes, <e> AS n_entities, sha1(<txt>) AS text_sha FROM pages",
        o=count(_html, "<[A-Za-z][^>]*>"), c=count(_html, "</[A-Za-z][^>]*>"), a=count(_html, r"\s[A-Za-z-]+=\x22[^\x22]*\x22"), e=count(_html, "&[a-z]+;"), txt=T.collapse(T.decode_xml(replace(_html, "<[^>]*>", " "))),
    ),
    "label_parse": Plan(
        "SELECT doc_id, <a> AS figure, <b> AS tab, <c> AS equation, <d> AS none FROM documents",
        a=T.label_key(x("concat('Fig. ', CAST(doc_id % 9 AS STRING), '(b) ', text)")), b=T.label_key(x("concat('TABLE ', CAST(doc_id % 5 AS STRING), ': ', text)")), c=T.label_key(x("concat('Equation (', CAST(doc_id % 7 AS STRING), ')')")), d=T.label_key(T.TEXT),
    ),
    "headings": Plan("SELECT doc_id, pos, <h> AS heading, <r> AS reading FROM <blocks> b", h=T.is_heading(LINE), r=t("(length(<c>) >= 20 AND NOT <h> AND NOT <t>)", c=T.collapse(LINE), h=T.is_heading(LINE), t=T.is_references_title(LINE))),
    "markdown_export": Plan(
        "SELECT doc_id, source, count(*) AS n, sha1(<m>) AS markdown_sha FROM (SELECT doc_id, source, pos, CASE WHEN <h> THEN concat('## ', line) ELSE line END AS md FROM <blocks> b) r GROUP BY doc_id, source",
        h=T.is_heading(LINE), m=E("array_join(transform(array_sort(collect_list(struct(pos, md))), v -> v.md), '\\n\\n')", "string_agg(md, chr(10) || chr(10) ORDER BY pos)"),
    ),
    "sentence_first": Plan("SELECT doc_id, <f> AS first_number, <n> AS n_numbers, <m> AS has_secret FROM documents", f=E("regexp_extract(text, r'[0-9]+', 0)", "regexp_extract(text, '[0-9]+', 0)"), n=count(T.TEXT, r"\b[0-9]+\b"), m=matches(T.TEXT, "(?i)password=")),
}
