"""Joins, rollups, ordered and set operators over the lines of documents, dialogues and tables."""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.dual import E, t, x
from leafmill.plans.base import Plan

LINE = x("line")
_words = E(r"filter(split(regexp_replace(lower(text), r'[^\p{L}\p{N}_]+', ' '), ' '), v -> length(v) >= 3)", r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda v: length(v) >= 3)")
_pages = E("explode(sequence(a, least(b, a + 24)))", "unnest(range(a, least(b, a + 24) + 1))")
_secs = E("CAST(unix_timestamp(<b>) - unix_timestamp(<a>) AS BIGINT)", "CAST(floor(epoch(<b>)) - floor(epoch(<a>)) AS BIGINT)")


def seconds(a: str, b: str) -> E:
    return E(_secs.s.replace("<a>", a).replace("<b>", b), _secs.d.replace("<a>", a).replace("<b>", b))


#: Planned sections of a document: up to three page ranges, from its size.
_plan_rows = "(SELECT doc_id, k, 1 + k * 4 AS start_page, 4 + k * 4 AS end_page, CASE WHEN k = 2 THEN 'references' ELSE 'body' END AS role FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) ks)"

QUERIES = {
    # joins
    "coverage_join": Plan("SELECT d.doc_id, l.quality, l.toxic, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "missing_results": Plan("SELECT d.doc_id, d.source FROM documents d LEFT ANTI JOIN labels l ON d.doc_id = l.doc_id".replace("LEFT ANTI", "<anti>"), anti=E("LEFT ANTI", "ANTI")),
    "interval_assign": Plan(
        f"SELECT doc_id, page, n_lines, k AS section, role FROM (SELECT b.doc_id, b.page, b.n_lines, p.k, p.role, row_number() OVER (PARTITION BY b.doc_id, b.page ORDER BY CASE WHEN p.start_page <= b.page AND b.page <= p.end_page THEN 0 WHEN p.start_page <= b.page THEN 1 ELSE 2 END, p.start_page DESC) AS rn FROM (SELECT doc_id, page, count(*) AS n_lines FROM <blocks> x GROUP BY doc_id, page) b JOIN {_plan_rows} p ON b.doc_id = p.doc_id) r WHERE rn = 1",
    ),
    "interval_semi": Plan(f"SELECT b.doc_id, b.page, count(*) AS n FROM <blocks> b WHERE EXISTS (SELECT 1 FROM {_plan_rows} p WHERE p.doc_id = b.doc_id AND p.role <> 'body' AND b.page BETWEEN p.start_page AND p.end_page) GROUP BY b.doc_id, b.page"),
    "interval_anti": Plan(f"SELECT b.doc_id, count(*) AS kept FROM <blocks> b WHERE NOT EXISTS (SELECT 1 FROM {_plan_rows} p WHERE p.doc_id = b.doc_id AND p.role <> 'body' AND b.page BETWEEN p.start_page AND p.end_page) GROUP BY b.doc_id"),
    "nearest_row": Plan(
        "SELECT doc_id, pos, near FROM (SELECT a.doc_id, a.pos, b.pos AS near, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY 1000 * abs(a.page - b.page) + abs(a.y - b.y), b.pos) AS rn FROM (SELECT * FROM <blocks> q WHERE length(line) < 40) a JOIN (SELECT q.*, page + d AS near_page FROM <blocks> q CROSS JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) ds WHERE length(line) >= 200) b ON a.doc_id = b.doc_id AND a.page = b.near_page) r WHERE rn = 1",
    ),
    "artifact_links": Plan(
        "SELECT r.doc_id, r.k AS ref_key, coalesce(e.art, f.art) AS artifact, CASE WHEN e.art IS NOT NULL THEN 0 WHEN f.art IS NOT NULL THEN 1 END AS penalty FROM (SELECT doc_id, <k> AS k, <p> AS parent FROM documents) r "
        "LEFT JOIN (SELECT 'figure:3' AS k, 'fig-3' AS art UNION ALL SELECT 'figure:2a', 'fig-2a' UNION ALL SELECT 'figure:4', 'fig-4') e ON r.k = e.k LEFT JOIN (SELECT 'figure:3' AS k, 'fig-3' AS art UNION ALL SELECT 'figure:4', 'fig-4') f ON r.parent = f.k",
        k=T.label_key(x("concat('Figure ', CAST(doc_id % 6 AS STRING), CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE '' END)")), p=T.label_key(x("concat('Figure ', CAST(doc_id % 6 AS STRING))")),
    ),
    "override_merge": Plan("SELECT coalesce(m.doc_id, d.doc_id) AS doc_id, coalesce(m.quality, CAST(d.n_chars % 2 AS INT)) AS quality, m.doc_id IS NOT NULL AS manual FROM documents d FULL JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 1) m ON d.doc_id = m.doc_id"),
    # rollups
    "quality_rollup": Plan(
        "SELECT source, count(*) AS total, CAST(sum(CASE WHEN n_chars < 80 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS complete, "
        "CAST(round(100.0 * count(l.doc_id) / count(*)) AS BIGINT) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    ),
    "severity_score": Plan(
        "SELECT source, e AS errors, w AS warns, i AS infos, CAST(greatest(0, least(100, 100 - 18 * e - 8 * w - 2 * i)) AS BIGINT) AS score, CASE WHEN e > 0 THEN 'error' WHEN w > 0 THEN 'warn' ELSE 'ok' END AS status FROM (SELECT source, sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS w, sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS i FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source) s".replace("e AS errors, w AS warns, i AS infos", "CAST(e AS BIGINT) AS errors, CAST(w AS BIGINT) AS warns, CAST(i AS BIGINT) AS infos"),
    ),
    "budget": Plan(
        "SELECT source, n, chars, CAST(tok AS BIGINT) AS tokens, CAST(tok + 650 + 180 * n AS BIGINT) AS tokens_in, CAST(ceil(round(tok * 1.35 + 420 * n, 6)) AS BIGINT) AS tokens_out, CAST(ceil(round(tok * 1.05 + 260 * n, 6)) AS BIGINT) AS tokens_out_fast FROM (SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, <k> AS tok FROM documents GROUP BY source) s",
        k=T.token_estimate(x("sum(length(text))")),
    ),
    "section_enrichment": Plan("SELECT doc_id, min(page) AS page_start, max(page) AS page_end, count(*) AS n, min(y) AS top, max(y) + 18 AS bottom FROM <blocks> b WHERE length(line) >= 20 GROUP BY doc_id"),
    "reason_histogram": Plan("SELECT o_orderpriority AS reason, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) AS BIGINT) AS bucket FROM orders GROUP BY o_orderpriority"),
    "library_summary": Plan("SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS n, CAST(sum(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done, max(o.o_orderdate) AS latest FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey, c.c_name"),
    "flatten_rows": Plan("SELECT o.o_orderkey, count(*) AS n_children, CAST(sum(CASE WHEN l.l_returnflag = 'R' OR l.l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_analysed, min(l.l_linenumber) AS first_child FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey"),
    # ordered
    "neighbour_context": Plan("SELECT conv_id, turn, lag(turn, 1) OVER w AS prev_1, lag(turn, 2) OVER w AS prev_2, lag(turn, 3) OVER w AS prev_3, lead(turn, 1) OVER w AS next_1 FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "rows_window": Plan("SELECT conv_id, turn, n_near, chars_near FROM (SELECT conv_id, turn, role, count(*) OVER w AS n_near, CAST(sum(length(text)) OVER w AS BIGINT) AS chars_near FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) r WHERE role = 'assistant'"),
    "section_runs": Plan("SELECT conv_id, run, min(turn) AS first_turn, count(*) AS n FROM (SELECT conv_id, turn, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) a) b GROUP BY conv_id, run".replace("conv_id, run, min", "conv_id, CAST(run AS BIGINT) AS run, min")),
    "first_wins_dedupe": Plan("SELECT source, doc_id, pos, k FROM (SELECT source, doc_id, pos, k, row_number() OVER (PARTITION BY source, k ORDER BY doc_id, pos) AS rn FROM (SELECT source, doc_id, pos, <key> AS k FROM <blocks> b) s) r WHERE rn = 1", key=T.dedupe_key(x("'paragraph'"), x("page"), x("line"))),
    "exact_duplicate_docs": Plan("SELECT substring(sha1(text), 1, 24) AS digest, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY substring(sha1(text), 1, 24)"),
    "running_renumber": Plan("SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY page, y, pos) - 1 AS ord, CAST(round(100.0 * row_number() OVER (PARTITION BY doc_id ORDER BY page, y, pos) / count(*) OVER (PARTITION BY doc_id)) AS BIGINT) AS percent FROM <blocks> b WHERE length(line) >= 20"),
    "section_ends": Plan("SELECT doc_id, start_pos, coalesce(lead(start_pos) OVER (PARTITION BY doc_id ORDER BY start_pos) - 1, last_pos) AS end_pos FROM (SELECT doc_id, pos AS start_pos, max(pos) OVER (PARTITION BY doc_id) AS last_pos, length(line) AS n FROM <blocks> b) s WHERE n < 60"),
    "budgeted_prefix": Plan("SELECT doc_id, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS chars FROM (SELECT doc_id, length(line) AS n, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM <blocks> b) s WHERE before <= 2000 GROUP BY doc_id"),
    "cross_page_score": Plan(
        "SELECT doc_id, pos, score, score >= 6 AS merged FROM (SELECT doc_id, pos, CASE WHEN open_end THEN 4 ELSE 0 END + CASE WHEN low_start THEN 3 ELSE 0 END + CASE WHEN page <> prev_page THEN 1 ELSE 0 END + CASE WHEN hyphen THEN 6 ELSE 0 END AS score FROM (SELECT doc_id, pos, page, lag(page) OVER w AS prev_page, NOT lag(<e>) OVER w AS open_end, <l> AS low_start, coalesce(lag(line) OVER w, '') LIKE '%-' AS hyphen FROM <blocks> b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) s WHERE prev_page IS NOT NULL) r",
        e=E("(line rlike r'[.!?。！？]$')", "regexp_matches(line, '[.!?。！？]$')"), l=E("(line rlike r'^[a-z]')", "regexp_matches(line, '^[a-z]')"),
    ),
    # sorts, limits, search
    "library_order": Plan("SELECT c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment = 'BUILDING' DESC, c_acctbal DESC, c_custkey) AS place FROM customer"),
    "top_n_per_group": Plan("SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) r WHERE rn <= 3"),
    "facet_filter": Plan("SELECT doc_id, source, n_chars FROM documents WHERE lower(source) = 'src3' AND lang = 'en'"),
    # sets and arrays
    "union_distinct": Plan("SELECT doc_id FROM documents WHERE n_chars > 1000 UNION SELECT doc_id FROM labels WHERE quality = 1"),
    "union_all": Plan("SELECT doc_id, 'heuristic' AS origin FROM documents WHERE n_chars < 500 UNION ALL SELECT doc_id, 'label' FROM labels WHERE toxic = 1"),
    "set_difference": Plan("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels"),
    "set_intersection": Plan("SELECT doc_id FROM documents WHERE n_chars > 2000 INTERSECT SELECT doc_id FROM labels"),
    "last_wins_merge": Plan("SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) r WHERE rn = 1"),
    "page_ranges": Plan("SELECT doc_id, count(DISTINCT p) AS n_pages, min(p) AS first_page, max(p) AS last_page FROM (SELECT doc_id, <p> AS p FROM (SELECT doc_id, CAST(1 + doc_id % 7 AS INT) AS a, CAST(1 + doc_id % 7 + n_chars % 40 AS INT) AS b FROM documents) r) e GROUP BY doc_id", p=_pages),
    "manifest": Plan("SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events"),
    # time and the job log
    "delta_seconds": Plan("SELECT user_id, event_id, coalesce(greatest(<d>, 0), 0) AS seconds FROM (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) w", d=seconds("before", "ts")),
    "queue_status": Plan("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS n_jobs, max(ts) AS latest FROM events GROUP BY event_type"),
    "dequeue_oldest": Plan("SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'view') r WHERE rn = 1"),
    "newest_active": Plan("SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'view') r WHERE rn = 1"),
    "reserve_batches": Plan("SELECT user_id, <d> AS batch, count(*) AS n, min(event_id) AS first_item FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events) r GROUP BY user_id, <d>", d=E("CAST(rn DIV 12 AS BIGINT)", "CAST(rn // 12 AS BIGINT)")),
    "batch_split": Plan("SELECT user_id, n, depth, CAST(CASE WHEN depth >= 4 THEN 1 ELSE greatest(1, ceil(n / power(2, depth))) END AS BIGINT) AS batch FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) e CROSS JOIN (SELECT 0 AS depth UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) d"),
    "crash_recovery": Plan("SELECT event_id, CASE WHEN event_type = 'click' THEN 'queued' WHEN event_type = 'purchase' THEN 'done' WHEN event_type = 'view' THEN 'queued' ELSE 'canceled' END AS status, value > 50 AS external FROM events"),
    "retention": Plan("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) r WHERE rn <= 20"),
    "median_unit_time": Plan("SELECT event_type, CAST(median(value) AS DOUBLE) AS median_value, count(*) AS n FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) r WHERE rn <= 8 GROUP BY event_type"),
    "eta_blend": Plan("SELECT user_id, CAST(round(0.35 * ceil(ceil(n / 12.0) / 3.0) * 45 + 0.65 * n * 3) AS BIGINT) AS seconds, 45 * ceil(n / 12.0) > 45 AS slow FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) s"),
    "job_progress": Plan("SELECT user_id, count(*) AS total, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS done, CAST(round(100.0 * sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*)) AS BIGINT) AS percent FROM events GROUP BY user_id"),
    "exact_lookup": Plan("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42"),
    # geometry of line boxes
    "box_overlap": Plan(
        "SELECT a.doc_id, a.pos, b.pos AS other, round(greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) * least(a.w, b.w) / greatest(1, a.w * a.h), 6) AS own_share, round(greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) / least(a.h, b.h), 6) AS axis_share, greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) AS gap FROM <box> a JOIN <box> b ON a.doc_id = b.doc_id AND a.page = b.page AND b.pos = a.pos + 1",
        box=x("(SELECT doc_id, pos, page, y, CAST(1 + length(line) AS DOUBLE) AS w, CAST(12 + length(line) % 14 AS DOUBLE) AS h FROM <blocks> q)"),
    ),
    "crop_clamp": Plan("SELECT doc_id, pos, greatest(x, 0) AS left_edge, least(x + w, 612) - greatest(x, 0) AS width, round((least(x + w, 612) - greatest(x, 0)) / 612, 3) AS width_ratio, x < 0 OR x + w > 612 AS clamped FROM (SELECT doc_id, pos, CAST(pos % 60 - 20 AS DOUBLE) AS x, CAST(40 + length(line) AS DOUBLE) AS w FROM <blocks> b) s"),
    "box_union": Plan("SELECT doc_id, page, min(y) AS top, max(y + 12) AS bottom, CAST(max(length(line)) AS BIGINT) AS width, count(*) AS n FROM <blocks> b GROUP BY doc_id, page"),
    "reading_order": Plan(
        "SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, side, y, pos) AS ord FROM (SELECT doc_id, pos, page, y, side, sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band FROM (SELECT doc_id, pos, page, y, CASE WHEN length(line) > 300 THEN 0 WHEN pos % 2 = 0 THEN 1 ELSE 2 END AS side FROM <blocks> b) s) r",
    ),
}
# Documents are the source, items of 36 characters the blocks; every token of both counts, and every match stays.
QUERIES["token_overlap_match"] = Plan(
    "WITH d AS (SELECT doc_id, <n> AS n_doc, <each> AS w FROM (SELECT doc_id, <distinct> AS ws FROM documents) q), i AS (SELECT item_id AS item, <n> AS n_item, <each> AS w FROM (SELECT item_id, <words> AS ws FROM benchmark WHERE length(text) >= 36) q), b AS (SELECT item, n_item, w, count(*) AS c FROM i GROUP BY item, n_item, w) "
    "SELECT doc_id, item, shared, round(score, 6) AS score FROM (SELECT doc_id, item, CAST(sum(c) AS BIGINT) AS shared, CAST(sum(c) AS DOUBLE) / least(n_doc, n_item) AS score FROM d JOIN b ON d.w = b.w GROUP BY doc_id, item, n_doc, n_item) s WHERE score >= CAST(0.62 AS DOUBLE)",
    n=T.size(x("ws")), each=E("explode(ws)", "unnest(ws)"), distinct=E(f"array_distinct({_words.s})", f"list_distinct({_words.d})"), words=_words,
)
