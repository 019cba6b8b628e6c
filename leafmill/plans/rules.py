"""Rule engines, verification, further predicates, lookups and numeric operators."""

from __future__ import annotations

from leafmill.functions import text as T
from leafmill.functions.dual import E, count, matches, replace, t, x
from leafmill.plans.base import Plan

LINE = x("line")
_sentence_end = matches(LINE, r"[.!?。！？][\x22\x27)\]]*$")
_continues = matches(LINE, r"^[a-z0-9,;:)\]]")
_lead_in = matches(LINE, r"(?i)^(?:definition|theorem|lemma|proposition|corollary|remark|example|proof|assumption|claim)\b(?:\s+\S+){4,}")
_risk = "CAST(<a> % 2 AS BIGINT) AS odd_dollars, <b> - <c> AS braces, <d> - <e> AS environments"
_letters = count(LINE, r"\p{L}")
_joined = lambda a, sep=",": E(f"array_join({a.s}, '{sep}')", f"coalesce(array_to_string({a.d}, '{sep}'), '')")
_symbols = T.symbols(T.TEXT)

QUERIES = {
    "sentence_edges": Plan("SELECT doc_id, pos, <a> AS ends, <b> AS continues, <c> AS lead_in FROM <blocks> b", a=_sentence_end, b=_continues, c=_lead_in),
    "front_matter_title": Plan("SELECT doc_id, pos, line FROM <blocks> b WHERE page = 1 AND y <= 180 AND length(line) BETWEEN 20 AND 220 AND <l> >= 12 AND NOT <s>", l=_letters, s=_sentence_end),
    "merge_pairs": Plan(
        "SELECT doc_id, pos, CASE WHEN prev LIKE '%-' AND <low> THEN 'hyphen' WHEN NOT <pe> AND <low> AND length(prev) + length(line) <= 2200 THEN 'open' ELSE 'no' END AS decision FROM (SELECT doc_id, pos, line, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), '') AS prev FROM <blocks> b) w",
        low=matches(LINE, "^[a-z]"), pe=matches(x("prev"), r"[.!?。！？][\x22\x27)\]]*$"),
    ),
    "needs_analysis": Plan("SELECT d.doc_id, l.quality IS NULL AS needs, coalesce(l.quality = 0, false) AS weak, coalesce(l.quality = 1 AND l.toxic = 0, false) AS complete FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "weak_repair": Plan("SELECT doc_id, attempts FROM (SELECT doc_id, quality, doc_id % 4 AS attempts FROM labels) s WHERE quality = 0 AND attempts < 2"),
    "limit_guard": Plan("SELECT source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) > 420 OR sum(length(text)) > 360000 AS exceeded FROM documents GROUP BY source"),
    "filename_title": Plan("SELECT page_id, <m> AS filename_like FROM (SELECT page_id, lower(regexp_replace(url, '^.*/', '')) AS line FROM pages) p", m=matches(LINE, r"^(?:[0-9][0-9._v-]*|[a-z0-9_-]+\.(?:html|pdf))$")),
    "confidence": Plan("SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value > 1 AND value <= 100 THEN value / 100 ELSE greatest(0, least(1, value)) END AS confidence, CAST(floor(value + 0.5) AS BIGINT) AS rounded, greatest(1, least(12, CAST(floor(value) AS INT))) AS clamped FROM events"),
    "job_status_map": Plan("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'canceled' END AS status, o_orderstatus IN ('O', 'P') AS active FROM orders"),
    "referential_integrity": Plan("SELECT e.doc_id, e.ref, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN l.toxic = 1 THEN 'hidden' ELSE 'ok' END AS state FROM (SELECT doc_id, doc_id + 1 AS ref FROM documents UNION ALL SELECT doc_id, doc_id + 7 FROM documents) e LEFT JOIN labels l ON e.ref = l.doc_id"),
    "digest_join": Plan("SELECT doc_id, pos, digest FROM (SELECT b.doc_id, b.pos, g.k AS digest, row_number() OVER (PARTITION BY b.doc_id, b.pos ORDER BY CASE WHEN b.pos % 5 = g.k THEN 0 WHEN b.page BETWEEN g.a AND g.z THEN 1 ELSE 2 END, g.k) AS rn FROM <blocks> b JOIN (SELECT 0 AS k, 1 AS a, 1 AS z UNION ALL SELECT 1, 2, 3 UNION ALL SELECT 2, 4, 99) g ON b.page BETWEEN g.a AND g.z OR b.pos % 5 = g.k) r WHERE rn = 1"),
    "reference_window": Plan("SELECT conv_id, turn, other FROM (SELECT a.conv_id, a.turn, b.turn AS other, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY abs(a.turn - b.turn), b.turn) AS rn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn AND a.role = b.role) r WHERE rn <= 3"),
    "cache_probe": Plan("SELECT d.doc_id, c.digest IS NOT NULL AS hit FROM (SELECT doc_id, <f> AS digest FROM documents) d LEFT JOIN (SELECT DISTINCT <f> AS digest FROM documents WHERE n_chars > 1500) c ON d.digest = c.digest", f=T.fingerprint(T.TEXT)),
    "before_after": Plan("SELECT doc_id, CASE WHEN before = after THEN 'same' WHEN after = '' THEN 'removed' ELSE 'changed' END AS state FROM (SELECT doc_id, line AS before, <p> AS after FROM <blocks> b) q", p=T.paragraph(LINE)),
    "issue_summary": Plan("SELECT category, severity, n, first_doc FROM (SELECT CASE WHEN n_chars < 80 THEN 'short' WHEN n_chars > 10000 THEN 'long' ELSE 'other' END AS category, CASE WHEN n_chars < 80 THEN 0 WHEN n_chars > 10000 THEN 1 ELSE 2 END AS severity, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2) s"),
    "ocr_score": Plan("SELECT source, CAST(greatest(0, least(100, 100 - 18 * e - 6 * i + CASE WHEN mean > 600 THEN 6 ELSE 0 END)) AS BIGINT) AS score FROM (SELECT source, sum(CASE WHEN n_chars < 20 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN n_chars BETWEEN 20 AND 80 THEN 1 ELSE 0 END) AS i, avg(n_chars) AS mean FROM documents GROUP BY source) s"),
    "first_samples": Plan("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) r WHERE rn <= 20"),
    "issue_order": Plan("SELECT o_orderpriority, place FROM (SELECT o_orderpriority, row_number() OVER (ORDER BY rank_, n DESC, o_orderpriority) AS place FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END AS rank_, count(*) AS n FROM orders GROUP BY 1, 2) s) r"),
    "symbols": Plan("SELECT doc_id, <s> AS symbols, <n> AS n_symbols FROM documents", s=_joined(_symbols), n=T.size(_symbols)),
    "redaction": Plan("SELECT doc_id, sha1(<r>) AS redacted, <n> AS n_found FROM documents", r=replace(replace(T.TEXT, r"(?i)(?:password|token|secret|api_key)=\S+", "[redacted]"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), n=count(T.TEXT, r"(?i)(?:password|token|secret|api_key)=\S+")),
    "adaptive_batch": Plan("SELECT user_id, n, CAST(greatest(1, least(12, ceil(n * 45.0 / (20 * 60 * 3)))) AS BIGINT) AS batch FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) s"),
    "coverage_codes": Plan("SELECT source, CAST(round(100.0 * sum(CASE WHEN quality IS NOT NULL THEN 1 ELSE 0 END) / count(*)) AS BIGINT) AS percent, CAST(sum(coalesce(toxic, 0)) AS BIGINT) AS codes FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source"),
    "cell_rollup": Plan("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus"),
}
