"""Sections from headings, chunk maps, page choices, gaps, titles and estimates over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import E, count, t, x
from leafmill.operators import providers, structure
from leafmill.plans.base import BLOCKS, Plan, spread

_TITLED = "SELECT doc_id, page, pos, CASE WHEN pos % 5 = 0 THEN concat(CAST(1 + CAST(floor(pos / 10) AS BIGINT) AS STRING), '. Method') WHEN pos % 7 = 3 THEN 'Results' WHEN pos = 60 THEN 'References' ELSE line END AS text FROM <blocks> b"


def infer_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    return structure.infer_sections(spark.sql(t(_TITLED, blocks=BLOCKS).s.replace("FROM documents", "FROM leafmill_documents")), ["doc_id"])


def provider_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in provider: word counts; it rejects batches that hold a row with a multiple of 97 as id."""

    def call(batch):
        if (batch["doc_id"] % 97 == 0).any():
            raise ValueError("rejected")
        return batch.assign(n_words=batch["text"].fillna("").str.split().str.len())[["doc_id", "n_words"]]

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return providers.call_in_batches(docs, "doc_id", call, "n_words long").select("doc_id", "n_words", "status", F.col("error"))


_text = x("text")


def sections_sql(titled: str) -> str:
    """Sections of a DuckDB subquery of lines (doc_id, page, pos, text), by recursion."""
    return t(
        "WITH RECURSIVE f AS (SELECT doc_id, page, pos, <title> AS title, regexp_extract(text, '^\\s*([1-9](?:\\.\\d+)*)\\.?\\s+', 1) AS number, <h> AS h, <r> AS r FROM (<titled>) b), "
        "w AS (SELECT doc_id, min(page) AS a, max(page) AS z, min(CASE WHEN r THEN page END) AS refs FROM f GROUP BY doc_id), e AS (SELECT doc_id, CASE WHEN refs IS NULL THEN z ELSE greatest(a, refs - 1) END AS body_end FROM w), "
        "g AS (SELECT f.doc_id, lower(f.title) AS name, f.page, arg_min(f.title, f.pos) AS title, arg_min(f.number, f.pos) AS number, min(f.pos) AS pos, any_value(e.body_end) AS body_end FROM f JOIN e ON e.doc_id = f.doc_id WHERE f.h AND NOT f.r AND f.title <> '' AND f.page <= e.body_end GROUP BY f.doc_id, lower(f.title), f.page), "
        "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY page) AS rn FROM g), k AS (SELECT doc_id, name, page, rn, page AS last, true AS keep FROM n WHERE rn = 1 UNION ALL "
        "SELECT n.doc_id, n.name, n.page, n.rn, CASE WHEN n.page - k.last > 1 THEN n.page ELSE k.last END, n.page - k.last > 1 FROM k JOIN n ON n.doc_id = k.doc_id AND n.name = k.name AND n.rn = k.rn + 1), "
        "o AS (SELECT n.*, CASE WHEN min(CASE WHEN n.number <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY n.doc_id, n.page) = 1 THEN list_transform(string_split(n.number, '.'), lambda v: CAST(v AS BIGINT)) END AS parts FROM n JOIN k ON k.doc_id = n.doc_id AND k.name = n.name AND k.rn = n.rn WHERE k.keep) "
        "SELECT doc_id, row_number() OVER v - 1 AS ord, title, page AS start_page, greatest(page, coalesce(lead(page) OVER v - 1, body_end)) AS end_page FROM o WINDOW v AS (PARTITION BY doc_id ORDER BY page, parts NULLS FIRST, pos)",
        title=T.heading_text(_text), h=T.is_heading(_text), r=T.is_references_title(_text), titled=E("", titled),
    ).d.replace("AS STRING", "AS VARCHAR")

_numbers = E("regexp_extract_all(spec, r'([0-9]+)', 1)", "regexp_extract_all(spec, '([0-9]+)', 1)")
_spec_pages = E(f"explode(sequence(CAST({_numbers.s}[0] AS INT), CAST(element_at({_numbers.s}, -1) AS INT)))", f"unnest(range(CAST({_numbers.d}[1] AS INT), CAST({_numbers.d}[-1] AS INT) + 1))")
_letters = count(x("line"), r"\p{L}")

PLANS = {
    "vertical_gaps": Plan(
        "SELECT doc_id, page, n_lines, n_lines >= 4 AND coalesce(gap > greatest(22, 2.2 * mid), false) AS large_gap FROM (SELECT doc_id, page, count(*) AS n_lines, max(gap) AS gap, median(height) AS mid FROM (SELECT doc_id, page, height, top - lag(top + height) OVER (PARTITION BY doc_id, page ORDER BY top, pos) AS gap "
        "FROM (SELECT doc_id, page, pos, CAST(y + CASE WHEN pos % 13 > 6 THEN 40 ELSE 0 END AS DOUBLE) AS top, CAST(8 + pos % 5 AS DOUBLE) AS height FROM <blocks> b) p) q GROUP BY doc_id, page) r"
    ),
    "chunk_map": Plan("SELECT doc_id, chunk, min(page) AS start_page, max(page) AS end_page, count(*) AS n, min(pos) AS first_paragraph, max(pos) AS last_paragraph FROM (SELECT doc_id, page, pos, CAST(floor((page - 1) / 3) AS BIGINT) AS chunk FROM <blocks> b WHERE length(line) >= 20) q GROUP BY doc_id, chunk"),
    "map_merge": Plan("SELECT coalesce(p.doc_id, m.doc_id) AS doc_id, coalesce(p.quality, m.n) AS value, p.doc_id IS NOT NULL AS replaced FROM (SELECT doc_id, CAST(n_chars AS INT) AS n FROM documents) m FULL JOIN labels p ON p.doc_id = m.doc_id"),
    "best_page": Plan(
        "SELECT doc_id, item, page, score FROM (SELECT doc_id, item, page, score, row_number() OVER (PARTITION BY doc_id, item ORDER BY CASE WHEN page = wanted THEN 0 ELSE 1 END, score DESC, chars DESC, n DESC, page) AS rn FROM (SELECT doc_id, item, wanted, page, CAST(sum(length(line) % 7) AS BIGINT) AS score, CAST(sum(length(line)) AS BIGINT) AS chars, count(*) AS n "
        "FROM (SELECT *, pos % 3 AS item, 1 + (doc_id + pos % 3) % 4 AS wanted FROM <blocks> b WHERE length(line) % 7 > 1) q GROUP BY doc_id, item, wanted, page) g) r WHERE rn = 1"
    ),
    "title_inference": Plan(
        "SELECT d.doc_id, coalesce(f.line, g.line, concat('doc-', CAST(d.doc_id AS STRING))) AS title FROM documents d LEFT JOIN (SELECT doc_id, min_by(line, pos) AS line FROM <blocks> b WHERE page = 1 AND y <= 180 AND length(line) BETWEEN 20 AND 220 AND <l> >= 12 AND NOT <s> GROUP BY doc_id) f ON f.doc_id = d.doc_id "
        "LEFT JOIN (SELECT doc_id, min_by(line, pos) AS line FROM <blocks> b WHERE pos < 5 AND length(line) BETWEEN 20 AND 180 GROUP BY doc_id) g ON g.doc_id = d.doc_id", l=_letters, s=T.ends_sentence(x("line")),
    ),
    "spec_pages": Plan("SELECT doc_id, count(DISTINCT page) AS n_pages, min(page) AS first_page, max(page) AS last_page FROM (SELECT doc_id, <p> AS page FROM (SELECT doc_id, concat('p.', CAST(1 + doc_id % 5 AS STRING), CASE WHEN doc_id % 2 = 0 THEN concat('-', CAST(6 + doc_id % 9 AS STRING)) ELSE '' END) AS spec FROM documents) s) e GROUP BY doc_id", p=_spec_pages),
    "section_levels": Plan("SELECT doc_id, pos, number, CASE WHEN number = '' THEN 1 ELSE length(number) - length(replace(number, '.', '')) + 1 END AS level FROM (SELECT doc_id, pos, <n> AS number FROM (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN '3.1.2 Deep' WHEN 1 THEN '4 Flat' ELSE line END AS line FROM <blocks> b) q) r", n=E("regexp_extract(line, r'^([0-9]+(?:[.][0-9]+)*)[.]?[ ]', 1)", "regexp_extract(line, '^([0-9]+(?:[.][0-9]+)*)[.]?[ ]', 1)")),
    "static_estimates": Plan("SELECT user_id, CAST(greatest(20, 18 * n) AS BIGINT) AS ocr_seconds, CAST(ceil(ceil(n / 12.0) / 3) * 45 AS BIGINT) AS analysis_seconds, CAST(greatest(10, least(90, 3 * n)) AS BIGINT) AS validation_seconds FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) s"),
    "requeue_incomplete": Plan("SELECT e.event_id, CASE WHEN l.doc_id IS NULL AND e.event_type = 'purchase' THEN 'queued' WHEN e.event_type = 'purchase' THEN 'done' ELSE 'other' END AS status FROM events e LEFT JOIN labels l ON l.doc_id = e.event_id"),
    "cancel_cascade": Plan("SELECT e.event_id, CASE WHEN e.event_type = 'purchase' THEN 'done' WHEN c.user_id IS NOT NULL AND e.ts >= c.at THEN 'canceled' ELSE 'queued' END AS status FROM events e LEFT JOIN (SELECT user_id, min(ts) AS at FROM events WHERE value > 90 GROUP BY user_id) c ON c.user_id = e.user_id"),
    "tool_signals": Plan("SELECT event_id, <a> AS errors, <b> AS skipped, <c> AS pages FROM (SELECT event_id, concat('page ', CAST(event_id % 9 AS STRING), ': ', CASE event_id % 3 WHEN 0 THEN 'ERROR no text' WHEN 1 THEN 'skipping page' ELSE 'ok' END) AS line FROM events) q", a=count(x("line"), r"(?i)\berror\b"), b=count(x("line"), r"(?i)\bskip\w*"), c=count(x("line"), r"(?i)\bpage\s+\d+")),
}
QUERIES = PLANS | {"infer_sections": infer_sections, "provider_batches": provider_batches}
ORACLES = {k: p.sql.d for k, p in PLANS.items()} | {
    "infer_sections": sections_sql(t(_TITLED, blocks=BLOCKS).d),
    "provider_batches": "SELECT doc_id, CASE WHEN doc_id % 97 <> 0 THEN CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda v: v <> '')) AS BIGINT) END AS n_words, CASE WHEN doc_id % 97 = 0 THEN 'error' ELSE 'done' END AS status, CASE WHEN doc_id % 97 = 0 THEN 'ValueError: rejected' END AS error FROM documents",
}
