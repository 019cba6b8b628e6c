"""Edits, digests, contexts, answers of models and packages over the dialogues: a conversation is a document, a turn a paragraph, a role a section.

Their SQL is written by itself: it tells what must come out from how the inputs were made.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import x
from leafmill.operators import edits, providers, search
from leafmill.sources import packages, regions



def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def paragraph_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    rows = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("kind"), "text", F.col("role").alias("section"), F.lit(True).alias("eligible"), F.lit("done").alias("analysis"))
    action = F.element_at(F.array(*[F.lit(a) for a in edits.PARAGRAPH_ACTIONS]), (F.pmod(F.col("conv_id") + 2 * F.col("turn"), F.lit(5)) + 1).cast("int"))
    half = (F.length("text") / 2).cast("int")
    ed = t.filter("(conv_id + turn) % 3 = 0").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), F.lit(1).cast("long").alias("at"), action.alias("action"), F.substring("text", F.lit(1), half).alias("first"), F.substring("text", half + 1, F.length("text")).alias("second"), F.lit("moved").alias("section"))
    out = edits.edit_paragraphs(rows, ed)
    return out.select("doc", "ord", "part", "state", "section", "eligible", F.col("analysis").isNull().alias("reset"), F.sha1("text").alias("text_sha"))


def section_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 8)
    art = t.select("conv_id", "role", F.concat(F.lit("a"), F.col("turn") % 3).alias("artifact_id"), F.when(F.col("turn") % 2 == 0, "formula").otherwise("table").alias("kind"))
    out = edits.section_digests(t.select("conv_id", "role", F.col("turn").alias("ord"), "text"), art, ["conv_id", "role"], words, F.array().cast("array<string>"))
    return out.select("conv_id", "role", "members", "first", "last", F.array_join("terms", ",").alias("terms"), "fingerprint", F.array_join("formulas", ",").alias("formulas"), F.array_join("visuals", ",").alias("visuals"))


def paragraph_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir).select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("section"), "text")
    sections = t.groupBy("conv_id", "section").agg(F.concat(F.lit("Turns of "), F.col("section")).alias("title"), F.concat(F.lit("From turn "), F.min("ord")).alias("summary"))
    return edits.paragraph_context(t, sections, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), F.sha1("context").alias("context_sha"))


def model_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as models write them: bare lists, lists under a name, objects by id, with and without fences."""
    item = F.struct(F.col("turn").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = F.to_json(F.array_sort(F.collect_list(item)))
    kind = F.col("conv_id") % 3
    answer = F.when(kind == 0, F.col("rows")).when(kind == 1, F.concat(F.lit('{"items":'), F.col("rows"), F.lit("}"))).otherwise(F.concat(F.lit('Here:\n```json\n{"results":'), F.col("rows"), F.lit("}\n```")))
    answers = _turns(spark, sf_dir).groupBy("conv_id").agg(rows.alias("rows")).select("conv_id", answer.alias("text"))
    out = regions.model_items(answers, ["conv_id"])
    return out.select("conv_id", "paragraph_id", F.sha1(F.get_json_object("item", "$.text")).alias("text_sha"))


def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three regions to each page, in three spellings; one is off the page when the id ends in 7."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.length("html").alias("n"))
    text = F.format_string(
        '{"regions":[{"type":"chart","bbox":[%d,10,100,50],"score":%d},{"visualType":"Equation","x":10,"top":"20","w":30,"height":40,"confidence":0.3},{"type":"%s","left":1,"y":2,"width":3,"h":4}]}',
        F.when(F.col("page_id") % 10 == 7, 700).otherwise(F.col("n") % 600), F.col("n") % 90 + 10, F.when(F.col("page_id") % 2 == 0, "table").otherwise("map"),
    )
    pages = p.select("page_id", F.lit(1).cast("long").alias("page"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), text.alias("regions"))
    return regions.page_regions(pages, ["page_id"]).select("page_id", "kind", "x", "y", "width", "height", F.round("score", 4).alias("score"), "confidence")


def chunk_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three turns; turns of number 4 fail."""

    def call(frame: pd.DataFrame) -> pd.DataFrame:
        if (frame["turn"] == 4).any():
            raise TimeoutError("slow")
        return pd.DataFrame({"turn": frame["turn"], "n_chars": frame["text"].fillna("").str.len()})

    def local(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"turn": frame["turn"], "n_chars": [-1] * len(frame)})

    return providers.call_by_chunks(_turns(spark, sf_dir).select("conv_id", "turn", "text"), ["conv_id"], "turn", 3, call, local, "turn long, n_chars long").select("conv_id", "turn", "n_chars", "source", "reason")


def docx_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "heading").otherwise("paragraph").alias("kind"), F.col("text").alias("source_text"))
    return packages.docx(rows, "paper_id").select("paper_id", F.sha1("docx").alias("docx_sha"), F.length("docx").alias("size"))


QUERIES = {
    "paragraph_edits": paragraph_edits, "section_digests": section_digests, "paragraph_context": paragraph_context, "model_items": model_items, "page_regions": page_regions, "chunk_calls": chunk_calls, "docx_export": docx_export,
}

_CUT = "CASE WHEN length({c}) <= {n} THEN {c} ELSE trim(substr({c}, 1, {n} - 1)) || '…' END"
ORACLES = {
    "section_digests": """
WITH w AS (SELECT conv_id, role, turn, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS term, unnest(range(1, 1 + len(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')))) AS k FROM conversations),
f AS (SELECT conv_id, role, term, min(turn * 1000000 + k) AS spot FROM w WHERE length(term) >= 8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY spot) AS rn FROM f),
t AS (SELECT conv_id, role, string_agg(term, ',' ORDER BY spot) AS terms FROM r WHERE rn <= 24 GROUP BY ALL),
a AS (SELECT conv_id, role, string_agg(DISTINCT CASE WHEN turn % 2 = 0 THEN 'a' || (turn % 3) END, ',' ORDER BY CASE WHEN turn % 2 = 0 THEN 'a' || (turn % 3) END) AS formulas, string_agg(DISTINCT CASE WHEN turn % 2 = 1 THEN 'a' || (turn % 3) END, ',' ORDER BY CASE WHEN turn % 2 = 1 THEN 'a' || (turn % 3) END) AS visuals FROM conversations GROUP BY ALL)
SELECT c.conv_id, c.role, count(*) AS members, min(turn) AS first, max(turn) AS last, coalesce(any_value(t.terms), '') AS terms, substr(sha1(string_agg(sha1(coalesce(text, '')), ',' ORDER BY turn)), 1, 24) AS fingerprint, coalesce(any_value(a.formulas), '') AS formulas, coalesce(any_value(a.visuals), '') AS visuals
FROM conversations c LEFT JOIN t ON t.conv_id = c.conv_id AND t.role = c.role LEFT JOIN a ON a.conv_id = c.conv_id AND a.role = c.role GROUP BY c.conv_id, c.role""",
    "paragraph_context": f"""
WITH s AS (SELECT conv_id, role, 'Turns of ' || role AS title, 'From turn ' || min(turn) AS summary FROM conversations GROUP BY conv_id, role),
n AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations),
x AS (SELECT n.conv_id, n.turn, concat_ws(chr(10) || chr(10), 'Section: ' || title, 'Summary: ' || summary, CASE WHEN b <> '' THEN 'Before: ' || {_CUT.format(c="b", n=180)} END, CASE WHEN a <> '' THEN 'After: ' || {_CUT.format(c="a", n=140)} END) AS c FROM n JOIN s ON s.conv_id = n.conv_id AND s.role = n.role)
SELECT conv_id, turn, sha1({_CUT.format(c="c", n=1100)}) AS context_sha FROM x""",
    "model_items": "SELECT conv_id, CAST(turn AS VARCHAR) AS paragraph_id, sha1(coalesce(text, '')) AS text_sha FROM conversations",
    "page_regions": """
WITH p AS (SELECT page_id, length(html) AS n, page_id % 10 = 7 AS off FROM pages)
SELECT page_id, 'figure' AS kind, (n % 600)::DOUBLE AS x, 10.0::DOUBLE AS y, least(100, 612 - n % 600)::DOUBLE AS width, 50.0::DOUBLE AS height, round((n % 90 + 10) / 100.0::DOUBLE, 4) AS score, CASE WHEN (n % 90 + 10) / 100.0::DOUBLE < 0.45 THEN 'low' ELSE 'high' END AS confidence FROM p WHERE NOT off
UNION ALL SELECT page_id, 'formula', 10.0, 20.0, 30.0, 40.0, 0.3, 'low' FROM p
UNION ALL SELECT page_id, 'table', 1.0, 2.0, 3.0, 4.0, NULL, 'high' FROM p WHERE page_id % 2 = 0""",
    "chunk_calls": "SELECT conv_id, turn, CASE WHEN turn = 4 THEN -1 ELSE length(coalesce(text, '')) END AS n_chars, CASE WHEN turn = 4 THEN 'fallback' ELSE 'call' END AS source, CASE WHEN turn = 4 THEN 'TimeoutError: slow' END AS reason FROM conversations",
    "paragraph_edits": """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
  CASE WHEN role <> 'system' AND (conv_id + turn) % 3 = 0 THEN ['mark-noise', 'restore', 'merge-next', 'split', 'set-section'][(conv_id + 2 * turn) % 5 + 1] END AS action FROM conversations),
m AS (SELECT conv_id, n, action = 'merge-next' AND next_role IS NOT NULL AND next_role <> 'system' AS takes, false AS taken FROM r WHERE n = 1
  UNION ALL SELECT r.conv_id, r.n, NOT coalesce(m.takes, false) AND r.action = 'merge-next' AND r.next_role IS NOT NULL AND r.next_role <> 'system', coalesce(m.takes, false) FROM m JOIN r ON r.conv_id = m.conv_id AND r.n = m.n + 1),
j AS (SELECT r.*, coalesce(m.takes, false) AS takes FROM r JOIN m ON m.conv_id = r.conv_id AND m.n = r.n WHERE NOT m.taken),
s AS (SELECT *, trim(substr(text, 1, length(text) // 2)) AS f, trim(substr(text, length(text) // 2 + 1)) AS g FROM j),
t AS (SELECT *, CASE WHEN action IS NULL THEN '' WHEN action = 'merge-next' THEN CASE WHEN takes THEN action ELSE 'refused' END WHEN action = 'split' THEN CASE WHEN f <> '' AND g <> '' THEN action ELSE 'refused' END ELSE action END AS state FROM s),
u AS (SELECT *, unnest(CASE WHEN state = 'split' THEN [0, 1] ELSE [0] END) AS part FROM t)
SELECT conv_id AS doc, turn AS ord, part, state, CASE WHEN state = 'set-section' THEN 'moved' ELSE role END AS section, state <> 'mark-noise' AS eligible, state NOT IN ('', 'refused') AS reset,
  sha1(CASE WHEN state = 'merge-next' AND text LIKE '%-' AND regexp_matches(next_text, '^[a-z]') THEN substr(text, 1, length(text) - 1) || next_text WHEN state = 'merge-next' THEN trim(text || ' ' || next_text) WHEN state = 'split' AND part = 0 THEN f WHEN state = 'split' THEN g ELSE text END) AS text_sha FROM u""",
}


# -- search and glossaries: the terms are words of the benchmark's items ------------------------------------

_WORDS = "[^a-z]+"


def _glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), _WORDS), lambda v: F.length(v) >= 6)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(w.alias("w")).filter("size(w) >= 2")
    return rows.select(F.get("w", F.lit(0)).alias("term"), F.get("w", F.lit(1)).alias("alias")).groupBy("term").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def terminology(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.glossary_matches(docs, ["doc_id"], _glossary(spark, sf_dir))


def unused_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a document that its first 200 characters, as its output, don't have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search.dropped_terms(docs, docs.withColumn("text", F.substring("text", 1, 200)), ["doc_id"], _glossary(spark, sf_dir))


def corpus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.search(docs, ["source", "lang", "text"], " Tion").select("doc_id", "at", F.sha1("snippet").alias("snippet_sha"))


QUERIES |= {"terminology": terminology, "unused_terms": unused_terms, "corpus_search": corpus_search}

_COMPARABLE = T.comparable
_GLOSSARY = f"""
g AS (SELECT w[1] AS term, w[2] AS alias FROM (SELECT list_filter(string_split_regex(lower(coalesce(text, '')), '{_WORDS}'), lambda v: length(v) >= 6) AS w FROM benchmark) q WHERE len(w) >= 2),
v AS (SELECT term, {_COMPARABLE(x("term")).d} AS v FROM g UNION SELECT term, {_COMPARABLE(x("alias")).d} FROM g)"""
ORACLES |= {
    "terminology": f"WITH {_GLOSSARY}, d AS (SELECT doc_id, {_COMPARABLE(x('text')).d} AS c FROM documents) SELECT DISTINCT d.doc_id, v.term FROM d JOIN v ON contains(d.c, v.v)",
    "unused_terms": f"WITH {_GLOSSARY}, d AS (SELECT doc_id, {_COMPARABLE(x('text')).d} AS c FROM documents), o AS (SELECT doc_id, {_COMPARABLE(x('substr(text, 1, 200)')).d} AS c FROM documents) SELECT DISTINCT d.doc_id, v.term FROM d JOIN v ON contains(d.c, v.v) EXCEPT SELECT o.doc_id, v.term FROM o JOIN v ON contains(o.c, v.v)",
    "corpus_search": "SELECT doc_id, at_ AS \"at\", sha1(CASE WHEN at_ > 57 THEN '...' || substr(w, CAST(at_ - 56 AS INT), 180) ELSE substr(w, 1, 180) END) AS snippet_sha FROM (SELECT doc_id, w, instr(lower(w), 'tion') AS at_ FROM (SELECT doc_id, concat_ws(' ', source, lang, text) AS w FROM documents) q) r WHERE at_ > 0",
}
