"""Mixed-block rescue over documents: eight lines are a block, a line's length is its width.

The SQL walks the lines one by one with the state of the walk in the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import rescue as R
from leafmill.functions import text as T
from leafmill.functions.dual import x
from leafmill.operators import rescue
from leafmill.plans.base import BLOCKS, spread

KEY = ["doc_id", "page"]


def mixed_block_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    lines = spark.sql(f"SELECT doc_id, page, pos AS line, line AS text, CAST(0 AS DOUBLE) AS x, y, CAST(length(line) AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM {BLOCKS.s} b".replace("FROM documents", "FROM leafmill_documents"))
    held = F.array_sort(F.collect_list(F.struct("line", "text")))
    blocks = lines.groupBy(*KEY).agg(F.array_join(F.transform(held, lambda v: v["text"]), "\n").alias("text")).withColumn("block", F.col("page"))
    out = rescue.rescue(blocks.select("doc_id", "block", "page", "text"), lines.withColumnRenamed("page", "block"), ["doc_id", "block"])
    return out.select("doc_id", F.col("block").alias("page"), "nth", "reason", F.sha1("text").alias("text_sha"), "start", "end", "n_lines", "y", "width", "height")


QUERIES = {"mixed_block_rescue": mixed_block_rescue}

_kinds = R.line_kinds(x("bare"), x("page"))
ORACLES = {
    "mixed_block_rescue": f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT * FROM (SELECT doc_id, page, text, {T.collapse(x("text")).d} AS whole FROM (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM {BLOCKS.d} l GROUP BY doc_id, page) q) r
  WHERE length(whole) >= 120 AND {R.is_noisy_block(x("whole"), x("page")).d} AND NOT {T.is_extraction_garbage(x("text")).d}),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS nth, count(*) OVER (PARTITION BY doc_id, page) AS n_all FROM (SELECT l.doc_id, l.page, l.pos, l.y, CAST(length(l.line) AS DOUBLE) AS width, b.whole, {T.collapse(x("l.line")).d} AS own
  FROM {BLOCKS.d} l JOIN b ON b.doc_id = l.doc_id AND b.page = l.page WHERE length(l.line) > 0) q WHERE own <> ''),
k AS MATERIALIZED (SELECT *, {_kinds["noise"].d} AS noise, {_kinds["body"].d} AS body, {_kinds["goes_on"].d} AS goes_on FROM (SELECT *, {T.strip_metadata(x("own")).d} AS bare FROM l WHERE n_all >= 2) q),
s(doc_id, page, nth, saw, inside, grp) AS (
  SELECT doc_id, page, 0::BIGINT, false, false, 0::BIGINT FROM k WHERE nth = 1
  UNION ALL SELECT k.doc_id, k.page, k.nth, s.saw OR k.noise, j.inside, CASE WHEN j.inside AND NOT s.inside THEN s.grp + 1 ELSE s.grp END
  FROM s JOIN k ON k.doc_id = s.doc_id AND k.page = s.page AND k.nth = s.nth + 1, LATERAL (SELECT NOT k.noise AND s.saw AND (k.body OR (s.inside AND k.goes_on)) AS inside) j),
g AS (SELECT k.doc_id, k.page, s.grp, string_agg(k.own, ' ' ORDER BY k.nth) AS joined, arg_min(k.own, k.nth) AS own, any_value(k.whole) AS whole, count(*) AS n_lines, min(k.y) AS y, max(k.width) AS width, max(k.y + 12) - min(k.y) AS height
  FROM s JOIN k USING (doc_id, page, nth) WHERE s.inside GROUP BY k.doc_id, k.page, s.grp),
u AS MATERIALIZED (SELECT *, greatest(instr(whole, substr(own, 1, 24)) - 1, 0) AS place FROM (SELECT *, {R.cleaned(x("joined")).d} AS text FROM g) q WHERE {R.is_useful(x("text")).d}),
t AS MATERIALIZED (SELECT *, {R.mail_end(x("whole")).d} AS mail FROM (SELECT *, {T.strip_metadata(x("whole")).d} AS clean FROM b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.doc_id = b.doc_id AND u.page = b.page)) q WHERE length(clean) >= 80),
f AS MATERIALIZED (SELECT * FROM (SELECT *, {R.body_start(x("clean"), x("search")).d} AS place FROM (SELECT *, least(length(clean) - 1, greatest(mail, CAST(floor(length(clean) * 0.22) AS INT))) AS search FROM t) q) r WHERE place IS NOT NULL),
h AS (SELECT *, {R.cleaned(x("substring(clean, CAST(place AS INT) + 1)")).d} AS body, instr(whole, substr(clean, CAST(place AS INT) + 1, 24)) - 1 AS raw_at FROM f)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY grp) - 1 AS nth, 'mixed-block-line-rebuild' AS reason, sha1(text) AS text_sha, place::BIGINT AS start, (place + length(text))::BIGINT AS "end", n_lines, y, width, height FROM u
UNION ALL SELECT doc_id, page, 0, 'mixed-block-body-tail', sha1(body), CASE WHEN raw_at > 0 THEN raw_at ELSE place END::BIGINT, (CASE WHEN raw_at > 0 THEN raw_at ELSE place END + length(body))::BIGINT, NULL, NULL, NULL, NULL FROM h""",
}
