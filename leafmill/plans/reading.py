"""Reading order over documents: eight lines are a page; a line's length gives its box, short lines are headings.

The SQL counts and compares every block with all others of its page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.functions.dual import E
from leafmill.operators import reading
from leafmill.plans.base import BLOCKS, spread

_BOXES = E(
    "SELECT doc_id, page, pos AS block, CAST(CASE length(line) % 3 WHEN 0 THEN 30 WHEN 1 THEN 330 ELSE 40 END AS DOUBLE) AS x, CAST(y + length(line) % 17 AS DOUBLE) AS y, CAST(CASE WHEN length(line) % 5 = 4 THEN 500 ELSE 90 + length(line) % 170 END AS DOUBLE) AS width, "
    "CAST(8 + length(line) % 61 AS DOUBLE) AS height, 612 AS page_width, length(line) % 4 = 0 AS heading FROM {blocks} b",
    "",
)


def heading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    boxes = spark.sql(_BOXES.s.format(blocks=BLOCKS.s).replace("FROM documents", "FROM leafmill_documents"))
    return reading.reading_order(boxes, ["doc_id"]).select("doc_id", "page", "block", "reading_column", "band", "place")


QUERIES = {"heading_order": heading_order}
ORACLES = {
    "heading_order": f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT *, CASE WHEN width >= 0.58 * 612 THEN 0 WHEN x + width / 2 < 306 THEN 1 ELSE 2 END AS side FROM ({_BOXES.s.format(blocks=BLOCKS.d)}) q),
t AS MATERIALIZED (SELECT *, (SELECT count(*) FILTER (o.side = 1) >= 2 AND count(*) FILTER (o.side = 2) >= 2 FROM a o WHERE o.doc_id = a.doc_id AND o.page = a.page) AS two FROM a),
b AS MATERIALIZED (SELECT *, CASE WHEN two THEN side ELSE 0 END AS reading_column, two AND side = 0 AS wide, CASE WHEN NOT two THEN 0 WHEN side > 0 THEN (SELECT count(*) FROM t o WHERE o.doc_id = t.doc_id AND o.page = t.page AND o.side = 0 AND o.y - 18 <= t.y)
  ELSE (SELECT count(*) FROM t o WHERE o.doc_id = t.doc_id AND o.page = t.page AND o.side = 0 AND (o.y, o.x, o.block) < (t.y, t.x, t.block)) END AS band FROM t),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page, band, wide, reading_column ORDER BY y, block) AS rn FROM b),
r(doc_id, page, band, wide, reading_column, block, rn, y, line) AS (SELECT doc_id, page, band, wide, reading_column, block, rn, y, 1 FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.page, n.band, n.wide, n.reading_column, n.block, n.rn, n.y, CASE WHEN n.y - r.y > 2 THEN r.line + 1 ELSE r.line END FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.page AND n.band = r.band AND n.wide = r.wide AND n.reading_column = r.reading_column AND n.rn = r.rn + 1),
k AS MATERIALIZED (SELECT n.*, row_number() OVER (PARTITION BY n.doc_id, n.page, n.band, n.wide, n.reading_column ORDER BY r.line, n.x, n.block) AS base FROM n JOIN r USING (doc_id, page, block)),
m AS (SELECT *, least(base, coalesce(CASE WHEN heading THEN (SELECT min(o.base) FROM k o WHERE o.doc_id = k.doc_id AND o.page = k.page AND o.band = k.band AND o.wide = k.wide AND o.reading_column = k.reading_column AND NOT o.heading AND k.block < o.block
  AND k.y BETWEEN o.y - 4 AND o.y + greatest(1, o.height) + 6 AND abs(k.x + k.width / 2 - o.x - o.width / 2) < greatest(80, 0.75 * least(k.width, o.width))) END, base)) AS lowered FROM k)
SELECT doc_id, page, block, reading_column, band, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, wide, reading_column, lowered, NOT heading, base) - 1 AS place FROM m""",
}
