"""Panels of figures over documents: a page's upper half is a region, lines whose length is even stand in it as labels.

The SQL takes all labels of a region as lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.dual import E
from leafmill.operators import splits
from leafmill.plans.base import BLOCKS, spread

_LINES = E(
    "SELECT doc_id, page, pos AS block, CASE WHEN length(line) % 2 = 0 THEN concat('(a) ', line) ELSE line END AS text, 1 AS n_lines, CAST(20 + length(line) * 7 % 480 AS DOUBLE) AS x, CAST(20 + length(line) % 97 + CASE WHEN doc_id % 2 = 0 THEN 4 * y ELSE 0 END AS DOUBLE) AS y, CAST(20 + length(line) % 60 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height FROM {blocks} b",
    "",
)


def panel_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    lines = spark.sql(_LINES.s.format(blocks=BLOCKS.s).replace("FROM documents", "FROM leafmill_documents"))
    pages = lines.select("doc_id", "page").distinct().selectExpr("*", "page AS region", "10D AS x", "10D AS y", "560D AS width", "390D AS height")
    out = splits.split_regions(pages, lines, ["doc_id", "page"])
    return out.select("doc_id", "page", "panel", "block", "vertical", *[F.round(c, 6).alias(c) for c in ("left_edge", "top_edge", "panel_width", "panel_height")])


QUERIES = {"panel_splits": panel_splits}
ORACLES = {
    "panel_splits": f"""
WITH l AS (SELECT *, x + width / 2 AS cx, y + 6 AS cy FROM ({_LINES.s.format(blocks=BLOCKS.d)}) q WHERE {splits.IS_LABEL.d}),
g AS (SELECT doc_id, page, count(*) AS n, max(cx) - min(cx) AS dx, max(cy) - min(cy) AS dy, avg(width) AS mw FROM l WHERE cx BETWEEN 10 AND 570 AND cy BETWEEN 10 AND 400 GROUP BY doc_id, page),
o AS (SELECT *, CASE WHEN dx >= greatest(0.82 * mw, 36) AND dy <= 48 THEN true WHEN dy >= 36 AND dx <= greatest(1.4 * mw, 72) THEN false END AS vertical FROM g WHERE n BETWEEN 2 AND 4),
c AS (SELECT o.doc_id, o.page, o.vertical, list(CASE WHEN vertical THEN cx ELSE cy END ORDER BY CASE WHEN vertical THEN cx ELSE cy END, block) AS mids, list(block ORDER BY CASE WHEN vertical THEN cx ELSE cy END, block) AS blocks
      FROM o JOIN l ON l.doc_id = o.doc_id AND l.page = o.page WHERE o.vertical IS NOT NULL AND cx BETWEEN 10 AND 570 AND cy BETWEEN 10 AND 400 GROUP BY ALL),
e AS (SELECT *, list_concat(list_concat([10.0::DOUBLE], list_transform(range(1, len(mids)), lambda i: (mids[i] + mids[i + 1]) / 2)), [CASE WHEN vertical THEN 570.0 ELSE 400.0 END::DOUBLE]) AS edges FROM c),
f AS (SELECT *, list_transform(range(1, len(mids) + 1), lambda i: edges[i + 1] - edges[i]) AS sizes FROM e),
p AS (SELECT doc_id, page, vertical, blocks, edges, sizes, unnest(range(1, len(mids) + 1)) AS panel FROM f WHERE list_min(sizes) >= 12)
SELECT doc_id, page, panel, blocks[panel] AS block, vertical, round(CASE WHEN vertical THEN edges[panel] ELSE 10 END, 6) AS left_edge, round(CASE WHEN vertical THEN 10 ELSE edges[panel] END, 6) AS top_edge,
  round(CASE WHEN vertical THEN sizes[panel] ELSE 560 END, 6) AS panel_width, round(CASE WHEN vertical THEN 390 ELSE sizes[panel] END, 6) AS panel_height FROM p""",
}
