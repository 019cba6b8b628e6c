"""Geometry of pages: merged artifacts, line groups, column order, splits, nearest blocks.

Boxes stand in for a layout: four rows in two columns to a page of 612 by 792 points, long lines across both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.dual import E, matches, t, x
from leafmill.operators import layout
from leafmill.plans.base import BLOCKS, Plan, spread

LINE = x("line")
_SIDED = t("(SELECT *, CASE WHEN length(line) > 300 THEN 0 WHEN pos % 8 < 4 THEN 1 ELSE 2 END AS side FROM <blocks> b)")
#: doc_id, page, pos, line, n_lines and box of each block.
BOXES = t(
    "(SELECT doc_id, page, pos, line, side, CAST(CASE WHEN side = 2 THEN 318 ELSE 54 END AS DOUBLE) AS x, CAST(72 + 120 * (pos % 4) AS DOUBLE) AS y, CAST(CASE WHEN side = 0 THEN 504 ELSE 40 + least(200, length(line)) END AS DOUBLE) AS width, "
    "CAST(12 * (1 + least(6, <n>)) AS DOUBLE) AS height, CAST(1 + least(6, <n>) AS BIGINT) AS n_lines FROM <sided> s)",
    n=E("length(line) DIV 60", "length(line) // 60"), sided=_SIDED,
)
_END = matches(LINE, r"[.!?][)\x22\x27\]]?$")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    return spark.sql(f"SELECT * FROM {t(BOXES.s, blocks=BLOCKS).s} b".replace("FROM documents", "FROM leafmill_documents"))


def merged_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as artifacts whose boxes stand in three places of a page, so that some show the same."""
    rows = boxes(spark, sf_dir).withColumns({
        "type": F.when(F.col("pos") % 2 == 0, "formula").otherwise("caption"), "region": F.when(F.col("pos") % 5 == 0, F.concat(F.lit("r"), F.col("pos") % 3)).otherwise(""), "text": F.col("line"), "label": F.when(F.col("pos") % 3 == 0, "").otherwise(F.concat(F.lit("L"), F.col("pos"))),
        "confidence": F.element_at(F.array(F.lit("low"), F.lit("high"), F.lit("medium")), (F.col("pos") % 3 + 1).cast("int")), "x": F.lit(54.0), "y": (72 + 200 * (F.col("pos") % 3) + F.col("pos") % 2).cast("double"), "width": F.lit(200.0), "height": F.lit(100.0),
    })
    out = layout.merged_artifacts(rows, ["doc_id", "page"], "pos")
    return out.select("doc_id", "page", "pos", "type", F.sha1("text").alias("text_sha"), "n_lines", "label", "confidence", "merged")


def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).withColumns({"formula": F.col("pos") % 13 == 6, "ends": _END.col(), "starts": F.col("line").rlike("^(?:[A-Z][a-z]+|We|Our|The|This|These|However|Furthermore|In +this|To +)")})
    return layout.line_groups(rows, ["doc_id", "page"], "pos", 612.0)


#: Order of a page's blocks: by the top, those within two points of the one above by the left.
_BANDED = t("(SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y, x, pos) <= 2 THEN 0 ELSE 1 END AS fresh FROM <boxes> b)", boxes=BOXES)
_CONTENT = t(
    "(SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page ORDER BY y, x, pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS band, min(x) OVER (PARTITION BY doc_id, page) AS x0, "
    "greatest(1, max(x + width) OVER (PARTITION BY doc_id, page) - min(x) OVER (PARTITION BY doc_id, page)) AS span, count(*) OVER (PARTITION BY doc_id, page) AS n FROM <banded> b)", banded=_BANDED,
)
_COLUMNED = t(
    "(SELECT *, CASE WHEN (width > 0.62 * span AND x < x0 + span / 2 AND x + width > x0 + span / 2) OR (width > 0.32 * span AND abs(x + width / 2 - x0 - span / 2) < 0.18 * span) THEN 0 WHEN x + width / 2 < x0 + span / 2 THEN 1 ELSE 2 END AS col FROM <content> c)",
    content=_CONTENT,
)
_SPLIT = t(
    "(SELECT *, sum(CASE WHEN col = 1 AND length(line) > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page) AS n_left, sum(CASE WHEN col = 2 AND length(line) > 8 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page) AS n_right, "
    "min(CASE WHEN col <> 0 THEN y END) OVER (PARTITION BY doc_id, page) AS top FROM <columned> c)", columned=_COLUMNED,
)

#: Overlap of a paragraph's box (s) with a block's (b) over the smaller of both.
_OVERLAP = "greatest(0, least(s.x + s.width, b.x + b.width) - greatest(s.x, b.x)) * greatest(0, least(s.y + s.height, b.y + b.height) - greatest(s.y, b.y)) / least(s.width * s.height, b.width * b.height)"

_LABELS = E(r"regexp_extract_all(line, r'(?i)\b(?:figure|fig\.|table)\s+\d+[a-z]?\s*[:.]', 0)", r"regexp_extract_all(line, '(?i)\b(?:figure|fig\.|table)\s+\d+[a-z]?\s*[:.]', 0)")
_COUNT = E(f"size({_LABELS.s})", f"len({_LABELS.d})")
_SERIES = E("LATERAL VIEW explode(sequence(0, n - 1)) e AS k", ", unnest(range(0, n)) e(k)")
_NTH = E("element_at(labels, CAST(k + 1 AS INT))", "labels[k + 1]")

QUERIES = {
    "column_order": Plan(
        "SELECT doc_id, page, pos, row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN n <= 4 OR n_left < 4 OR n_right < 4 THEN 0 WHEN col = 0 AND y <= top + 6 THEN 1 WHEN col = 1 THEN 2 WHEN col = 2 THEN 3 ELSE 4 END, band, x, pos) AS ord FROM <split> s", split=_SPLIT,
    ),
    "closest_block": Plan(
        f"SELECT doc_id, pos, CASE WHEN score > -160 THEN block END AS block, CASE WHEN score > -160 THEN score END AS score FROM (SELECT s.doc_id, s.pos, b.pos AS block, round({_OVERLAP} * 1000 - abs(s.y - b.y), 2) AS score, row_number() OVER (PARTITION BY s.doc_id, s.pos ORDER BY round({_OVERLAP} * 1000 - abs(s.y - b.y), 2) DESC, b.pos) AS rn "
        "FROM (SELECT doc_id, page, pos, x + 20 AS x, y + 30 AS y, width, height FROM <boxes> q) s JOIN (SELECT * FROM <boxes> q WHERE pos % 6 <> 5) b ON s.doc_id = b.doc_id AND s.page = b.page) r WHERE rn = 1", boxes=BOXES,
    ),
    "label_splits": Plan(
        "SELECT doc_id, pos, k + 1 AS part, <nth> AS label, round(CASE WHEN side_by_side THEN x + width * k / n ELSE x END, 6) AS left_edge, round(CASE WHEN side_by_side THEN y ELSE y + height * k / n END, 6) AS top_edge, round(CASE WHEN side_by_side THEN width / n ELSE width END, 6) AS width, "
        "round(CASE WHEN side_by_side THEN height ELSE height / n END, 6) AS height FROM (SELECT doc_id, pos, x, y, width, height, <labels> AS labels, <count> AS n, width >= 1.15 * height AS side_by_side FROM (SELECT doc_id, pos, x, y, width, height, concat(CASE pos % 5 WHEN 0 THEN 'Figure 1: a. Fig. 2b. c ' "
        "WHEN 1 THEN 'Table 3: x. Table 4: y. Table 5: z. ' WHEN 2 THEN 'Figure 9: ' ELSE '' END, line) AS line FROM <boxes> b) l) s <series> WHERE n BETWEEN 2 AND 4", boxes=BOXES, labels=_LABELS, count=_COUNT, series=E("LATERAL VIEW OUTER explode(CASE WHEN n > 0 THEN sequence(0, n - 1) END) e AS k", _SERIES.d), nth=_NTH,
    ),
}
FOLDS = {"merged_artifacts": merged_artifacts, "line_groups": line_groups}

_STARTS = "^(?:[A-Z][a-z]+|We|Our|The|This|These|However|Furthermore|In +this|To +)"
_BOXES_D = t(BOXES.d, blocks=BLOCKS).d
FOLD_ORACLES = {
    "line_groups": f"""
WITH RECURSIVE b AS MATERIALIZED (SELECT doc_id, page, pos, x, y, width, height, pos % 13 = 6 AS formula, {_END.d} AS ends, regexp_matches(line, '{_STARTS}') AS starts, CASE WHEN width >= 0.56 * 612 THEN 0 WHEN x + width / 2 < 306 THEN 1 ELSE 2 END AS side FROM {_BOXES_D} q),
p AS (SELECT doc_id, page, count(*) >= 4 AND max(x + width) - min(x) >= 0.62 * 612 AND count(*) FILTER (side = 1) >= 2 AND count(*) FILTER (side = 2) >= 2 AS two FROM b GROUP BY doc_id, page),
c AS MATERIALIZED (SELECT b.*, CASE WHEN two THEN side ELSE 0 END AS part FROM b JOIN p USING (doc_id, page)),
m AS (SELECT doc_id, page, part, greatest(18, 1.7 * median(height)) AS most FROM c GROUP BY doc_id, page, part),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY part, y, x, pos) AS rn FROM c JOIN m USING (doc_id, page, part)),
r AS (SELECT doc_id, page, pos, rn, part, x, y + height AS bottom, ends, formula, CASE WHEN formula THEN -1 ELSE 0 END::BIGINT AS grp FROM n WHERE rn = 1
  UNION ALL SELECT n.doc_id, n.page, n.pos, n.rn, n.part, n.x, n.y + n.height, n.ends, n.formula,
    CASE WHEN n.formula THEN r.grp WHEN r.part <> n.part OR r.formula OR (n.y - r.bottom > n.most AND (r.ends OR n.starts OR abs(n.x - r.x) > 14)) THEN r.grp + 1 ELSE r.grp END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.page AND n.rn = r.rn + 1)
SELECT doc_id, page, pos, grp FROM r WHERE NOT formula""",
    "merged_artifacts": f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT doc_id, page, pos, CASE WHEN pos % 2 = 0 THEN 'formula' ELSE 'caption' END AS type, CASE WHEN pos % 5 = 0 THEN 'r' || pos % 3 ELSE '' END AS region, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text, n_lines,
    CASE WHEN pos % 3 = 0 THEN '' ELSE 'L' || pos END AS label, pos % 3 AS level, 72 + 200 * (pos % 3) + pos % 2 AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) AS rn FROM {_BOXES_D} q),
s AS (SELECT doc_id, page, rn, [rn] AS kept, rn AS target FROM a WHERE rn = 1
  UNION ALL SELECT doc_id, page, rn, CASE WHEN found IS NULL THEN list_append(kept, rn) ELSE kept END, coalesce(found, rn) FROM (SELECT b.doc_id, b.page, b.rn, s.kept, (SELECT min(o.rn) FROM a o WHERE o.doc_id = b.doc_id AND o.page = b.page AND list_contains(s.kept, o.rn) AND o.type = b.type
    AND ((o.region <> '' AND o.region = b.region) OR greatest(0, 100 - abs(o.y - b.y)) * 200 >= 0.92 * 20000)) AS found FROM s JOIN a b ON b.doc_id = s.doc_id AND b.page = s.page AND b.rn = s.rn + 1) q),
t AS MATERIALIZED (SELECT a.*, s.target, row_number() OVER (PARTITION BY a.doc_id, a.page, s.target ORDER BY a.rn) AS k FROM a JOIN s USING (doc_id, page, rn)),
j(doc_id, page, target, k, text) AS (SELECT doc_id, page, target, k, text FROM t WHERE k = 1
  UNION ALL SELECT t.doc_id, t.page, t.target, t.k, CASE WHEN t.text = '' THEN j.text WHEN j.text = '' THEN t.text WHEN contains(j.text, t.text) OR contains(t.text, j.text) THEN j.text ELSE j.text || ' ' || t.text END FROM j JOIN t ON t.doc_id = j.doc_id AND t.page = j.page AND t.target = j.target AND t.k = j.k + 1),
w AS (SELECT doc_id, page, target, arg_max(text, k) AS text FROM j GROUP BY doc_id, page, target),
g AS (SELECT doc_id, page, target, arg_min(pos, rn) AS pos, arg_min(type, rn) AS type, max(n_lines) AS n_lines, coalesce(arg_min(label, rn) FILTER (label <> ''), '') AS label, max(CASE level WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END) AS best, count(*) AS merged FROM t GROUP BY doc_id, page, target)
SELECT g.doc_id, g.page, g.pos, g.type, sha1(w.text) AS text_sha, g.n_lines, g.label, CASE best WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS confidence, g.merged FROM g JOIN w USING (doc_id, page, target)""",
}
