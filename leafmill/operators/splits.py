"""Figure regions cut into panels by the labels that stand in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import all_of, matches, t, x

LABEL_CHARS, LABEL_LINES, LEAST, MOST, LEAST_SIDE = 180, 5, 2, 4, 12
SPREAD, LEAST_SPREAD = 0.82, 36
#: How far the labels of a row, and of a column, may be apart across it: a share of their mean extent, and points.
ROW_APART, COLUMN_APART = (1.4, 48), (1.4, 72)

#: A panel's label: (a), by itself or before a short text. Columns text, n_lines.
IS_LABEL = all_of(matches(T.collapse(x("text")), r"(?i)^\([a-z]\)(?:\s|$)"), t(f"(length(<c>) <= {LABEL_CHARS} AND n_lines <= {LABEL_LINES})", c=T.collapse(x("text"))))
_FINITE = " AND ".join(f"{{p}}{c} IS NOT NULL AND NOT isnan({{p}}{c}) AND abs({{p}}{c}) < double('infinity')" for c in ("x", "y", "width", "height")) + " AND {p}width > 0 AND {p}height > 0"


def split_regions(regions: DataFrame, blocks: DataFrame, key: list[str]) -> DataFrame:
    """regions (key: document and page, region, x, y, width, height) with two to four labels inside to their panels.

    blocks: key, block, text, n_lines, x, y, width, height. A label is inside if its centre is. Labels that lie apart along one
    direction, and close across it, form a row or a column; panels part halfway between the centres of neighbours, and the outer ones reach the
    region's edges. A region gives none unless all its panels have LEAST_SIDE points at both sides.
    Columns: key, region, panel (from 1), block (of the label), vertical (side by side), left_edge, top_edge, panel_width, panel_height.
    Boxes that aren't whole, finite and positive are left out, null texts are no labels, missing line counts are 1; labels with one
    centre are ordered by block. Windows over the labels of a region, of which there are few.
    """
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    r = regions.filter(_FINITE.format(p="")).select(*key, "region", *[b.alias(f"r_{c}") for b, c in zip(box, ("x", "y", "width", "height"), strict=True)])
    labels = blocks.select(*key, "block", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_lines", F.lit(1)).alias("n_lines"), *box).filter(_FINITE.format(p="")).filter(IS_LABEL.col())
    labels = labels.withColumns({"cx": F.col("x") + F.col("width") / 2, "cy": F.col("y") + F.col("height") / 2})
    held = r.join(labels.drop("text", "n_lines", "x", "y"), key).filter("cx BETWEEN r_x AND r_x + r_width AND cy BETWEEN r_y AND r_y + r_height")
    of = W.partitionBy(*key, "region")
    held = held.withColumn("n", F.count("*").over(of)).filter(f"n BETWEEN {LEAST} AND {MOST}")
    spread = lambda c: F.max(c).over(of) - F.min(c).over(of)
    held = held.withColumns({"dx": spread("cx"), "dy": spread("cy"), "mw": F.avg("width").over(of), "mh": F.avg("height").over(of)})
    row = f"dx >= greatest({SPREAD} * mw, {LEAST_SPREAD}) AND dy <= greatest({ROW_APART[0]} * mh, {ROW_APART[1]})"
    column = f"dy >= greatest({SPREAD} * mh, {LEAST_SPREAD}) AND dx <= greatest({COLUMN_APART[0]} * mw, {COLUMN_APART[1]})"
    held = held.withColumn("vertical", F.expr(f"CASE WHEN {row} THEN true WHEN {column} THEN false END")).filter("vertical IS NOT NULL")
    held = held.withColumns({"at": F.expr("IF(vertical, cx, cy)"), "first": F.expr("IF(vertical, r_x, r_y)"), "last": F.expr("IF(vertical, r_x + r_width, r_y + r_height)")})
    by = of.orderBy("at", "block")
    start, end = F.coalesce((F.lag("at").over(by) + F.col("at")) / 2, "first"), F.coalesce((F.lead("at").over(by) + F.col("at")) / 2, "last")
    held = held.withColumns({"panel": F.row_number().over(by), "start": start, "size": end - start})
    across = F.expr("IF(vertical, r_height, r_width)")
    held = held.withColumn("fits", F.min(F.least("size", across)).over(of) >= LEAST_SIDE).filter("fits")
    return held.select(*key, "region", "panel", "block", "vertical", *[F.expr(e).alias(c) for c, e in (("left_edge", "IF(vertical, start, r_x)"), ("top_edge", "IF(vertical, r_y, start)"), ("panel_width", "IF(vertical, size, r_width)"), ("panel_height", "IF(vertical, r_height, size)"))])
