"""Reading order of a page's blocks by their boxes: columns, bands between wide blocks, headings before the body that holds them.

Blocks of at least WIDE of the page's width belong to no column and cut a page of two columns into bands;
the others are read by band, then column, then from top to bottom. A heading whose box lies inside a body
block of its band and column, and that the source gives first, goes before that block: its place is
lowered to the first such block's. As places stay numbers, and headings come before bodies of one place, the
order is total and no two constraints can contradict each other, whatever lies inside what.

Edge cases: a block without a whole, finite box counts as a line of its own below all others of its page, in
the order of the source; tops within ROW of the block above are one row, read from left to right; pages
without width take their rightmost edge; equal boxes keep the source's order; null pages are one page;
an empty table gives an empty result; other columns pass through, those with the names of the added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDE, LEAST_BLOCKS, ROW, BESIDE = 0.58, 2, 2, 18
ABOVE, BELOW, LEAST_APART, SHARE_APART = 4, 6, 80, 0.75
ADDED = ["reading_column", "band", "place"]


def reading_order(blocks: DataFrame, key: list[str]) -> DataFrame:
    """blocks (key, page, block: its place in the source, x, y, width, height, page_width, heading) with reading_column, band and place in the page.

    Two shuffles by page and one join of headings with the bodies of their page, column and band that begin above them.
    """
    own = [c for c in blocks.columns if c not in ADDED]
    page = [*key, "_page"]
    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in ("x", "y", "width", "height")]
    boxed = finite[0] & finite[1] & finite[2] & finite[3]
    num = {f"_{c}": F.when(boxed, F.col(c).cast("double")) for c in ("x", "y", "width", "height")}
    rows = blocks.select(*own).withColumns({"_page": F.coalesce(F.col("page").cast("long"), F.lit(-1)), "_boxed": boxed, **num})
    whole = W.partitionBy(*page)
    edge = F.coalesce(F.when(F.col("page_width") > 0, F.col("page_width").cast("double")), F.max(F.col("_x") + F.col("_width")).over(whole))
    rows = rows.withColumn("_edge", edge).withColumn("_column", F.when(~F.col("_boxed") | (F.col("_width") >= WIDE * F.col("_edge")), 0).when(F.col("_x") + F.col("_width") / 2 < F.col("_edge") / 2, 1).otherwise(2))
    sides = [F.count_if(F.col("_column") == c).over(whole) >= LEAST_BLOCKS for c in (1, 2)]
    rows = rows.withColumn("_two", sides[0] & sides[1]).withColumn("_wide", F.col("_two") & F.col("_boxed") & (F.col("_column") == 0))
    # a wide block is passed by what begins beside its top or lower; of wide ones, by those before it
    at = F.when(F.col("_wide"), F.col("_y") - BESIDE).when(F.col("_two"), F.col("_y"))
    first = F.when(F.col("_wide"), 0).otherwise(1)
    by = W.partitionBy(*page).orderBy(F.col("_at").asc_nulls_last(), first, "_x", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_at", at).withColumn("_passed", F.count_if("_wide").over(by))
    rows = rows.withColumn("band", F.when(F.col("_two"), F.col("_passed") - F.col("_wide").cast("int")).otherwise(0).cast("long")).withColumn("reading_column", F.when(F.col("_two"), F.col("_column")).otherwise(0))
    part = [*page, "band", "_wide", "reading_column"]
    top = W.partitionBy(*part).orderBy(F.col("_y").asc_nulls_last(), "block")
    rows = rows.withColumn("_new", F.coalesce(F.col("_y") - F.lag("_y").over(top) > ROW, F.lit(True)).cast("int")).withColumn("_row", F.sum("_new").over(top.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.withColumn("_base", F.row_number().over(W.partitionBy(*part).orderBy("_row", "_x", "block")))
    heading = F.coalesce(F.col("heading"), F.lit(False))
    slim = rows.filter("_boxed").select(*part, "block", "_base", "_x", "_y", "_width", "_height", heading.alias("heading"))
    h = slim.filter("heading").select(*part, "block", F.col("_y").alias("h_y"), (F.col("_x") + F.col("_width") / 2).alias("h_mid"), F.col("_width").alias("h_width"))
    b = slim.filter("NOT heading").select(*part, F.col("block").alias("b_block"), "_base", F.col("_y").alias("b_y"), F.col("_height").alias("b_height"), (F.col("_x") + F.col("_width") / 2).alias("b_mid"), F.col("_width").alias("b_width"))
    inside = (F.col("block") < F.col("b_block")) & (F.col("h_y") >= F.col("b_y") - ABOVE) & (F.col("h_y") <= F.col("b_y") + F.greatest(F.lit(1.0), F.col("b_height")) + BELOW)
    near = F.abs(F.col("h_mid") - F.col("b_mid")) < F.greatest(F.lit(float(LEAST_APART)), SHARE_APART * F.least("h_width", "b_width"))
    lowered = h.join(b, part).filter(inside & near).groupBy(*part, "block").agg(F.min("_base").alias("_least"))
    rows = rows.join(lowered, [*part, "block"], "left").withColumn("_key", F.least("_base", F.coalesce("_least", "_base")))
    order = W.partitionBy(*page).orderBy("band", "_wide", "reading_column", "_key", (~heading).cast("int"), "_base")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(*own, F.col("reading_column").cast("int").alias("reading_column"), "band", "place")
