"""Body text out of blocks that mix it with addresses, affiliations and publishers' notices.

Lines run through a small automaton: before any noise, after noise, inside a segment. Each line maps
states to states, and but for one kind the map is constant: noise leads out of a segment, body into
one, any other line out; a line that may only go on leaves the state as it is. So the state after a line
is that of the last line whose map is constant, which a window gives, however long the block is.

If no line segment is left, the text itself is searched: from behind the last e-mail, or 22 percent of
it, for the first opening of a body sentence.

Edge cases: null texts and lines count as empty; lines without text or with a box that isn't finite and
positive are left out; a block that is short, without noise, or garbage gives nothing; a block without
lines is searched as text; an empty table gives an empty result; columns other than the key and those named are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import rescue as R
from leafmill.functions import text as T
from leafmill.functions.dual import x


def noisy_blocks(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Blocks (key, page, text) worth an attempt, with `whole`, their text in one line."""
    rows = blocks.select(*key, F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("whole", T.collapse(x("text")).col()).filter(f"length(whole) >= {R.LEAST_BLOCK}")
    return rows.filter(R.is_noisy_block(x("whole"), x("page")).col() & ~T.is_extraction_garbage(x("text")).col())


def line_segments(noisy: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """Segments of lines (key, line, text, x, y, width, height): (key, first, text, n_lines, start, end, x, y, width, height)."""
    fine = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y", "width", "height"))
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    kept = lines.select(*key, "line", T.collapse(x("coalesce(text, '')")).col().alias("own"), *box).filter(f"own <> '' AND {fine} AND width > 0 AND height > 0")
    rows = kept.join(noisy.select(*key, "page", "whole"), key).withColumn("bare", T.strip_metadata(x("own")).col())
    rows = rows.withColumns({k: e.col() for k, e in R.line_kinds(x("bare"), x("page")).items()})
    by = W.partitionBy(*key).orderBy("line", "own", "x", "y")
    rows = rows.withColumns({"nth": F.row_number().over(by), "n_all": F.count("*").over(W.partitionBy(*key)), "saw": F.coalesce(F.max("noise").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))})
    constant = F.when(F.col("noise"), F.lit(False)).when(~F.col("saw"), F.lit(False)).when(F.col("body"), F.lit(True)).when(~F.col("goes_on"), F.lit(False))
    state = W.partitionBy(*key).orderBy("nth")
    rows = rows.withColumn("constant", constant).withColumn("inside", F.last("constant", ignorenulls=True).over(state)).filter("n_all >= 2")
    rows = rows.withColumn("group", F.col("nth") - F.row_number().over(W.partitionBy(*key, "inside").orderBy("nth"))).filter("inside")
    parts = rows.groupBy(*key, "group").agg(
        F.array_sort(F.collect_list(F.struct("nth", "line", "own"))).alias("v"), F.first("whole").alias("whole"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("x2"), F.max(F.col("y") + F.col("height")).alias("y2"), F.count("*").alias("n_lines")
    )
    parts = parts.withColumn("joined", F.array_join(F.transform("v", lambda v: v["own"]), " ")).withColumn("text", R.cleaned(x("joined")).col()).filter(R.is_useful(x("text")).col())
    at = F.expr("locate(substring(v[0].own, 1, 24), whole) - 1")
    return parts.select(*key, F.col("v")[0]["line"].alias("first"), "text", "n_lines", F.greatest(at, F.lit(0)).cast("long").alias("start"), (F.greatest(at, F.lit(0)) + F.length("text")).cast("long").alias("end"), "x", "y", (F.col("x2") - F.col("x")).alias("width"), (F.col("y2") - F.col("y")).alias("height"))


def text_segments(noisy: DataFrame, key: list[str]) -> DataFrame:
    """The body at the end of blocks' texts: (key, text, start, end)."""
    rows = noisy.withColumn("clean", T.strip_metadata(x("whole")).col()).filter(f"length(clean) >= {R.LEAST_CLEAN}")
    rows = rows.withColumn("mail", R.mail_end(x("whole")).col()).withColumn("search", F.expr(f"least(length(clean) - 1, greatest(mail, CAST(floor(length(clean) * {R.SEARCH_FROM}) AS INT)))"))
    rows = rows.withColumn("at", R.body_start(x("clean"), x("search")).col()).filter("at IS NOT NULL")
    rows = rows.withColumn("body", R.cleaned(x("substring(clean, at + 1)")).col()).withColumn("raw_at", F.expr("locate(substring(clean, at + 1, 24), whole) - 1"))
    start = F.when(F.col("raw_at") > 0, F.col("raw_at")).otherwise(F.col("at")).cast("long")
    return rows.select(*key, F.col("body").alias("text"), start.alias("start"), (start + F.length("body")).alias("end"))


def rescue(blocks: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """(key, nth, reason, text, start, end, n_lines, x, y, width, height): line segments where a block has any, else its body tail."""
    noisy = noisy_blocks(blocks, key)
    by_line = line_segments(noisy, lines, key)
    nth = (F.row_number().over(W.partitionBy(*key).orderBy("first")) - 1).cast("long")
    by_line = by_line.select(*key, nth.alias("nth"), F.lit("mixed-block-line-rebuild").alias("reason"), "text", "start", "end", "n_lines", "x", "y", "width", "height")
    rest = text_segments(noisy.join(by_line.select(*key).distinct(), key, "left_anti"), key)
    none = [F.lit(None).cast(k).alias(c) for c, k in (("n_lines", "long"), ("x", "double"), ("y", "double"), ("width", "double"), ("height", "double"))]
    return by_line.unionByName(rest.select(*key, F.lit(0).cast("long").alias("nth"), F.lit("mixed-block-body-tail").alias("reason"), "text", "start", "end", *none))
