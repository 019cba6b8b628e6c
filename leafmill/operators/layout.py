"""Lines of a page as paragraphs, and artifacts that show the same, as relations over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDE, SPAN, LEAST_LINES, LEAST_SIDE = 0.56, 0.62, 4, 2
GAP_LINES, LEAST_GAP, INDENT, LINE_HEIGHT = 1.7, 18, 14, 12
ALIKE = 0.92

_BOXED = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('infinity')" for c in ("x", "y", "width", "height")) + " AND width > 0 AND height > 0"


def line_groups(lines: DataFrame, key: list[str], order: str, page_width: float) -> DataFrame:
    """lines (key: document and page, order, x, y, width, height, formula, ends, starts) to (key, order, grp): the number of their paragraph.

    A page with lines at both sides is read wide lines first, then left, then right. A paragraph ends before a gap of
    1.7 median lines (18 points at least) if the line above ends a sentence, the next one starts one, or it is indented by 14
    points; and at formulas, which belong to none. Lines without a whole, positive box are left out; null flags are false.
    All by windows over pages and columns.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("formula", "ends", "starts")}
    rows = lines.filter(_BOXED).select(*key, order, *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")], *[v.alias(c) for c, v in flags.items()])
    page = W.partitionBy(*key)
    side = F.when(F.col("width") >= WIDE * page_width, 0).when(F.col("x") + F.col("width") / 2 < page_width / 2, 1).otherwise(2)
    rows = rows.withColumn("side", side)
    span = F.max(F.col("x") + F.col("width")).over(page) - F.min("x").over(page)
    counts = [F.count_if(F.col("side") == k).over(page) for k in (1, 2)]
    two = (F.count("*").over(page) >= LEAST_LINES) & (span >= SPAN * page_width) & (F.least(*counts) >= LEAST_SIDE)
    rows = rows.withColumn("two", two).withColumn("part", F.when(F.col("two"), F.col("side")).otherwise(0))
    part = W.partitionBy(*key, "part")
    down = part.orderBy("y", "x", order)
    before = {c: F.lag(c).over(down) for c in ("formula", "ends", "x")}
    rows = rows.withColumns({"middle": F.median("height").over(part), "gap": F.col("y") - F.lag(F.col("y") + F.col("height")).over(down), "first": F.row_number().over(down) == 1})
    cue = (F.col("gap") > F.greatest(F.lit(float(LEAST_GAP)), GAP_LINES * F.coalesce("middle", F.lit(float(LINE_HEIGHT))))) & (before["ends"] | F.col("starts") | (F.abs(F.col("x") - before["x"]) > INDENT))
    rows = rows.withColumn("opens", ~F.col("formula") & (F.col("first") | F.coalesce(before["formula"] | cue, F.lit(True))))
    nth = F.count_if("opens").over(W.partitionBy(*key).orderBy("part", "y", "x", order)) - 1
    return rows.withColumn("grp", nth.cast("long")).filter("NOT formula").select(*key, order, "grp")


_SHARED = "greatest(0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"


def show_the_same(a: str, b: str) -> str:
    """SQL: two artifacts of one type stand in one region, or have ALIKE of the larger box in common."""
    shared, area = _SHARED.format(a=a, b=b), f"greatest({a}.width * {a}.height, {b}.width * {b}.height)"
    return f"({a}.type = {b}.type AND (({a}.region <> '' AND {a}.region = {b}.region) OR ({a}.width > 0 AND {a}.height > 0 AND {b}.width > 0 AND {b}.height > 0 AND {shared} >= {ALIKE} * {area})))"


def merged_artifacts(artifacts: DataFrame, key: list[str], order: str) -> DataFrame:
    """artifacts (key: document and page, order, type, region, x, y, width, height, text, n_lines, label, confidence): each goes into the first one kept that shows the same.

    Pairs that show the same come from a join inside pages; which of them are kept is settled in order of their places, as
    what goes into another takes nothing in itself. Adds merged, how many went into one. Texts are joined in order but for those that the text so far holds, or that hold it; the
    most lines, the first label and the best confidence stay. Null types, regions and texts count as empty; boxes that aren't whole and finite show nothing.
    """
    box = [F.when(F.expr(_BOXED), F.col(c).cast("double")).alias(c) for c in ("x", "y", "width", "height")]
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = artifacts.select(*key, F.col(order).cast("long").alias("at"), blank("type"), blank("region"), *box, F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ")).alias("text"), F.coalesce(F.col("n_lines").cast("long"), F.lit(1).cast("long")).alias("n_lines"), blank("label"), blank("confidence"))
    pages = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"k{i}") for i, k in enumerate(key)]
    ks = [f"k{i}" for i in range(len(key))]
    rows = rows.select(*pages, "*")
    a, b = rows.alias("a"), rows.alias("b")
    on = F.expr(" AND ".join(f"a.{k} = b.{k}" for k in ks) + " AND a.at < b.at AND " + show_the_same("a", "b"))
    pairs = a.join(b, on).select(*[F.col(f"b.{k}").alias(k) for k in ks], F.col("b.at").alias("at"), F.col("a.at").alias("earlier"))
    earlier = pairs.groupBy(*ks, "at").agg(F.array_sort(F.collect_list("earlier")).alias("earlier"))
    # in order of place, a row goes into the first of its earlier ones that is kept itself
    step = "(a, v) -> transform(array(get(filter(v.earlier, e -> NOT array_contains(map_keys(a), e)), 0)), t -> IF(t IS NULL, a, map_concat(a, map(v.at, t))))[0]"
    into = earlier.groupBy(*ks).agg(F.array_sort(F.collect_list(F.struct("at", "earlier"))).alias("v")).select(*ks, F.explode(F.expr(f"aggregate(v, CAST(map() AS map<bigint,bigint>), {step})")).alias("at", "target"))
    told = rows.join(into, [*ks, "at"], "left").withColumn("target", F.coalesce("target", "at"))
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "text"))), F.lit(""), lambda acc, v: F.when(v["text"] == "", acc).when(acc == "", v["text"]).when(F.contains(acc, v["text"]) | F.contains(v["text"], acc), acc).otherwise(F.concat(acc, F.lit(" "), v["text"])))
    out = told.groupBy(*ks, "target").agg(
        *[F.first(k).alias(k) for k in key], F.min_by("type", "at").alias("type"), joined.alias("text"), F.max("n_lines").alias("n_lines"), F.coalesce(F.min_by("label", F.when(F.col("label") != "", F.col("at"))), F.lit("")).alias("label"),
        F.min_by("confidence", F.struct(-rank, "at")).alias("confidence"), F.count("*").alias("merged"),
    )
    return out.select(*key, F.col("target").alias(order), "type", "text", "n_lines", "label", "confidence", "merged")
