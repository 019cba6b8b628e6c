"""Model JSON as VARIANT columns: layouts to regions by Spark's own functions, and JSON in one stable form.

Aliases, types and bounds are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALIASES = {
    "text": "paragraph", "body": "paragraph", "para": "paragraph", "section": "heading", "title": "heading", "image": "figure", "chart": "figure", "diagram": "figure", "equation": "formula", "math": "formula",
    "algorithm": "code", "listing": "code", "footer": "header-footer", "header": "header-footer", "page-header": "header-footer", "page-footer": "header-footer", "bibliography": "reference", "references": "reference",
}
TYPES = ["paragraph", "heading", "caption", "figure", "table", "formula", "code", "reference", "header-footer", "noise"]


def stable_json(c: Column) -> Column:
    """JSON text with the names of objects in order and no spaces; null for what is no JSON. Equal values give equal texts."""
    return F.to_json(F.try_parse_json(c))


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _first(v: str, names: list[str], kind: str = "string") -> Column:
    """The first of the named fields that isn't null or, as text, empty."""
    got = [_get(F.col(v), n, kind) for n in names]
    return F.coalesce(*[F.when(g != "", g) for g in got]) if kind == "string" else F.coalesce(*got)


def _text(v: str, names: list[str]) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(_first(v, names), F.lit("")), "\\s+", " "))


def _listed(v: str, *paths: str) -> Column:
    return F.coalesce(*[_get(F.col(v), p, "array<variant>") for p in paths], F.expr("CAST(array() AS array<variant>)"))


def layout_regions(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Layout JSON (pages with regions, regions beside them, in a `layout` or not) to a row for each region, usable or not.

    Columns: key, nth (place in the text), page, type, id, text, label, reading_order, confidence (0 to 1; up to 100 it is in percent), x, y,
    width, height (on the page where its size is told), dropped: why a region can't be used (page, type or box), else null.
    Null texts, and those that are no JSON object with such lists, have no regions. Of pages with one number the last size counts.
    Fields by their aliases; JVM expressions throughout.
    """
    v = F.try_parse_json(F.coalesce(F.col(text), F.lit("null")))
    src = docs.select(*key, v.alias("v")).withColumn("src", F.coalesce(F.when(F.schema_of_variant(_get(F.col("v"), "layout", "variant")).startswith("OBJECT"), _get(F.col("v"), "layout", "variant")), F.col("v")))
    told = src.select(*key, _listed("src", "pages", "document.pages").alias("pages"), _listed("src", "regions", "layoutRegions").alias("regions"))
    number = lambda at: _first(at, ["pageNumber", "page", "index"], "double")
    pages = told.select(*key, F.posexplode("pages").alias("i", "p")).withColumns({"page": number("p"), "page_width": _get(F.col("p"), "width", "double"), "page_height": _get(F.col("p"), "height", "double")})
    sizes = pages.filter("page > 0").groupBy(*key, "page").agg(F.max_by("page_width", "i").alias("page_width"), F.max_by("page_height", "i").alias("page_height"))
    inner = pages.select(*key, "i", "page", F.posexplode(_listed("p", "regions", "layoutRegions")).alias("j", "r"))
    outer = told.select(*key, F.lit(2**31 - 1).alias("i"), F.lit(None).cast("double").alias("page"), F.posexplode("regions").alias("j", "r"))
    rows = inner.unionByName(outer).withColumn("page", F.coalesce(_first("r", ["pageNumber", "page"], "double"), "page"))
    kind = F.regexp_replace(F.lower(F.trim(F.coalesce(_first("r", ["type", "role", "kind"]), F.lit("paragraph")))), "[_\\s]+", "-")
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    listed = F.schema_of_variant(_get(F.col("r"), "bbox", "variant")).startswith("ARRAY")
    side = lambda n, names: F.when(listed, _get(F.col("r"), f"bbox[{n}]", "double")).otherwise(_first("r", names, "double"))
    rows = rows.withColumns({"kind": kind, "x0": side(0, ["x", "left"]), "y0": side(1, ["y", "top"]), "w0": side(2, ["width", "w"]), "h0": side(3, ["height", "h"])})
    rows = rows.withColumn("type", F.coalesce(alias[F.col("kind")], "kind")).join(sizes.withColumn("known", F.lit(True)), [*key, "page"], "left")
    fine = F.lit(True)
    for c in ("x0", "y0", "w0", "h0"):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.withColumn("dropped", F.when(F.coalesce(~F.col("known"), F.lit(True)), "page").when(~F.col("type").isin(TYPES), "type").when(~(fine & (F.col("w0") > 0) & (F.col("h0") > 0)), "box"))
    on = lambda at, page: F.when(F.col(page) > 0, F.greatest(F.lit(0.0), F.least(F.col(at), F.col(page)))).otherwise(F.col(at))
    rows = rows.withColumns({"x": on("x0", "page_width"), "y": on("y0", "page_height")})
    size = lambda n, at, page: F.when(F.col(page) > 0, F.greatest(F.lit(1.0), F.least(F.col(n), F.greatest(F.lit(1.0), F.col(page) - F.col(at))))).otherwise(F.col(n))
    score = _get(F.col("r"), "confidence", "double")
    used = F.col("dropped").isNull()
    box = {"x": F.col("x"), "y": F.col("y"), "width": size("w0", "x", "page_width"), "height": size("h0", "y", "page_height")}
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("i", "j")) - 1)
    return rows.select(
        *key, "nth", F.col("page").cast("long").alias("page"), "type", _first("r", ["id"]).alias("id"), _text("r", ["text", "content", "caption"]).alias("text"), _text("r", ["label", "title"]).alias("label"), _first("r", ["readingOrder", "order"], "double").cast("long").alias("reading_order"),
        F.round(F.when((score > 1) & (score <= 100), score / 100).when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(score, F.lit(1.0)))), 4).alias("confidence"), *[F.when(used, F.round(c, 3)).alias(n) for n, c in box.items()], "dropped",
    )
