"""Layout markup (page > flow > block > line > word) and document JSON as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.sources.store import CORRUPT, parsed

LINE = T.StructType([T.StructField(n, k) for n, k in (("text", T.StringType()), ("x", T.DoubleType()), ("y", T.DoubleType()), ("width", T.DoubleType()), ("height", T.DoubleType()))])
PAPER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("favorite", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("updatedAt", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StructType([T.StructField(n, k) for n, k in (("id", T.StringType()), ("kind", T.StringType()), ("order", T.IntegerType()), ("pageNumber", T.IntegerType()), ("sourceText", T.StringType()), ("translation", T.StringType()), ("explanation", T.StringType()))]))),
])


def attribute(c: Column, name: str) -> Column:
    return F.regexp_extract(c, f'\\b{name}="([^"]*)"', 1).try_cast("double")


def decode(c: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def parse_layout(files: DataFrame, key: str = "path", xml: str = "xml") -> DataFrame:
    """(key, page_number, width, height, block_idx, text, x, y, w, h, line_count), a row for each block with text.

    A block's or line's missing box is the hull of its words' boxes.
    """
    pages = files.select(key, F.posexplode(F.regexp_extract_all(xml, F.lit("(?s)(<page\\b.*?</page>)"), 1)).alias("page_number", "page"))
    blocks = pages.select(key, (F.col("page_number") + 1).alias("page_number"), attribute(F.col("page"), "width").alias("width"), attribute(F.col("page"), "height").alias("height"), F.posexplode(F.regexp_extract_all("page", F.lit("(?s)(<block\\b.*?</block>)"), 1)).alias("block_idx", "block"))
    words = lambda c: F.regexp_extract_all(c, F.lit("(?s)<word\\b[^>]*>(.*?)</word>"), 1)
    lines = F.transform(F.regexp_extract_all("block", F.lit("(?s)(<line\\b.*?</line>)"), 1), lambda c: F.trim(decode(F.array_join(F.filter(F.transform(words(c), lambda w: F.trim(w)), lambda w: w != ""), " "))))
    kept = blocks.withColumn("lines", F.filter(lines, lambda c: c != "")).filter(F.size("lines") > 0)
    tags = F.regexp_extract_all("block", F.lit("<word\\b([^>]*)>"), 1)
    edge = lambda name, of: F.coalesce(attribute(F.regexp_extract("block", "<block\\b([^>]*)>", 1), name), of(F.transform(tags, lambda w: attribute(w, name))))
    x, y, r, b = edge("xMin", F.array_min), edge("yMin", F.array_min), edge("xMax", F.array_max), edge("yMax", F.array_max)
    return kept.select(key, "page_number", "width", "height", "block_idx", F.array_join("lines", " ").alias("text"), x.alias("x"), y.alias("y"), (r - x).alias("w"), (b - y).alias("h"), F.size("lines").alias("line_count"))


def read_papers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Document JSON files, one a file, and the files that give none: (file, reason), `unreadable` or `incomplete` (without id or paragraphs)."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    told = parsed(files, PAPER, "value")
    reason = F.when(F.col(CORRUPT).isNotNull(), "unreadable").when(F.col("row.id").isNull() | F.col("row.paragraphs").isNull(), "incomplete")
    told = told.withColumn("reason", reason)
    return told.filter("reason IS NULL").select(*[F.col(f"row.{f.name}").alias(f.name) for f in PAPER.fields]), told.filter("reason IS NOT NULL").select("file", "reason")


def flatten(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and paragraphs as flat rows; a missing order is the position."""
    done = lambda p: (F.coalesce(p["translation"], F.lit("")) != "") | (F.coalesce(p["explanation"], F.lit("")) != "")
    head = papers.select(F.col("id").alias("paper_id"), "title", F.coalesce("favorite", F.lit(False)).alias("favorite"), "updatedAt", F.size("paragraphs").alias("paragraph_count"), F.size(F.filter("paragraphs", done)).alias("analyzed_count"))
    body = papers.select(F.col("id").alias("paper_id"), F.posexplode("paragraphs").alias("pos", "p")).select("paper_id", F.col("p.id").alias("paragraph_id"), F.coalesce("p.kind", F.lit("paragraph")).alias("kind"), F.coalesce("p.order", "pos").alias("ord"), F.col("p.pageNumber").alias("page_number"), F.col("p.sourceText").alias("source_text"))
    return head, body


def markdown(paragraphs: DataFrame, key: str = "paper_id") -> DataFrame:
    """One Markdown text for each document, headings marked, in order."""
    md = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "source_text")).otherwise(F.col("source_text"))
    return paragraphs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", md.alias("md")))), lambda r: r["md"]), "\n\n").alias("markdown"))


def svg(box: Column, href: Column) -> Column:
    return F.format_string('<svg xmlns="http://www.w3.org/2000/svg" viewBox="%.1f %.1f %.1f %.1f"><image href="%s"/></svg>', box["x"], box["y"], box["width"], box["height"], href)


def upsert(current: DataFrame, changed: DataFrame, key: list[str]) -> DataFrame:
    """current with the rows of changed in place of those with the same key, and its new rows."""
    return current.join(changed.select(*key), key, "left_anti").select(*current.columns).unionByName(changed.select(*current.columns))


def replace_children(current: DataFrame, changed: DataFrame, parent: str) -> DataFrame:
    """All children of each parent in changed are replaced by those of changed."""
    return current.join(changed.select(parent).distinct(), parent, "left_anti").select(*current.columns).unionByName(changed.select(*current.columns))
