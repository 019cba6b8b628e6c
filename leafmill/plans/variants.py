"""Layout JSON made of documents, read back by VARIANT: every page of eight lines lists its lines as regions.

The SQL computes the regions from the lines, without JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.plans.base import BLOCKS, spread
from leafmill.sources import variants


def layout_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by aliases, boxes as lists or fields, scores in percent or not; some types and boxes can't be used, and some regions stand beside the pages."""
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    lines = spark.sql(f"SELECT doc_id, page, pos, line, y FROM {BLOCKS.s} b".replace("FROM documents", "FROM leafmill_documents"))
    n = F.length("line")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Body", "section", "equation", "page header", "unknown", "TABLE", "figure")]), F.pmod(n, F.lit(7)) + 1)
    listed = F.pmod(n, F.lit(2)) == 0
    region = F.struct(
        kind.alias("type"), F.col("line").alias("text"), F.when(listed, F.array(F.lit(-5.0), F.col("y"), n.cast("double"), F.lit(12.0))).alias("bbox"), F.when(~listed, n % 5 - 1.0).alias("left"), F.when(~listed, F.col("y")).alias("top"),
        F.when(~listed, F.lit(30.5)).alias("w"), F.when(~listed, F.when(n % 3 == 0, 0.0).otherwise(9.0)).alias("h"), (n % 120).cast("double").alias("confidence"), F.col("pos").alias("order"),
    )
    pages = lines.groupBy("doc_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", region.alias("r")))), lambda v: v["r"]).alias("regions"))
    pages = pages.select("doc_id", F.struct(F.col("page").alias("pageNumber"), F.lit(612).alias("width"), F.lit(792).alias("height"), "regions").alias("p"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list("p"), lambda a, b: (a["pageNumber"] - b["pageNumber"]).cast("int")).alias("pages"))
    texts = docs.select("doc_id", F.to_json(F.struct(F.struct("pages").alias("layout"))).alias("text"))
    out = variants.layout_regions(texts, ["doc_id"])
    return out.select("doc_id", "nth", "page", "type", F.sha1("text").alias("text_sha"), "reading_order", "confidence", "x", "y", "width", "height", "dropped")


def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, put beside others in no order, in one stable form; and whether the text was JSON."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat(F.lit('{ "z": [true, null, {"b" : 1, "a": "é"}], "props": '), F.col("props"), F.lit(', "event": "'), F.col("event_type"), F.when(F.col("event_id") % 10 == 3, F.lit('"')).otherwise(F.lit('" }')))
    return events.select("event_id", variants.stable_json(text).alias("json"))


QUERIES = {"layout_ingest": layout_ingest, "stable_json": stable_json}
_n = "length(line)"
ORACLES = {
    "layout_ingest": f"""
WITH l AS (SELECT doc_id, page, pos, y, {_n} AS n, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text, ['paragraph', 'heading', 'formula', 'header-footer', 'unknown', 'table', 'figure'][{_n} % 7 + 1] AS type, {_n} % 2 = 0 AS listed FROM {BLOCKS.d} b),
m AS (SELECT *, CASE WHEN type = 'unknown' THEN 'type' WHEN listed AND n = 0 THEN 'box' WHEN NOT listed AND n % 3 = 0 THEN 'box' END AS dropped, n % 120 AS c FROM l)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS nth, page, type, sha1(text) AS text_sha, pos AS reading_order, round(CASE WHEN c > 1 AND c <= 100 THEN c / 100.0::DOUBLE ELSE least(1.0::DOUBLE, c) END, 4) AS confidence,
  CASE WHEN dropped IS NULL THEN CASE WHEN listed THEN 0.0::DOUBLE ELSE greatest(0, n % 5 - 1.0::DOUBLE) END END AS x, CASE WHEN dropped IS NULL THEN y END AS y, CASE WHEN dropped IS NULL THEN CASE WHEN listed THEN least(n::DOUBLE, 612) ELSE 30.5::DOUBLE END END AS width,
  CASE WHEN dropped IS NULL THEN CASE WHEN listed THEN 12.0::DOUBLE ELSE 9.0::DOUBLE END END AS height, dropped FROM m""",
    "stable_json": """
SELECT event_id, CASE WHEN event_id % 10 <> 3 THEN '{"event":"' || event_type || '","props":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"z":[true,null,{"a":"é","b":1}]}' END AS json FROM events""",
}
