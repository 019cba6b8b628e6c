"""Context profiles of sources: their documents are the parts, by language and id; a text's items are its keywords, its first line the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import x
from leafmill.operators import profile
from leafmill.plans.base import spread


def context_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents")
    parts = docs.select("source", F.col("lang").alias("priority"), F.col("doc_id").alias("place"), F.col("text").alias("keywords"), F.element_at(F.split("text", "\n"), 1).alias("summary"))
    out = profile.context_profile(parts, ["source"])
    return out.select("source", F.array_join("keywords", "|").alias("keywords"), "summary")


QUERIES = {"context_profile": context_profile}
_cut = T.truncate(x("whole"), 900).d
ORACLES = {
    "context_profile": f"""
WITH w AS (SELECT source, lang, doc_id, unnest(ks) AS word, generate_subscripts(ks, 1) AS pos FROM (SELECT source, lang, doc_id, {T.keywords(x("coalesce(text, '')")).d} AS ks FROM documents) q),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, lower(word) ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, pos, word) AS again FROM w) q WHERE again = 1),
k AS (SELECT source, string_agg(word, '|' ORDER BY nth) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, pos, word) AS nth FROM f) q WHERE nth <= 24 GROUP BY source),
s AS (SELECT source, lang, doc_id, {T.collapse(x("coalesce(string_split(text, chr(10))[1], '')")).d} AS line FROM documents),
t AS (SELECT source, string_agg(line, ' ' ORDER BY nth) AS whole FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, line) AS nth FROM s WHERE line <> '') q WHERE nth <= 6 GROUP BY source)
SELECT d.source, coalesce(k.keywords, '') AS keywords, coalesce({_cut}, '') AS summary FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source LEFT JOIN t ON t.source IS NOT DISTINCT FROM d.source""",
}
