"""LaTeX repair over documents: shards of a formula made of a line's length and number stand behind each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import latex as L
from leafmill.functions.dual import E, x
from leafmill.operators import latex
from leafmill.plans.base import BLOCKS, Plan, spread

_SHARDS = E(
    "concat(line, '\\n', 'x ', CAST(pos AS STRING), '\\n:\\n= \\n', CAST(length(line) AS STRING), CASE WHEN pos % 3 = 0 THEN '\\n+ 𝑦 , ( 𝛼 )' WHEN pos % 3 = 1 THEN '\\n  \\n\\\\ frac { a }' ELSE '' END)",
    "concat(line, chr(10), 'x ', CAST(pos AS VARCHAR), chr(10), ':', chr(10), '= ', chr(10), CAST(length(line) AS VARCHAR), CASE WHEN pos % 3 = 0 THEN chr(10) || '+ 𝑦 , ( 𝛼 )' WHEN pos % 3 = 1 THEN chr(10) || '  ' || chr(10) || '\\ frac { a }' ELSE '' END)",
)


def latex_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "documents").createOrReplaceTempView("leafmill_documents")
    lines = spark.sql(f"SELECT doc_id, pos, {_SHARDS.s} AS line FROM {BLOCKS.s} b".replace("FROM documents", "FROM leafmill_documents"))
    held = F.array_sort(F.collect_list(F.struct("pos", "line")))
    texts = lines.groupBy("doc_id").agg(F.array_join(F.transform(held, lambda v: v["line"]), "\n").alias("text"))
    return latex.repair(texts, ["doc_id"]).select("doc_id", "n_formulas", F.sha1("text").alias("text_sha"))


_PLANS = {"formula_latex": Plan("SELECT doc_id, pos, sha1(<f>) AS latex_sha FROM <blocks> b", f=L.formula_latex(x("concat(line, ' FP8 xmax 𝑥𝑡+1 log(θ) pθ WQL ℓ − a, b')")))}
QUERIES = _PLANS | {"latex_repair": latex_repair}

_signs = L.run_signs(x("clean"))
ORACLES = {k: p.sql.d for k, p in _PLANS.items()} | {
    "latex_repair": f"""
WITH d AS MATERIALIZED (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT doc_id, pos, {_SHARDS.d} AS line FROM {BLOCKS.d} b) q GROUP BY doc_id),
l AS MATERIALIZED (SELECT doc_id, line, pos, {L.is_shard(x("line")).d} AS shard, {L.trimmed(x("line")).d} AS clean FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS ls FROM d) q WHERE len(ls) >= 3) r),
r AS MATERIALIZED (SELECT *, sum(CASE WHEN shard AND was THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT *, coalesce(lag(shard) OVER (PARTITION BY doc_id ORDER BY pos), false) AS was FROM l) q),
g AS (SELECT doc_id, run, min(pos) AS pos, string_agg(line, ' ' ORDER BY pos) AS joined, string_agg(line, chr(10) ORDER BY pos) AS apart, bool_and(shard) AS shard, count(*) AS n, count(*) FILTER ({_signs["short"].d}) AS n_short, count(*) FILTER ({_signs["prose"].d}) AS n_prose FROM r GROUP BY doc_id, run),
b AS (SELECT *, shard AND {L.is_broken(x("joined"), "n", "n_short", "n_prose").d} AS broken FROM g),
m AS (SELECT doc_id, string_agg(CASE WHEN broken THEN '$' || {L.expression(x("joined")).d} || '$' ELSE apart END, chr(10) ORDER BY pos) AS mended, count(*) FILTER (broken) AS n FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(m.n, 0) AS n_formulas, sha1(coalesce(m.mended, d.text)) AS text_sha FROM d LEFT JOIN m ON m.doc_id = d.doc_id"""
}
