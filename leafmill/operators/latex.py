"""Repair of formulas that text extraction broke into lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import latex as L
from leafmill.functions.dual import x


def repair(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, text, n_formulas): every run of shard lines that looks like a broken formula becomes one line, $...$.

    key tells texts apart. Lines are rows of their own while runs are found; a text is put together again from
    its lines, so it is as large as it was. Texts of fewer than three lines stay as they are; null stays null; repeated
    rows of a key and text are one; an empty table gives an empty result. A second repair changes nothing.
    """
    rows = df.select(*key, F.col(text).alias("text")).distinct().withColumn("same", F.xxhash64("text"))
    parts = rows.withColumn("lines", F.split("text", "\r?\n")).filter("size(lines) >= 3")
    lines = parts.select(*key, "same", F.posexplode("lines").alias("pos", "line")).withColumn("shard", L.is_shard(x("line")).col()).withColumn("clean", L.trimmed(x("line")).col())
    of = [*key, "same"]
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(W.partitionBy(*of, "shard").orderBy("pos")))
    lines = lines.withColumns({k: e.col() for k, e in L.run_signs(x("clean")).items()})
    runs = lines.filter("shard").groupBy(*of, "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda v: v["line"]), " ").alias("joined"), F.count("*").alias("n"), F.min("pos").alias("at"), F.count_if("short").alias("n_short"), F.count_if("prose").alias("n_prose")
    )
    broken = runs.filter(L.is_broken(x("joined"), "n", "n_short", "n_prose").col()).select(*of, "run", "at", F.concat(F.lit("$"), L.expression(x("joined")).col(), F.lit("$")).alias("formula"))
    told = lines.select(*of, "pos", "line", F.when(F.col("shard"), F.col("run")).alias("run")).join(broken, [*of, "run"], "left")
    kept = told.filter("formula IS NULL OR pos = at").select(*of, "pos", F.coalesce("formula", "line").alias("line"), F.col("formula").isNotNull().cast("long").alias("is_new"))
    whole = kept.groupBy(*of).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda v: v["line"]), "\n").alias("mended"), F.sum("is_new").alias("n_formulas"))
    return rows.join(whole, of, "left").select(*key, F.coalesce("mended", "text").alias("text"), F.coalesce("n_formulas", F.lit(0)).alias("n_formulas"))
