"""A plan is one declarative query, written once and rendered for Spark (to run) and DuckDB (to check)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from leafmill.functions.dual import E, t

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: Lines of documents as blocks: 8 to a page, 18 points apart.
BLOCKS = E(
    "(SELECT doc_id, source, lang, CAST(pos AS BIGINT) AS pos, line, CAST(1 + pos DIV 8 AS BIGINT) AS page, CAST(18 * (pos % 8) AS DOUBLE) AS y FROM documents LATERAL VIEW posexplode(split(text, '\\n')) e AS pos, line)",
    "(SELECT doc_id, source, lang, pos, line, 1 + pos // 8 AS page, CAST(18 * (pos % 8) AS DOUBLE) AS y FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents))",
)


def spread(df: DataFrame, name: str) -> DataFrame:
    """Texts of a file or two (fewer scan tasks than cores) are dealt to all cores; larger tables are read as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and df.rdd.getNumPartitions() < min(cores, 8) else df


class Plan:
    def __init__(self, sql: str, **parts: E) -> None:
        self.sql = E(t(t(sql, **parts).s, blocks=BLOCKS).s, t(t(sql, **parts).d, blocks=BLOCKS).d.replace("AS STRING", "AS VARCHAR"))
        self.tables = [n for n in TABLES if re.search(rf"\b{n}\b", self.sql.s)]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = self.sql.s
        for n in self.tables:
            spread(spark.read.parquet(f"{sf_dir}/{n}.parquet"), n).createOrReplaceTempView(f"leafmill_{n}")
            sql = re.sub(rf"(?<=\bFROM |\bJOIN ){n}\b", f"leafmill_{n}", sql)
        return spark.sql(sql)
