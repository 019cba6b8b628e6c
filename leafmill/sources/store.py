"""Versioned tables: atomic snapshots, retention, recovery of the newest readable one, and manifests."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP, FILES = 8, "_files.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshots(spark: SparkSession, path: str) -> list[str]:
    """Complete snapshots, oldest first; those without the list of their files are skipped."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = sorted(str(s.getPath().getName()) for s in fs.listStatus(p))
    return [f"{path}/{n}" for n in names if n.startswith("v=") and fs.exists(_fs(spark, f"{path}/{n}/{FILES}")[1])]


def _listed(spark: SparkSession, at: str) -> dict[str, int]:
    fs, p = _fs(spark, at)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")}


def _text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def save(df: DataFrame, path: str, keep: int = KEEP, least_seconds: float = 0) -> str:
    """Write a new snapshot and drop all but the newest `keep`; readers see whole snapshots only.

    A snapshot's last file lists its others with their sizes. With least_seconds, a snapshot younger than
    that against the one before it is replaced by the new one, so that those kept lie apart.
    """
    spark = df.sparkSession
    at = f"{path}/v={time.time_ns():020d}"
    df.write.parquet(at)
    fs, p = _fs(spark, f"{at}/{FILES}")
    out = fs.create(p)
    out.write(bytearray(json.dumps(_listed(spark, at), sort_keys=True).encode()))
    out.close()
    there = snapshots(spark, path)
    when = lambda s: int(s.rsplit("=", 1)[1]) / 1e9
    gone = there[:-keep]
    if len(there) >= 3 and when(there[-2]) - when(there[-3]) < least_seconds:
        gone = gone + [there[-2]]
    for old in dict.fromkeys(gone):
        fs, p = _fs(spark, old)
        fs.delete(p, True)
    return at


def is_whole(spark: SparkSession, at: str, read_all: bool = False) -> bool:
    """Has a snapshot all its files, in their sizes? With read_all all its columns are read, too."""
    try:
        if json.loads(_text(spark, f"{at}/{FILES}")) != _listed(spark, at):
            return False
        df = spark.read.parquet(at)
        if read_all:
            df.select(F.xxhash64(*df.columns).alias("h")).agg(F.bit_xor("h")).first()
    except Exception:  # noqa: BLE001  whatever can't be read is damaged
        return False
    return True


def load(spark: SparkSession, path: str, read_all: bool = False) -> DataFrame:
    """The newest whole snapshot; raises FileNotFoundError if there is none."""
    for at in reversed(snapshots(spark, path)):
        if is_whole(spark, at, read_all):
            return spark.read.parquet(at)
    raise FileNotFoundError(path)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n, fingerprint) of each table; the fingerprint doesn't depend on the order of rows."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.select(F.xxhash64(*sorted(df.columns)).alias("h")).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.bit_xor("h").alias("fingerprint"))
        out = one if out is None else out.unionByName(one)
    return out


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


CORRUPT = "_corrupt_record"


def parsed(lines: DataFrame, schema: T.StructType, json_text: str) -> DataFrame:
    """lines with `row`, what schema reads in their JSON text, and CORRUPT: the text where it doesn't parse or a field has another type, else null."""
    read = F.from_json(json_text, T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    out = lines.withColumn("row", read)
    return out.withColumn(CORRUPT, F.when(F.col("row").isNull(), F.col(json_text)).otherwise(F.col(f"row.{CORRUPT}")))


def import_json(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON files, and the damaged lines, (file, line), that give no row: together all lines that aren't blank."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).filter("trim(line) <> ''")
    told = parsed(lines, schema, "line")
    rows = told.filter(F.col(CORRUPT).isNull()).select(*[F.col(f"row.`{f.name}`").alias(f.name) for f in schema.fields])
    return rows, told.filter(F.col(CORRUPT).isNotNull()).select("file", "line")


def upgraded(rows: DataFrame, steps: list[tuple[int, dict[str, Column]]], version: str = "version") -> DataFrame:
    """rows brought to the newest version: for each (version, columns) in order, rows of an older one get these columns anew.

    Rows of that version or a newer one stay as they are, so a second run changes nothing; a null version is the oldest. A column
    that isn't there yet is null in rows that don't get it.
    """
    rows = rows.withColumn(version, F.coalesce(F.col(version).cast("int"), F.lit(0)))
    for to, columns in sorted(steps, key=lambda s: s[0]):
        old = F.col(version) < to
        new = {c: F.when(old, e).otherwise(F.col(c) if c in rows.columns else F.lit(None)) for c, e in columns.items()}
        rows = rows.withColumns(new | {version: F.greatest(version, F.lit(to))})
    return rows
