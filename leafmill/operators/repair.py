"""Local repair of stored paragraphs: validation again, for the documents whose text has changed since the last one.

Hidden paragraphs and those edited by hand stay as they are. The others of a document are cleaned, judged and
merged as at segmentation: a paragraph that is dropped is hidden, one that goes into another is gone, one whose text
or pages change is told so, for its analysis to be made again.

Each document has a fingerprint of what can change. Documents whose fingerprint equals the stored one of their last repair aren't
looked at again, but pass as they are; as the fingerprint is taken of the result, a second repair changes nothing.

Edge cases: null flags are false, null texts empty (and dropped); without stored fingerprints all documents are repaired; an id is kept by the
first fragment of a paragraph; an empty table gives an empty result; columns other than those named are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.operators import segmentation

CONTENT = ["kind", "page", "page_end", "text"]


def fingerprints(paragraphs: DataFrame, key: list[str]) -> DataFrame:
    """(key, fingerprint) of the paragraphs that a repair may change; it doesn't depend on the order of rows."""
    free = paragraphs.filter("NOT coalesce(hidden, false) AND NOT coalesce(manual, false)")
    one = F.xxhash64(F.col("ord").cast("long"), *[F.col(c).cast("string") for c in ("id", *CONTENT)])
    return free.groupBy(*key).agg(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(one).cast("string"), F.sum(F.pmod(one, F.lit(1 << 31))).cast("string")).alias("fingerprint"))


def repair(paragraphs: DataFrame, plan: DataFrame, zone: DataFrame, key: list[str], last: DataFrame | None = None, write: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> DataFrame:
    """paragraphs (key, id, ord, kind, page, page_end, text, hidden, manual) with status, numbered anew in order.

    status: same, changed, hidden (by this repair), and untouched (hidden or manual before, or a document whose fingerprint, in last, still holds).
    plan and zone: as of segmentation.planned_sections. write: makes a table of the kept paragraphs, which are read twice, and reads it back.
    """
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("hidden", "manual")}
    rows = paragraphs.select(*key, "id", F.col("ord").cast("long").alias("ord"), "kind", F.col("page").cast("long").alias("page"), F.coalesce("page_end", "page").cast("long").alias("page_end"), F.coalesce("text", F.lit("")).alias("text"), *[v.alias(c) for c, v in flags.items()])
    rows = rows.withColumn("free", ~F.col("hidden") & ~F.col("manual"))
    if last is not None:
        fresh = fingerprints(rows, key).join(last.withColumnRenamed("fingerprint", "_last"), key, "left").filter("_last IS NULL OR _last <> fingerprint").select(*key, F.lit(True).alias("_fresh"))
        rows = rows.join(fresh, key, "left").withColumn("free", F.col("free") & F.coalesce("_fresh", F.lit(False))).drop("_fresh")
    free, still = rows.filter("free"), rows.filter("NOT free")
    kept = write(segmentation.kept_paragraphs(free.select(*key, "ord", *CONTENT), plan, zone, key), "kept")
    merged = segmentation.merge_paragraphs(kept, key, scored=True)
    before = free.select(*key, "ord", "id", F.col("text").alias("_text"), F.col("page").alias("_page"), F.col("page_end").alias("_end"), F.col("kind").alias("_kind"))
    same = (F.col("text") == F.col("_text")) & (F.col("page") == F.col("_page")) & (F.col("page_end") == F.col("_end")) & (F.col("kind") == F.col("_kind"))
    after = merged.join(before, [*key, "ord"]).select(*key, "id", "ord", *CONTENT, F.lit(False).alias("hidden"), F.lit(False).alias("manual"), F.when(same, F.lit("same")).otherwise(F.lit("changed")).alias("status"))
    gone = free.join(kept.select(*key, "ord"), [*key, "ord"], "left_anti").select(*key, "id", "ord", *CONTENT, F.lit(True).alias("hidden"), F.lit(False).alias("manual"), F.lit("hidden").alias("status"))
    out = after.unionByName(gone).unionByName(still.select(*key, "id", "ord", *CONTENT, "hidden", "manual", F.lit("untouched").alias("status")))
    place = F.row_number().over(W.partitionBy(*key).orderBy("ord", "id")) - 1
    return out.withColumn("ord", place.cast("long"))
