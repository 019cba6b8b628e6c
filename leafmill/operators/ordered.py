"""Order-dependent folds: state runs over the rows of one document, in order.

What depends on neighbours alone is written as windows. What needs a running state streams through tasks
that hold a document's rows in order; the state is a few numbers, so no document is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def greedy_chunks(df: DataFrame, key: list[str], order: str, size: str, max_rows: int, max_size: int) -> DataFrame:
    """Chunk number of each row: a new chunk starts when it would exceed max_rows rows or max_size in all.

    Rows without a size count as 0; of rows with equal order the smaller comes first.
    """
    rows = df.select(*key, order, F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")).repartition(*key).sortWithinPartitions(*key, order, "_size")
    schema = rows.drop("_size").schema.add("chunk", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, n, total = None, 0, 0, 0
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            keys = zip(*(c.to_pylist() for c in b.columns[: len(key)]), strict=True)
            for i, (k, v) in enumerate(zip(keys, b.column(len(key) + 1).to_pylist(), strict=True)):
                if k != at:
                    at, chunk, n, total = k, 0, 0, 0
                if n and (n + 1 > max_rows or total + v > max_size):
                    chunk, n, total = chunk + 1, 0, 0
                n, total = n + 1, total + v
                out[i] = chunk
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out)], names=schema.names)

    return rows.mapInArrow(run, schema)


def merge_fragments(df: DataFrame, key: list[str], order: str, text: str, page: str) -> DataFrame:
    """Paragraphs from fragments: a fragment joins the paragraph before it if that is open, and at most a page away.

    Open: it ends in a hyphen, or without sentence end, while the fragment begins in lower case. The end of a paragraph
    is the end of its last fragment, so that neighbours decide. Blank fragments are left out. Columns:
    order and page of the first fragment, page_end, merged text, n fragments.
    """
    by = W.partitionBy(*key).orderBy(order)
    rows = df.select(*key, F.col(order).cast("long").alias(order), F.col(page).cast("long").alias("page"), F.trim(F.regexp_replace(text, "\\s+", " ")).alias("_t")).filter("_t <> ''")
    before, low = F.lag("_t").over(by), F.rlike("_t", F.lit("^[a-z]"))
    joins = low & (F.endswith(before, F.lit("-")) | ~F.rlike(before, F.lit("[.!?。！？:]$"))) & (F.col("page") - F.lag("page").over(by) <= 1)
    rows = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    rows = rows.withColumns({"_group": F.sum(F.when(F.col("_joins"), 0).otherwise(1)).over(by), "_cut": F.coalesce(F.lead("_joins").over(by), F.lit(False)) & F.endswith("_t", F.lit("-")), "_more": F.coalesce(F.lead("_joins").over(by), F.lit(False))})
    piece = F.when(F.col("_cut"), F.expr("substring(_t, 1, length(_t) - 1)")).when(F.col("_more"), F.concat("_t", F.lit(" "))).otherwise(F.col("_t"))
    parts = rows.groupBy(*key, "_group").agg(F.min(order).alias(order), F.min_by("page", order).alias("page"), F.max_by("page", order).alias("page_end"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))).alias("p"), F.count("*").alias("n"))
    return parts.select(*key, order, "page", "page_end", F.array_join(F.transform("p", lambda v: v["t"]), "").alias("text"), "n")


def rolling_terms(df: DataFrame, key: list[str], order: str, terms: str, most: int = 12) -> DataFrame:
    """The first `most` distinct terms of the rows before each row.

    Terms are listed by the row that has them first, so only the first `most` of a key can be in any list: a key keeps no more.
    """
    exploded = df.select(*key, order, F.explode(terms).alias("term"))
    first = exploded.groupBy(*key, "term").agg(F.min(order).alias("seen"))
    few = first.withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("seen", "term"))).filter(F.col("nth") <= most)
    listed = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("nth", "seen", "term"))).alias("all"))
    before = F.transform(F.filter("all", lambda v: v["seen"] < F.col(order)), lambda v: v["term"])
    return df.join(listed, key, "left").select(*df.columns, F.coalesce(before, F.array().cast("array<string>")).alias("prior_terms"))
