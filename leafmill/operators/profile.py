"""Context profiles: what the parts of a paper say about it, in the order of their priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions.dual import x

KEYWORDS, SUMMARIES, SUMMARY_CHARS = 24, 6, 900


def context_profile(parts: DataFrame, key: list[str], keywords: int = KEYWORDS, summaries: int = SUMMARIES) -> DataFrame:
    """parts (key, priority, place, keywords: text of a list, summary) to (key, keywords, summary), a row for each key.

    Keywords are the first spellings in order of priority, place and position, without regard to case; the summary joins the first texts that
    aren't blank, cut to 900 characters. A keyword's first place is a minimum, so tasks hand on one row for each keyword they have seen,
    and of these only the first of a key are kept before they are listed. Null lists and summaries are empty; of parts with equal priority and place the lesser text comes first;
    a key without any has an empty profile; an empty table gives an empty result; other columns are left out.
    """
    rows = parts.select(*key, "priority", "place", F.coalesce("keywords", F.lit("")).alias("keywords"), T.collapse(x("coalesce(summary, '')")).col().alias("summary"))
    of = W.partitionBy(*key)
    words = rows.select(*key, "priority", "place", F.posexplode(T.keywords(x("keywords")).col()).alias("pos", "word"))
    first = words.groupBy(*key, F.lower("word").alias("low")).agg(F.min(F.struct("priority", "place", "pos", "word")).alias("at"))
    few = first.withColumn("nth", F.row_number().over(of.orderBy("at"))).filter(F.col("nth") <= keywords)
    listed = few.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "at"))), lambda v: v["at"]["word"]).alias("keywords"))
    said = rows.filter("summary <> ''").withColumn("nth", F.row_number().over(of.orderBy("priority", "place", "summary"))).filter(F.col("nth") <= summaries)
    told = said.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "summary"))), lambda v: v["summary"]), " ").alias("whole"))
    told = told.withColumn("summary", T.truncate(x("whole"), SUMMARY_CHARS).col()).drop("whole")
    out = rows.select(*key).distinct()
    for side in (listed, told):
        on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
        both = on[0]
        for c in on[1:]:
            both = both & c
        out = out.alias("l").join(side.alias("r"), both, "left").select("l.*", *[F.col(f"r.{c}").alias(c) for c in side.columns if c not in key])
    return out.select(*key, F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.coalesce("summary", F.lit("")).alias("summary"))
