"""Mixing sources to target weights by Pareto order sampling.

A source's target is spread over its documents by weight: a document of k times the weight is
expected k times as often, up to `most` copies. Weights are steps of the size (by its binary
logarithm), so a source has few different ones, and the expected copies of each follow from sums by
(source, step). The whole part of them is allotted for certain; the rest is the document's inclusion
probability. Documents are ranked by random odds divided by inclusion odds, and the lowest ranks are
taken until the source's remaining words are reached. Random numbers come from a hash of (seed,
doc_id, text), so reruns agree.

The cut in the ranking is found without sorting a source in one place: words are summed by
(source, rank bucket) with partial aggregation, and only the bucket that holds the cut is sorted; while
that has more than `edge_rows` rows, it is cut into buckets again.
Targets are found without one either: sources are numbered by range partitions, and the level to
which they fill rises by sums over all of them until no further source is full.

Edge cases: a null text has size 0 and is never counted; a null source is a source of its own, last
in order; sources of size 0 get target 0; rows with equal id and text share a rank, and as many of
them are taken as are needed; an empty table gives an empty mix; other columns pass through
`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, read, row_key

SEED, BUCKETS = "mix-2", 4096
#: A cut's bucket is cut again while it has more rows than one task should sort, so often at most.
EDGE_ROWS, LEVELS = 100_000, 4
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def step_of(size: str = "size") -> Column:
    """Binary digits of a size: 0 for 0, 1 for 1, 2 for 2 and 3, and so on."""
    return F.when(F.col(size) > 0, F.length(F.bin(size))).otherwise(F.lit(0))


def numbered(sizes: DataFrame) -> DataFrame:
    """sizes with `k`: 0, 1, ... in the order of source, null last; one count a partition is all that meets."""
    parts = materialize(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row a partition
    first = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"))
    at = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("at", at).join(F.broadcast(first), "part").withColumn("k", F.col("first") + F.col("at")).drop("part", "at", "first")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above most times its size.

    Handing excess on by weight until none is above is filling to one level per unit of weight. Each
    round sums the caps below the level and the weights above it; the level rises until it stays.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("k", F.lit(len(weights))).cast("int") + 1)
    ranked = numbered(sizes).withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ranked = materialize(ranked.drop("k"), "weights")
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, full = -1.0, None
    while True:
        is_full = F.col("cap") / F.col("w") <= F.lit(level)
        below, above, n = ranked.agg(F.sum(F.when(is_full, F.col("cap"))), F.sum(F.when(~is_full, F.col("w"))), F.count(F.when(is_full, 1))).first()
        if n == full or not above:
            break
        level, full = (total - (below or 0.0)) / above, n
    return ranked.select("source", "source_size", F.when(F.lit(above is None), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.lit(level))).alias("target"))


def expected_copies(steps: DataFrame, most: int = MOST) -> DataFrame:
    """(source, step, words, target, weight) with `copies`: weight times a level of the source, at most `most`, that meets its target.

    As many rows as a source has steps meet in a window, at most 64.
    """
    fill = W.partitionBy("source").orderBy(F.col("weight").desc(), "step")
    below = F.coalesce(F.sum("words").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = F.sum(F.col("weight") * F.col("words")).over(fill.rowsBetween(0, W.unboundedFollowing))
    level = F.when(above > 0, (F.col("target") - F.lit(float(most)) * below) / above)
    steps = steps.withColumn("level", level).withColumn("is_open", F.lit(float(most)) / F.col("weight") >= F.col("level"))
    level = F.max(F.when(F.col("is_open"), F.col("level"))).over(W.partitionBy("source"))
    return steps.withColumn("copies", F.least(F.lit(float(most)), F.col("weight") * F.coalesce(level, F.lit(float(most))))).drop("level", "is_open")


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: str = SEED, most: int = MOST, keys: bool = False, edge_rows: int = EDGE_ROWS, **shares) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken; with keys also rk_id, rk_hash.

    weight: of a document, by the column `step` alone (default: 1 + step, so long texts are preferred).
    """
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size"), u.alias("u"), *(row_key(doc_id, text) if keys else []))
    slim = materialize(slim.withColumn("step", step_of()), "mix")
    steps = materialize(slim.groupBy("source", "step").agg(F.sum("size").alias("words")), "steps")
    goal = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), most=most, **shares).withColumnRenamed("source", "s")
    wt = (weight if weight is not None else 1 + F.col("step")).cast("double")
    steps = expected_copies(steps.join(goal, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("weight", wt), most)
    steps = steps.withColumn("whole", F.floor("copies")).withColumn("p", F.when(F.col("source_size") > 0, F.col("copies") - F.floor("copies")).otherwise(F.lit(0.0)))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source"))
    steps = materialize(steps.select(F.col("source").alias("s"), F.col("step").alias("st"), "source_size", "target", "whole", "p", rest.alias("rest")), "odds")
    ranked = slim.join(steps, slim.source.eqNullSafe(steps.s) & (slim.step == steps.st), "left").drop("s", "st", "step")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    open_ = F.col("p") > 0
    inside, out = ranked.withColumns({"rank": F.when(open_, odds / (1 + odds)), "before": F.lit(0).cast("long")}).withColumn("part", F.col("rank")), None
    for level in range(LEVELS):
        # the rank's digits to the base BUCKETS, a power of two, so that they are exact
        inside = inside.withColumn("bucket", F.least(F.floor(F.col("part") * BUCKETS), F.lit(BUCKETS - 1))).withColumn("part", F.col("part") * BUCKETS - F.col("bucket"))
        sums = inside.filter(open_).groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("rest").alias("rest"), F.max("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        cut = sums.withColumn("upto", upto).filter(F.col("upto") >= F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"), "n")).alias("cut"))
        cut = materialize(cut.select("s", F.col("cut.bucket").alias("cut_bucket"), F.col("cut.before").alias("cut_before"), "cut.n"), "cut")
        marked = inside.join(cut, inside.source.eqNullSafe(cut.s), "left").drop("s")
        on_edge = F.coalesce(open_ & (F.col("bucket") == F.col("cut_bucket")), F.lit(False))
        taken = F.coalesce(open_ & (F.col("bucket") < F.coalesce("cut_bucket", F.lit(BUCKETS))), F.lit(False))
        sure = marked.filter(~on_edge).withColumn("extra", taken.cast("int")).drop("bucket", "part", "before", "cut_bucket", "cut_before", "n")
        out = sure if out is None else out.unionByName(sure)
        inside = marked.filter(on_edge).withColumn("before", F.col("cut_before")).drop("bucket", "cut_bucket", "cut_before", "n")
        if (cut.agg(F.max("n")).first()[0] or 0) <= edge_rows:
            break
        out, inside = materialize(out, "decided"), materialize(inside, "edge")
    w = W.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = inside.withColumn("extra", (F.col("before") + F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("size") / 2 <= F.col("rest")).cast("int"))
    out = out.unionByName(edge.select(*out.columns)).withColumn("copies", (F.col("whole") + F.col("extra")).cast("int"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["rk_id", "rk_hash"] if keys else []))


def mixed_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs that the mix takes, with `copies`; texts are shuffled once, to meet the decisions on them."""
    told = mix_sources(docs, doc_id=doc_id, text=text, keys=True, **options)
    told = told.groupBy("rk_id", "rk_hash").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("all"))  # equal rows share a key
    told = materialize(told.filter("all[0] > 0"), "taken")
    own = [c for c in docs.columns if c != "copies"]
    full = docs.select(*row_key(doc_id, text), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)]).join(told, ["rk_id", "rk_hash"])
    nth = F.row_number().over(W.partitionBy("rk_id", "rk_hash").orderBy("rk_id"))
    taken = full.withColumn("nth", F.when(F.size("all") > 1, nth).otherwise(F.lit(1))).withColumn("copies", F.get("all", F.col("nth") - 1))
    return taken.filter("copies > 0").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "copies")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  (('0x' || substr(md5('mix-2:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS step FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
g AS (SELECT source, source_size, least(cap, w * coalesce(max(CASE WHEN cap / w >= level THEN level END) OVER (), 'inf'::DOUBLE)) AS target FROM f),
t AS (SELECT g.*, e.step, e.words, (1 + e.step)::DOUBLE AS wt FROM (SELECT source, step, sum(size)::BIGINT AS words FROM e GROUP BY ALL) e JOIN g ON e.source IS NOT DISTINCT FROM g.source),
v AS (SELECT *, sum(wt * words) OVER (PARTITION BY source ORDER BY wt DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
             target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY wt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS left_over FROM t),
y AS (SELECT *, CASE WHEN above > 0 THEN left_over / above END AS level FROM v),
k AS (SELECT *, least(2.0::DOUBLE, wt * coalesce(max(CASE WHEN 2.0::DOUBLE / wt >= level THEN level END) OVER (PARTITION BY source), 2.0::DOUBLE)) AS copies FROM y),
m AS (SELECT source, source_size, target, step, floor(copies) AS whole, CASE WHEN source_size > 0 THEN copies - floor(copies) ELSE 0 END AS p,
             target - sum(floor(copies) * words) OVER (PARTITION BY source) AS rest FROM k),
j AS (SELECT e.doc_id, e.size, e.source, m.source_size, m.target, m.whole, m.rest, m.p, e.u / (1 - e.u) / CASE WHEN p > 0 THEN m.p / (1 - m.p) END AS odds
      FROM e JOIN m ON e.source IS NOT DISTINCT FROM m.source AND e.step = m.step),
c AS (SELECT *, coalesce(sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source, p > 0 ORDER BY odds / (1 + odds), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM j)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM c
"""
