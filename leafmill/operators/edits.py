"""Manual edits of paragraphs and artifacts, digests of sections and the context of a paragraph.

Edits are a table (one row an edit, the latest of each target counts); they are joined to the rows that they
change, and only those lose their analysis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARAGRAPH_ACTIONS = ["mark-noise", "restore", "merge-next", "split", "set-section"]
ARTIFACT_ACTIONS = ["hide", "restore", "set-type", "set-text", "set-label", "set-crop"]


def latest(edits: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """The latest edit of each target; of edits at the same time the greatest action counts."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("action").desc()))
    return edits.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def _joined(a: Column, b: Column) -> Column:
    hyphen = F.endswith(a, F.lit("-")) & b.rlike("^[a-z]")
    return F.when(hyphen, F.concat(F.expr("substring(text, 1, length(text) - 1)"), b)).otherwise(F.trim(F.concat(a, F.lit(" "), b)))


def edit_paragraphs(paragraphs: DataFrame, edits: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """paragraphs (doc, ord, kind, text, section, eligible, analysis) with edits (doc, ord, at, action, first, second, section) applied; adds `part` and `state`.

    state: '' or what was done. merge-next takes the next row in, unless a heading or the end comes first
    (state `refused`) or that row is itself edited away; a row merged away is left out. split needs two texts that
    aren't blank (else `refused`); its second half has part 1. Headings can't be edited. Of two rows of which each would
    take the next, the first wins. Changed rows lose their analysis.
    """
    own = [c for c in paragraphs.columns if c not in ("part", "state")]
    e = latest(edits.filter(F.col("action").isin(PARAGRAPH_ACTIONS)), [doc, order]).select(doc, order, "action", F.trim(F.coalesce("first", F.lit(""))).alias("_first"), F.trim(F.coalesce("second", F.lit(""))).alias("_second"), F.col("section").alias("_section"))
    by = W.partitionBy(doc).orderBy(order)
    rows = paragraphs.select(*own).join(e, [doc, order], "left").withColumn("action", F.when(F.col("kind") == "paragraph", F.col("action")))
    rows = rows.withColumns({"_next": F.lead("kind").over(by), "_next_text": F.lead("text").over(by)})
    wants = (F.col("action") == "merge-next") & (F.coalesce("_next", F.lit("")) == "paragraph")
    rows = rows.withColumn("_wants", F.coalesce(wants, F.lit(False)))
    # in a run of rows that all want the next, every second one gets it
    fresh = F.when(F.col("_wants") & ~F.coalesce(F.lag("_wants").over(by), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("_run", F.sum(fresh).over(by))
    nth = F.row_number().over(W.partitionBy(doc, "_run", "_wants").orderBy(order))
    rows = rows.withColumn("_takes", F.col("_wants") & (nth % 2 == 1))
    rows = rows.withColumn("_taken", F.coalesce(F.lag("_takes").over(by), F.lit(False))).filter("NOT _taken")
    splits = (F.col("action") == "split") & (F.col("_first") != "") & (F.col("_second") != "")
    state = (
        F.when(F.col("action").isNull(), "").when(F.col("action") == "merge-next", F.when(F.col("_takes"), "merge-next").otherwise("refused"))
        .when(F.col("action") == "split", F.when(splits, "split").otherwise("refused")).otherwise(F.col("action"))
    )
    rows = rows.withColumn("state", state).withColumn("part", F.explode(F.when(F.col("state") == "split", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = ~F.col("state").isin("", "refused")
    text = F.when(F.col("state") == "merge-next", _joined(F.col("text"), F.col("_next_text"))).when((F.col("state") == "split") & (F.col("part") == 0), F.col("_first")).when(F.col("state") == "split", F.col("_second")).otherwise(F.col("text"))
    eligible = F.when(F.col("state") == "mark-noise", F.lit(False)).when(F.col("state").isin("restore", "merge-next", "split"), F.lit(True)).otherwise(F.col("eligible"))
    section = F.when(F.col("state") == "set-section", F.col("_section")).otherwise(F.col("section"))
    analysis = F.when(changed, F.lit(None)).otherwise(F.col("analysis"))
    return rows.withColumns({"text": text, "eligible": eligible, "section": section, "analysis": analysis}).select(*own, "part", "state")


def edit_artifacts(artifacts: DataFrame, edits: DataFrame, key: str = "artifact_id") -> DataFrame:
    """artifacts (artifact_id, type, text, label, hidden, x, y, width, height) with the latest edit of each field: (artifact_id, at, action, value, x, y, width, height); adds `edited`, a list of actions.

    Edits of different fields add up; hide and restore are edits of one field. An empty value is kept for texts and labels, but not for types.
    """
    field = F.when(F.col("action").isin("hide", "restore"), "hidden").otherwise(F.col("action"))
    last = latest(edits.filter(F.col("action").isin(ARTIFACT_ACTIONS) & ~((F.col("action") == "set-type") & (F.coalesce("value", F.lit("")) == ""))).withColumn("field", field), [key, "field"])
    value = F.struct("action", "value", "x", "y", "width", "height")
    by = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", value.alias("v")))).alias("_e"), F.array_sort(F.collect_set("action")).alias("edited"))
    own = [c for c in artifacts.columns if c != "edited"]
    rows = artifacts.select(*own).join(by, key, "left")
    at = lambda f: F.get(F.transform(F.filter(F.map_entries("_e"), lambda e: e["key"] == f), lambda e: e["value"]), F.lit(0))
    new = {c: F.when(at(f).isNotNull(), at(f)["value"]).otherwise(F.col(c)) for c, f in (("type", "set-type"), ("text", "set-text"), ("label", "set-label"))}
    new |= {c: F.when(at("set-crop").isNotNull(), at("set-crop")[c]).otherwise(F.col(c)) for c in ("x", "y", "width", "height")}
    new["hidden"] = F.when(at("hidden").isNotNull(), at("hidden")["action"] == "hide").otherwise(F.col("hidden"))
    return rows.withColumns(new | {"edited": F.coalesce("edited", F.array().cast("array<string>"))}).select(*own, "edited")


def section_digests(paragraphs: DataFrame, artifacts: DataFrame, keys: list[str], terms: Column, symbols: Column, most: int = 24) -> DataFrame:
    """paragraphs (keys: document and section, ord, text) and artifacts (keys, artifact_id, kind) to one digest a section.

    Members in order, the first `most` distinct terms and symbols, formulas and visuals by kind, and a fingerprint that changes
    with the members' texts, not with the order of rows. terms and symbols: array columns of a paragraph.
    """
    rows = paragraphs.select(*keys, "ord", F.coalesce("text", F.lit("")).alias("text"), terms.alias("t"), symbols.alias("s"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.sha1("text").alias("h"), "t", "s")))
    parts = rows.groupBy(*keys).agg(ordered.alias("p"), F.count("*").alias("members"), F.min("ord").alias("first"), F.max("ord").alias("last"))
    flat = lambda f: F.slice(F.array_distinct(F.flatten(F.transform("p", lambda v: v[f]))), 1, most)
    digests = parts.select(*keys, "members", "first", "last", flat("t").alias("terms"), flat("s").alias("symbols"), F.substring(F.sha1(F.array_join(F.transform("p", lambda v: v["h"]), ",")), 1, 24).alias("fingerprint"))
    of = lambda kinds: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*kinds), F.col("artifact_id"))))
    seen = artifacts.groupBy(*keys).agg(of(["formula"]).alias("formulas"), of(["figure", "table", "caption"]).alias("visuals"))
    none = F.array().cast("array<string>")
    return digests.join(seen, keys, "left").withColumns({"formulas": F.coalesce("formulas", none), "visuals": F.coalesce("visuals", none)})


def paragraph_context(paragraphs: DataFrame, sections: DataFrame, keys: list[str], order: str = "ord", before: int = 180, after: int = 140, most: int = 1100) -> DataFrame:
    """paragraphs (keys, ord, section, text) with `context`: the section, what stands before and after, cut at `most` characters.

    sections: keys, section, title, summary.
    """
    by = W.partitionBy(*keys).orderBy(order)
    cut = lambda c, n: F.when(F.length(c) <= n, c).otherwise(F.concat(F.trim(F.substring(c, 1, n - 1)), F.lit("…")))
    rows = paragraphs.withColumns({"_before": F.lag("text").over(by), "_after": F.lead("text").over(by)}).join(sections.select(*keys, "section", F.col("title").alias("_title"), F.col("summary").alias("_summary")), [*keys, "section"], "left")
    told = lambda label, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), cut(c, n)))
    whole = F.concat_ws("\n\n", told("Section", F.col("_title"), 120), told("Summary", F.col("_summary"), 300), told("Before", F.col("_before"), before), told("After", F.col("_after"), after))
    return rows.withColumn("context", cut(whole, most)).drop("_before", "_after", "_title", "_summary")
