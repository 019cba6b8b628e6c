"""Audit of how far the sources of a language diverge, by tiles of group blocks.

A group is a (lang, source). Documents are counted into (lang, source, term) rows with occurrences and
documents at once: tasks count the bytes of Arrow batches and hand on partial counts, an aggregation sums them; a language keeps the terms in at least `least_docs` of its
documents. Groups are numbered within a language and cut into blocks of `block_groups`; kept terms are
dealt by hash to vocabulary chunks of about `chunk_terms`. One packed row holds the counts of a block
of groups in one chunk. Each packed row is replicated to the tiles (block, other block) that it takes
part in; a tile's task walks the chunks one after another, makes the two blocks' count matrices of the
chunk and adds the chunk's part to the tile's submatrix of pairs, so a task holds two matrices of
block_groups x chunk_terms however large the vocabulary is. A tile's chunks are cut into spans of
`span_chunks`, each a task of its own, whose submatrices are summed.

All arithmetic is exact: shares per billion come from a long division in steps of 1000, which stays
inside 64 bits up to 9 * 10**15 occurrences a group, and values are floored 64-bit quotients.

The number of groups of a language bounds what its windows hold; the result has that number squared
rows, by its contract.

Edge cases: null text, lang and source count as '', and '' is a language and a source like others; a
group without terms, or without kept ones, has its pairs; a language with one group has none; without kept terms
all values are 0; equal values are ranked by item in UTF-8 order; equal rows are documents of their own;
texts of any length are counted whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, read, small_batches

#: Bytes of text: terms are runs of letters and of bytes beyond ASCII (all of a character's bytes are), A-Z in lower case; all else is a space.
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
#: Terms that a task's partial counts hold at most (but for one batch), rows handed on at once, and bytes of a text that are cut into terms at once.
HELD_TERMS, OUT_ROWS, PIECE = 300_000, 20_000, 4 << 20
LEAST_DOCS, TOP, BILLION = 10, 10, 1_000_000_000
BLOCK_GROUPS, CHUNK_TERMS, SPAN_CHUNKS = 32, 8192, 16


def count_terms(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term) with n (occurrences) and docs (documents that hold it)."""
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    small_batches(docs.sparkSession)
    slim = docs.select(blank(lang, "lang"), blank(source, "source"), F.make_valid_utf8(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("binary").alias("text"))
    parts = slim.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text, of about PIECE bytes of it at a time."""
    flat, at = text.translate(_PLAIN), 0
    while at < len(flat):
        end = flat.find(b" ", at + PIECE) if len(flat) - at > PIECE else -1
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of lang, source, text (bytes): what a task has counted is handed on when it holds HELD_TERMS."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for at in range(0, len(terms), OUT_ROWS):
                part = terms[at : at + OUT_ROWS]
                same = [pa.repeat(pa.scalar(v, pa.string()), len(part)) for v in (lang, source)]
                found = [pa.array([of[w] for w in part], pa.int64()) for of in (n, docs)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(part, pa.binary()).cast(pa.string()), *found], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for terms in _pieces(text):
                n.update(terms)
                seen.update(terms)
            docs.update(seen)
        if sum(len(n) + 1 for n, _ in held.values()) > HELD_TERMS:
            yield from flushed()
    yield from flushed()


def per_billion(count: Column, whole: Column) -> Column:
    """1 + floor(10**9 * count / whole), without leaving 64 bits."""
    div = lambda a: F.call_function("div", a, whole)
    out, rest = div(count), count % whole
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000), (rest * 1000) % whole
    return out + 1


def numpy_per_billion(count: np.ndarray, whole: int) -> np.ndarray:
    out, rest = count // whole, count % whole
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // whole, rest * 1000 % whole
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def kept_terms(counts: DataFrame, least_docs: int, chunk_terms: int) -> tuple[DataFrame, DataFrame]:
    """(lang, term, n_lang, chunk, ti) of kept terms, and (lang, terms, n_lang, chunks) of languages that keep any."""
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(kept, "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("of_lang")).withColumn("chunks", F.ceil(F.col("terms") / chunk_terms).cast("int"))
    langs = materialize(langs, "languages")
    dealt = kept.join(langs.select("lang", "chunks"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    return dealt.withColumn("ti", F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks"), langs


_TILE = "lang string, a int, b int, part long"


def tiles(packed: DataFrame) -> DataFrame:
    """(lang, a, b, value) for a < b: the sum over all chunks of what the pair of groups differs by.

    packed: lang, block, blocks, chunk, span, terms (of the chunk), v (terms of the language), totals (by group of
    the block) and cells (gi within the block, ti within the chunk, n).
    """
    own, other = F.least("block", "with_block"), F.greatest("block", "with_block")
    dealt = packed.withColumn("with_block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"low": own, "high": other})
    key = ["lang", "low", "high", "span"]
    dealt = dealt.repartition(*key).sortWithinPartitions(*key, "chunk", "block")

    def matrix(r: dict) -> np.ndarray:
        cells, of = r["cells"], np.array(r["totals"], np.int64)
        count = np.full((len(of), r["terms"]), 2, np.int64)
        if len(cells):
            count[cells.field("gi").to_numpy(), cells.field("ti").to_numpy()] += cells.field("n").to_numpy()
        return np.stack([numpy_per_billion(c, int(n) + 2 * r["v"]) for c, n in zip(count, of, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in batches:
                plain = b.select([n for n in b.schema.names if n != "cells"]).to_pylist()
                cells = b.column(b.schema.get_field_index("cells"))
                for i, r in enumerate(plain):
                    yield r | {"cells": cells[i].values}

        def done() -> pa.RecordBatch:
            lang, low, high, _ = at
            x, y = np.nonzero(np.ones_like(total) if low != high else np.triu(np.ones_like(total), 1))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array((x + low * size).astype(np.int32)), pa.array((y + high * size).astype(np.int32)), pa.array(total[x, y])], names=["lang", "a", "b", "part"])

        at, total, first, size = None, None, None, 0
        for r in rows():
            key = (r["lang"], r["low"], r["high"], r["span"])
            if key != at:
                if at is not None:
                    yield done()
                at, total, first, size = key, None, None, r["size"]
            m = matrix(r)
            if r["low"] != r["high"] and r["block"] == r["low"]:
                first = m
                continue
            left = m if r["low"] == r["high"] else first
            total = np.zeros((len(left), len(m)), np.int64) if total is None else total
            for i, p in enumerate(left):
                js = slice(i + 1, None) if r["low"] == r["high"] else slice(None)
                gap = m[js] - p
                total[i, js] += (gap * gap // (m[js] + p)).sum(1)
        if at is not None:
            yield done()

    parts = dealt.select(*key, "block", "chunk", "terms", "v", "totals", "size", "cells").mapInArrow(run, _TILE)
    return parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP, block_groups: int = BLOCK_GROUPS, chunk_terms: int = CHUNK_TERMS, span_chunks: int = SPAN_CHUNKS) -> DataFrame:
    """One row per group and other source of its language (part 'pair'), and per group and each of its `top` terms (part 'term')."""
    names = {"text": text, "lang": lang, "source": source}
    counts = materialize(count_terms(docs, **names), "counts")
    kept, langs = kept_terms(counts, least_docs, chunk_terms)
    held = materialize(counts.drop("docs").join(kept, ["lang", "term"]), "held")
    blank = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    groups = docs.select(blank(lang, "lang"), blank(source, "source")).distinct().join(held.groupBy("lang", "source").agg(F.sum("n").alias("of_group")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").fillna(0, ["of_group", "terms", "of_lang"]).fillna(1, ["chunks"])
    groups = materialize(groups.withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).withColumn("block", F.call_function("div", F.col("g"), F.lit(block_groups)).cast("int")), "groups")

    numbered = held.join(groups.select("lang", "source", "block", (F.col("g") % block_groups).cast("int").alias("gi")), ["lang", "source"])
    cells = numbered.groupBy("lang", "block", "chunk").agg(F.collect_list(F.struct("gi", "ti", "n")).alias("cells"))
    totals = F.transform(F.sort_array(F.collect_list(F.struct("g", "of_group"))), lambda x: x["of_group"])
    blocks = groups.groupBy("lang", "block").agg(totals.alias("totals"), F.first("terms").alias("v"), F.first("chunks").alias("chunks"))
    blocks = blocks.join(groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks")), "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sizes = kept.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("terms"))
    packed = blocks.join(sizes, ["lang", "chunk"], "left").join(cells, ["lang", "block", "chunk"], "left").fillna(0, ["terms"])
    none = F.array().cast("array<struct<gi:int,ti:int,n:bigint>>")
    packed = packed.withColumns({"cells": F.coalesce("cells", none), "span": F.call_function("div", F.col("chunk"), F.lit(span_chunks)).cast("int"), "size": F.lit(block_groups)})
    value = materialize(tiles(packed), "pairs")

    name = groups.select("lang", "g", "source")
    both = value.join(name.withColumnsRenamed({"g": "a", "source": "a_source"}), ["lang", "a"]).join(name.withColumnsRenamed({"g": "b", "source": "b_source"}), ["lang", "b"])
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("x"), "value")
    by = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(by))

    p, q = per_billion(F.col("n") + 2, F.col("of_group") + 2 * F.col("terms")), per_billion(F.col("n_lang") + 2, F.col("of_lang") + 2 * F.col("terms"))
    shares = held.join(groups.select("lang", "source", "of_group", "terms", "of_lang"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q"))
    terms = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", divergence(F.col("p"), F.col("q")).alias("value"))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(ts) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM w GROUP BY lang, term HAVING count(*) >= 10),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, w.source, w.term, sum(w.n)::BIGINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(any_value(t.total), 0)::BIGINT AS total FROM d LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL) t USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * l.v))::BIGINT AS p,
           (1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v))::BIGINT AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u) z WHERE part = 'pair' OR rank <= 10
"""
