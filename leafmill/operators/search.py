"""Search over documents and matches of a glossary, with their terms as parameters or tables.

A glossary is a table of terms; it is measured before it is broadcast as an automaton, and dealt to blocks
of a stated size beyond that, each a scan of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from leafmill.functions import text as T
from leafmill.functions.dual import x

BEFORE, LENGTH = 56, 180


def search(docs: DataFrame, fields: list[str], query: str) -> DataFrame:
    """docs whose fields, joined by spaces, hold the query ignoring case, with `at` (1-based) and `snippet` of 180 characters around it.

    The query is collapsed, lowered and cut to 120 characters; a blank one finds all, with an empty snippet. Null fields are left out.
    """
    clean = " ".join(query.lower().split())[:120]
    own = [c for c in docs.columns if c not in ("at", "snippet")]
    whole = F.concat_ws(" ", *[F.col(c).cast("string") for c in fields])
    if not clean:
        return docs.select(*own, F.lit(0).cast("long").alias("at"), F.lit("").alias("snippet"))
    found = docs.select(F.struct(*own).alias("row"), whole.alias("_w")).select("row", "_w", F.instr(F.lower("_w"), clean).cast("long").alias("at")).filter("at > 0")
    cut = F.when(F.col("at") > BEFORE + 1, F.concat(F.lit("..."), F.substring("_w", F.col("at").cast("int") - BEFORE, F.lit(LENGTH)))).otherwise(F.substring("_w", 1, LENGTH))
    return found.select("row.*", "at", cut.alias("snippet"))


def facets(docs: DataFrame, equal: dict[str, str] | None = None, tag: tuple[str, str] | None = None, flags: list[str] | None = None) -> DataFrame:
    """docs whose columns equal the given values ignoring case, whose array column has the tag, and whose flags are true."""
    for c, v in (equal or {}).items():
        docs = docs.filter(F.lower(F.trim(F.col(c).cast("string"))) == v.strip().lower())
    if tag is not None:
        docs = docs.filter(F.exists(tag[0], lambda t: F.lower(F.trim(t)) == tag[1].strip().lower()))
    return reduce(lambda d, c: d.filter(F.coalesce(F.col(c), F.lit(False))), flags or [], docs)


def _comparable(name: str) -> Column:
    return T.comparable(x(name)).col()


def _blocks(glossary: DataFrame, max_chars: int) -> Iterator[dict[str, list[str]]]:
    """Variants of two characters or more, comparable, with the terms that have them; blocks of at most about max_chars characters."""
    rows = glossary.select("term", F.explode(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("v"))
    rows = rows.withColumn("v", _comparable("v")).filter("length(v) >= 2 AND term IS NOT NULL").distinct()
    k = -(-(rows.agg(F.sum(F.length("v"))).first()[0] or 0) // max_chars) or 1
    for b in range(k):
        block: dict[str, list[str]] = {}
        for r in rows.filter(F.pmod(F.xxhash64("term"), F.lit(k)) == b).collect():
            block.setdefault(r.v, []).append(r.term)
        yield block


def glossary_matches(texts: DataFrame, keys: list[str], glossary: DataFrame, text: str = "text", max_chars: int = 1 << 20) -> DataFrame:
    """(keys, term): each term of the glossary (term, aliases: array) that a text holds by itself or by an alias, as substrings without case, spaces and punctuation.

    A text is read once, by an automaton of all variants, whatever their number; glossaries of more than max_chars characters are dealt to blocks, a
    scan each. Null texts hold nothing; a row for each term of each row of texts.
    """
    rows = texts.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("_t")).select(*keys, _comparable("_t").alias("_t"))
    schema = T_.StructType([rows.schema[k] for k in keys]).add("term", "string")
    out = None
    for block in _blocks(glossary, max_chars):
        held = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for variant, terms in held.value.items():
                automaton.add_word(variant, terms)
            automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for i, t in enumerate(b.column(len(keys)).to_pylist() if held.value else ()):
                    terms = {term for _, named in automaton.iter(t) for term in named}
                    at += [i] * len(terms)
                    found += sorted(terms)
                idx = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in range(len(keys))], pa.array(found, pa.string())], names=schema.names)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def dropped_terms(sources: DataFrame, outputs: DataFrame, keys: list[str], glossary: DataFrame, text: str = "text") -> DataFrame:
    """(keys, term): terms that a source holds and its output doesn't, by any variant."""
    return glossary_matches(sources, keys, glossary, text).join(glossary_matches(outputs, keys, glossary, text), [*keys, "term"], "left_anti")
