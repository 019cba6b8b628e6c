"""Substring dedup by counting anchored phrases, with the factors of a relative Lempel-Ziv parse as a report.

What is removed follows from the counts of phrases and windows alone. The factors show to which earlier text a repeated
passage refers; they replace the word-by-word parse, whose matches begin and end up to a phrase further out.

The reference is the corpus itself with every repeated phrase once. Of each window of `WINDOW` words
the 12-word gram with the least hash (the leftmost of equals) is its anchor, so equal windows have
the same anchor at the same place; an anchor with all windows it serves is a phrase. The reference
holds each phrase that occurs more than once at its first place; its blocks are the buckets of a hash
partitioning by anchor, all of which are asked by one join.

A document is factored greedily from left to right: at a phrase that the reference holds, the factor
grows as long as the document's next phrase stands in the reference directly after the one before.
As the reference has each phrase once, that is the longest match at that place. Every window of a
factor repeats. At factor boundaries, where an anchor is known elsewhere but in other surroundings, the
windows are checked one by one, against those of one representative of each different phrase with
that anchor. Words covered by a repeated window are removed. Results are those of comparing all
windows with all others (up to collisions of 128 bits of hashes), but only phrases, about one in
thirteen words, are shuffled.

Anchors and phrases that are common in many documents are dealt to many tasks in joins.

Edge cases: null and empty texts have no words; texts of fewer than `WINDOW` words have no window
and lose nothing; repeated rows repeat each other, so their windows are removed from both; other
columns pass through; a factor of a text in the reference itself refers to its own place; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import BASE_1, BASE_2, join_uneven, materialize, mix, range_hash, read, row_key, small_batches, split_words

WINDOW, GRAM = 35, 12
GRAMS = WINDOW - GRAM + 1  # grams in a window: 24


def phrases(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: place of each anchor, first and last window it serves, its hash, the phrase's fingerprint."""
    if len(h) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(len(h) - GRAM + 1)
    g = range_hash(h, at, at + GRAM, BASE_1)
    least, width = at, 1
    while width < GRAMS:
        step = min(width, GRAMS - width)
        left, right = least[:-step], least[step:]
        least = np.where(g[right] < g[left], right, left)
        width += step
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], len(least)) - 1
    anchor = least[first]
    whole = range_hash(h, first, last + WINDOW, BASE_2) + mix(((anchor - first) * 64 + (last - anchor)).astype(np.uint64))
    return anchor, first, last, g[anchor], whole


def window_keys(h: np.ndarray, anchor: int, first: int, last: int, key: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of a phrase, and two hashes of each."""
    s = np.arange(first, last + 1)
    return s, mix((anchor - s).astype(np.uint64) + key), range_hash(h[first : last + WINDOW], s - first, s - first + WINDOW, BASE_2)


def words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _index(docs: DataFrame) -> DataFrame:
    """(rk_id, rk_hash, i, a, c): the phrases of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [phrases(h)[3:] for h in split_words(b.column(2).to_pylist())]
            n = np.array([len(x[0]) for x in found])
            owner = np.repeat(np.arange(len(n)), n)
            i = np.concatenate([np.arange(k) for k in n]) if len(n) else n
            a, c = (np.concatenate([x[k] for x in found]).view(np.int64) if len(n) else n for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner)), b.column(1).take(pa.array(owner)), pa.array(i, pa.int32()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["rk_id", "rk_hash", "i", "a", "c"])

    return docs.mapInArrow(run, "rk_id long, rk_hash long, i int, a long, c long")


def _boundary_windows(docs: DataFrame) -> DataFrame:
    """(rk_id, rk_hash, text, check: phrases) to (rk_id, rk_hash, s, k1, k2): their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, s, k1, k2 = [], [], [], []
            for d, (h, check) in enumerate(zip(split_words(b.column(2).to_pylist()), b.column(3).to_pylist(), strict=True)):
                anchor, first, last, key, _ = phrases(h)
                for i in check:
                    x = window_keys(h, anchor[i], first[i], last[i], key[i])
                    owner.append(np.full(len(x[0]), d))
                    for col, v in zip((s, k1, k2), x, strict=True):
                        col.append(v)
            if owner:
                o = pa.array(np.concatenate(owner))
                yield pa.RecordBatch.from_arrays([b.column(0).take(o), b.column(1).take(o), pa.array(np.concatenate(s), pa.int32()), pa.array(np.concatenate(k1).view(np.int64)), pa.array(np.concatenate(k2).view(np.int64))], names=["rk_id", "rk_hash", "s", "k1", "k2"])

    return docs.mapInArrow(run, "rk_id long, rk_hash long, s int, k1 long, k2 long")


def parse(first: np.ndarray, last: np.ndarray, found: list[tuple[int, tuple, int]]) -> list[tuple[int, int, tuple, int]]:
    """Factors (start, end in words, reference text, phrase there) of a text; found: (phrase, reference text, phrase there)."""
    out: list[tuple[int, int, tuple, int]] = []
    before = None
    for i, ref, k in sorted(found):
        if before == (i - 1, ref, k - 1):
            out[-1] = (out[-1][0], int(last[i]) + WINDOW, *out[-1][2:])
        else:
            out.append((int(first[i]), int(last[i]) + WINDOW, ref, k))
        before = (i, ref, k)
    return out


def covered(n: int, factors: list[tuple], starts: list[int]) -> np.ndarray:
    """Mask of the words that factors and repeated windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for x, y, *_ in factors:
        edge[x] += 1
        edge[y] -= 1
    for s in starts:
        edge[s] += 1
        edge[s + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, dup_spans (start, end in words), factors (start, end, ref_id: the id of the text they refer to) and kept_text (kept words, one space between)."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_words", "dup_spans", "factors", "kept_text")]
    keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("binary").alias("_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    # the reference: phrases of anchors that occur more than once
    index = _index(keyed.select("rk_id", "rk_hash", "_text"))
    twice = materialize(index.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1"), "anchors")
    live = materialize(join_uneven(index, twice, ["a"]).drop("n"), "phrases")
    place = F.struct("rk_id", "rk_hash", "i")
    by_phrase = live.groupBy("a", "c").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    by_anchor = by_phrase.groupBy("a").agg(F.count("*").alias("kinds"))
    reference = materialize(by_phrase.join(by_anchor, "a").filter("n > 1 OR kinds > 1"), "reference")
    told = join_uneven(live, reference, ["a", "c"])
    ref = F.when(F.col("n") > 1, F.struct("i", F.col("one.rk_id").alias("ref_id"), F.col("one.rk_hash").alias("ref_hash"), F.col("one.i").alias("ref_i")))
    check = F.when((F.col("kinds") > 1) & ((F.col("n") == 1) | (F.col("one") == place)), F.col("i"))
    told = told.select("rk_id", "rk_hash", ref.alias("ref"), check.alias("check")).filter("ref IS NOT NULL OR check IS NOT NULL")
    told = materialize(told.groupBy("rk_id", "rk_hash").agg(F.collect_set("ref").alias("found"), F.collect_set("check").alias("check")), "factors")
    # boundaries
    unsure = keyed.select("rk_id", "rk_hash", "_text").join(told.filter(F.size("check") > 0).select("rk_id", "rk_hash", "check"), ["rk_id", "rk_hash"])
    windows = materialize(_boundary_windows(unsure.dropDuplicates(["rk_id", "rk_hash"])), "windows")
    again = materialize(windows.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1"), "again")
    starts = join_uneven(windows, again, ["k1", "k2"]).groupBy("rk_id", "rk_hash").agg(F.collect_set("s").alias("starts"))
    # factors and what is left
    both = keyed.join(told.select("rk_id", "rk_hash", "found").join(starts, ["rk_id", "rk_hash"], "full"), ["rk_id", "rk_hash"], "left").drop("rk_id", "rk_hash")
    span, factor = (T.StructType().add("start", "long").add("end", "long") for _ in range(2))
    factor.add("ref_id", "long")
    schema = T.StructType([keyed.schema[f"c{i}"] for i in range(len(own))]).add("n_words", "long").add("dup_spans", T.ArrayType(span)).add("factors", T.ArrayType(factor)).add("kept_text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans, parsed, kept = [], [], [], []
            for t, found, at in zip(b.column(0).to_pylist(), b.column(len(own) + 1).to_pylist(), b.column(len(own) + 2).to_pylist(), strict=True):
                ws = words(t)
                n.append(len(ws))
                if not found and not at:
                    spans.append([])
                    parsed.append([])
                    kept.append(b" ".join(ws).decode())
                    continue
                _, first, last, _, _ = phrases(split_words([t])[0])
                factors = parse(first, last, [(r["i"], (r["ref_id"], r["ref_hash"]), r["ref_i"]) for r in found or ()])
                edge = np.flatnonzero(np.diff(np.concatenate(([0], covered(len(ws), factors, at or []).view(np.int8), [0]))))
                spans.append([{"start": x, "end": y} for x, y in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
                parsed.append([{"start": x, "end": y, "ref_id": r[0] if r[0] != -(2**63) else None} for x, y, r, _ in factors])
                ends = [0, *edge.tolist(), len(ws)]
                kept.append(b" ".join([w for x, y in zip(ends[::2], ends[1::2], strict=True) for w in ws[x:y]]).decode())
            cols = [b.column(i + 1) for i in range(len(own))]
            fields = [("start", pa.int64()), ("end", pa.int64())]
            kinds = pa.list_(pa.struct(fields)), pa.list_(pa.struct([*fields, ("ref_id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(spans, kinds[0]), pa.array(parsed, kinds[1]), pa.array(kept, pa.string())], names=schema.names)

    out = both.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "n_words", "dup_spans", "factors", "kept_text")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"))
    # neither the text itself nor the factors are returned
    removed = F.aggregate("dup_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT rid, i, md5(array_to_string(ws[i:i+34], ' ')) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS n FROM w) WHERE n > 1),
p AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT rid, doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
k AS (SELECT x.rid, count(*) - count(p.p) AS n_kept, string_agg(x.w, ' ' ORDER BY x.p) FILTER (p.p IS NULL) AS t FROM x LEFT JOIN p ON x.rid = p.rid AND x.p = p.p GROUP BY x.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (rid)
"""
