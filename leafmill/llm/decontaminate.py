"""Benchmark decontamination: a broadcast hash set of benchmark n-grams, scanned against all windows.

The set is arrays: the sorted 64-bit hashes of all different windows by their length, for each the place of one
occurrence and the items that hold it, and the benchmark's text: at most 24 bytes a word besides the text itself, some
five bytes for each byte of a block of at most `max_block_bytes`. It is built once, on the driver, and broadcast. Hash hits are
verified word by word against the benchmark's text; equal windows are one, so a window is verified once wherever it
stands, and a text that repeats itself takes no longer than another.

The benchmark's size is measured before it is collected; beyond `max_block_bytes` it is dealt
into blocks of at most about that size (by hash of its text; items of more than `piece_words` words are cut
into pieces that overlap by a window first). The documents are scanned once per block, each scan
writes its hits alone, and the hits of all blocks are united by document.

Edge cases: null and empty texts have no words and are never contaminated; an item without words
matches nothing; an item of fewer than `n` words is one window; items with equal ids count once, and
a null id counts as the id ''; an empty benchmark hits nothing; repeated document rows are judged one
by one; other columns pass through unchanged, and columns with the names of the added ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import BASE_1, materialize, range_hash, read, small_batches, word_hashes

N = 13
MAX_BLOCK_BYTES, PIECE_WORDS = 4 << 20, 100_000

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` stay (upper-case ones lowered), all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def _flat(text: bytes | None) -> bytes:
    """The words of a text, one space between."""
    return b" ".join(words_of(text))


class NgramSet:
    """The benchmark's windows as sorted hashes, and its words to verify hits by."""

    def __init__(self, items: list[tuple[str, bytes]], n: int = N) -> None:
        self.n, self.ids = n, [i for i, _ in items]
        flat = [_flat(t) for _, t in items]
        h, counts = word_hashes(flat)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # of each item's words
        self.text = b" ".join(f for f in flat if f)
        space = np.flatnonzero(np.frombuffer(self.text, np.uint8) == 32).astype(np.int32)
        self.at = np.concatenate(([0], space + 1, [len(self.text) + 1])).astype(np.int32)  # of each word's text
        # by length of window: sorted hashes, for each the place of one occurrence, and where its items begin in the last array
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.minimum(counts, n)
        for k in np.unique(size[size > 0]).tolist():
            of = np.flatnonzero(size == k)
            lo = np.concatenate([np.arange(self.first[i], self.first[i + 1] - k + 1) for i in of])
            keys = range_hash(h, lo, lo + k, BASE_1)
            order = np.argsort(keys, kind="stable")
            self.hashes[k] = self._grouped(keys[order], lo[order], k)

    def _grouped(self, keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Equal windows as one with its distinct items; windows of one hash but other words are groups of their own."""
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        group = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        moved: dict[tuple[int, bytes], int] = {}
        for i in np.flatnonzero(~fresh).tolist():
            if (text := self.window(places[i], size)) != self.window(places[first[group[i]]], size):
                group[i] = moved.setdefault((int(keys[i]), text), len(first) + len(moved))
        items = np.searchsorted(self.first, places, "right") - 1
        pairs = np.unique(np.stack([group, items]), axis=1)
        one = np.unique(group, return_index=True)[1]  # an occurrence of each group
        order = np.argsort(keys[one], kind="stable")
        rank = np.argsort(order)  # of each group
        at = np.argsort(rank[pairs[0]], kind="stable")
        begins = np.searchsorted(rank[pairs[0]][at], np.arange(len(one) + 1))
        return keys[one][order], places[one][order].astype(np.int32), begins.astype(np.int32), pairs[1][at].astype(np.int32)

    def window(self, place: int, size: int) -> bytes:
        return self.text[self.at[place] : self.at[place + size] - 1]

    @property
    def nbytes(self) -> int:
        return len(self.text) + self.at.nbytes + self.first.nbytes + sum(x.nbytes for arrays in self.hashes.values() for x in arrays)

    def scan(self, words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """A mask of the words inside occurring windows, and the items that have one; h: the words' hashes."""
        total, items = len(words), set()
        edge = np.zeros(total + 1, np.int64)
        for size, (keys, places, begins, owners) in self.hashes.items():
            if total < size:
                continue
            lo = np.arange(total - size + 1)
            mine = range_hash(h, lo, lo + size, BASE_1)
            left = np.searchsorted(keys, mine)
            found = set()
            for i in np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == mine).tolist():
                window, k = b" ".join(words[i : i + size]), int(left[i])
                while k < len(keys) and keys[k] == mine[i]:
                    if self.window(places[k], size) == window:  # the hit is verified word by word
                        edge[i] += 1
                        edge[i + size] -= 1
                        found.add(k)
                        break
                    k += 1
            items.update(self.ids[o] for k in found for o in owners[begins[k] : begins[k + 1]].tolist())
        return np.cumsum(edge[:-1]) > 0, items

    def scan_all(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """(number of words, mask, items) of each text."""
        flat = [_flat(t) for t in texts]
        h, counts = word_hashes(flat)
        end = np.cumsum(counts)
        for f, e, k in zip(flat, end.tolist(), counts.tolist(), strict=True):
            yield k, *self.scan(f.split(), h[e - k : e])


def _pieces(rows: DataFrame, n: int, piece_words: int) -> DataFrame:
    """(i, t): items of many words as pieces of them that share n - 1 words, so that no window is lost or added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ws = words_of(t)
                for at in range(0, max(1, len(ws) - n + 1), piece_words):
                    ids.append(i)
                    texts.append(b" ".join(ws[at : at + piece_words + n - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.binary())], names=["i", "t"])

    return rows.mapInArrow(run, "i string, t binary")


def _blocks(benchmark: DataFrame, item_id: str, text: str, bound: int, n: int, piece_words: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of blocks, and the blocks one after another."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t")).filter("t IS NOT NULL")
    size = rows.agg(F.sum(F.length("t") + F.length("i"))).first()[0] or 0
    k = -(-size // bound) or 1
    if k > 1:
        rows = materialize(_pieces(rows, n, piece_words), "pieces")
    parts = (rows if k == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(k)) == b) for b in range(k))
    return k, ([(r.i, bytes(r.t)) for r in part.collect()] for part in parts)


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
    return [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]


_HIT = T.StructType().add("start", "long").add("end", "long")
ADDED = T.StructType().add("n_words", "long").add("hit_spans", T.ArrayType(_HIT)).add("hit_items", T.ArrayType(T.StringType()))
_KINDS = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]


def _scan(rows: DataFrame, grams: Broadcast, only_hit: bool = False) -> DataFrame:
    """rows (the last column is the text, binary) with the columns of ADDED in its place; grams: a broadcast NgramSet."""
    schema = T.StructType(rows.schema.fields[:-1] + ADDED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(grams.value.scan_all(b.column(b.num_columns - 1).to_pylist()))
            at = [i for i, x in enumerate(found) if x[2] or not only_hit]
            cols = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
            added = zip(*[(found[i][0], _spans(found[i][1]), sorted(found[i][2])) for i in at], strict=True) if at else ((), (), ())
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(list(x), t) for x, t in zip(added, _KINDS, strict=True)]], names=schema.names)

    return rows.mapInArrow(run, schema)


def _united(hits: DataFrame) -> DataFrame:
    """(k, n_words, hit_spans, hit_items) of all blocks to one row a text."""
    lists = hits.groupBy("k").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hit_spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("hit_items"))
    # spans in order: one that begins within those before makes the last one longer
    step = lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s)))
    spans = F.aggregate(F.array_sort("s"), F.array().cast(ADDED["hit_spans"].dataType), lambda a, s: F.when(F.size(a) == 0, F.array(s)).otherwise(step(a, s)))
    return lists.select("k", "n_words", spans.alias("hit_spans"), "hit_items")


def mark(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, max_block_bytes: int = MAX_BLOCK_BYTES, piece_words: int = PIECE_WORDS) -> DataFrame:
    """docs with `n_words`, `hit_spans` (array of (start, end) in words) and `hit_items` (sorted ids)."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ADDED.names]
    mine, back = [F.col(c).alias(f"c{i}") for i, c in enumerate(own)], [F.col(f"c{i}").alias(c) for i, c in enumerate(own)]
    context = docs.sparkSession.sparkContext
    n_blocks, blocks = _blocks(benchmark, item_id, item_text, max_block_bytes, n, piece_words)
    if n_blocks == 1:
        return _scan(docs.select(*mine, F.col(text).cast("binary").alias("_text")), context.broadcast(NgramSet(next(blocks), n))).select(*back, *ADDED.names)
    key = F.md5(F.coalesce(F.col(text), F.lit(""))).alias("k")
    hits = None
    for items in blocks:
        grams = context.broadcast(NgramSet(items, n))
        found = materialize(_scan(docs.select(key, F.col(text).cast("binary").alias("_text")), grams, only_hit=True), "hits")
        grams.destroy()  # the hits are written
        hits = found if hits is None else hits.unionByName(found)
    hits = materialize(_united(hits), "hits")
    joined = docs.select(*mine, key, F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long").alias("n")).join(hits.drop("n_words"), "k", "left")
    none = [F.coalesce(c, F.array().cast(ADDED[c].dataType)).alias(c) for c in ADDED.names[1:]]
    return joined.select(*back, F.col("n").alias("n_words"), *none)


def n_hit():
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated():
    """A document goes if at least a twentieth of its words, and one at least, is hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones."""
    return mark(docs, benchmark, **options).filter(~contaminated()).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs whose hit words, with what lies between the words of a span, are cut from the text."""
    marked = mark(docs, benchmark, text=text, **options)
    small_batches(docs.sparkSession)
    schema = marked.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text)
            new = [_cut(t, s) for t, s in zip(batch.column(k).to_pylist(), batch.column("hit_spans").to_pylist(), strict=True)]
            yield batch.set_column(k, batch.schema.field(k), pa.array(new, batch.schema.field(k).type))

    return marked.mapInArrow(cut, schema).select(*docs.columns)


def _cut(text: str | None, spans: list[dict]) -> str | None:
    if not text or not spans:
        return text
    raw, ends, i, out = text.encode(), [], 0, b""
    flat = raw.translate(_TABLE)
    for w in flat.split():
        i = flat.index(w, i)
        ends.append((i, i := i + len(w)))
    i = 0
    for s in spans:
        out += raw[i : ends[s["start"]][0]]
        i = ends[s["end"] - 1][1]
    return (out + raw[i:]).decode()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    m = mark(docs, read(spark, sf_dir, "benchmark"))
    return m.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, len(ws[i:i+least(12, len(ws)-1)]) AS n, array_to_string(ws[i:i+least(12, len(ws)-1)], ' ') AS s
       FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(ws[i:i+n-1], ' ') AS s
       FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hits AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
pos AS (SELECT rid, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hits) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""
