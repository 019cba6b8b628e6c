"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `ORDER` bytes with escape estimation (method D: of N
occurrences of a context with D distinct successors, each successor gives half a count to the escape,
D / 2N in all) and symbol exclusion: after an escape,
the successors of the longer context no longer count in the shorter one. Texts are lower-cased
(A-Z), begin after ORDER bytes 0xFF and end with one 0xFF, which no UTF-8 text contains, so the
probabilities of all texts sum to one.

Pretrained scoring is distributed. The trie is a set of tables (gram, count), one for each order;
all grams of the corpus get their log-probability by joins of those tables. Documents are dealt
into groups of bounded size by a hash; a group asks for the distinct grams and words it holds,
buckets of the model answer them, and the group sums the answers per document. Buckets are as many
as the model's keys and the corpus' bytes ask for, so that neither a bucket's keys nor the questions
to it grow with the corpus. No table of the
corpus is broadcast or collected. Words of the base model are told apart by 64-bit hashes.

`adaptive_code_length` is the other mode: each text is coded by a trie that starts empty and learns
from the text itself.

Edge cases: a null text is the empty text (one end); repeated rows are scored alike; without
training rows all is uniform (1/256 a byte); an empty table gives an empty result; very long texts
are cut into overlapping slices for scoring, which doesn't change their score.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, read, small_batches, word_hashes

ORDER = 5
PAD = b"\xff" * ORDER
GROUP_BYTES, SLICE, MERGE_KEYS, BUCKET_KEYS, BUCKET_BYTES = 8 << 20, 1 << 18, 1 << 20, 200_000, 4 << 20
#: Buckets to a task: enough for sums of their sizes to be even.
TASK_BUCKETS, TASK_PARTS = 6, 2
#: The end of a text among the hashes of words.
END = 0
_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


# -- one text after another: adaptive mode, and the definition that tests compare with -------------


class Ppm:
    """A byte trie as a dictionary of contexts; learn and score texts one by one."""

    def __init__(self, order: int = ORDER) -> None:
        self.order = order
        self.seen: dict[bytes, Counter] = defaultdict(Counter)

    def _log2(self, context: bytes, symbol: int) -> float:
        bits, excluded = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            found = self.seen.get(context[len(context) - k :])
            if not found:
                continue
            n = sum(c for s, c in found.items() if s not in excluded)
            d = sum(s not in excluded for s in found)
            if symbol in found:
                return bits + math.log2((2 * found[symbol] - 1) / (2 * n))
            if n:
                bits += math.log2(d / (2 * n))
            excluded = found.keys()
        return bits - math.log2(256 - len(excluded))

    def _add(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            self.seen[context[len(context) - k :]][symbol] += 1

    def code(self, text: bytes | None, *, score: bool = True, learn: bool = False) -> float:
        """log10 probability of a text; learns from each byte after it was coded, if asked to."""
        p, total = b"\xff" * self.order + (text or b"").lower() + b"\xff", 0.0
        for i in range(self.order, len(p)):
            if score:
                total += self._log2(p[i - self.order : i], p[i])
            if learn:
                self._add(p[i - self.order : i], p[i])
        return total * math.log10(2)


def adaptive_code_length(docs: DataFrame, *, text: str = "text", order: int = ORDER) -> DataFrame:
    """docs with `code_bits`: the length of each text coded by a trie that learns from that text alone."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c != "code_bits"]
    schema = docs.select(*own).schema.add("code_bits", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.get_field_index(text)).to_pylist()
            bits = [-Ppm(order).code(t.encode() if t else b"", learn=True) / math.log10(2) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.float64())], names=[*own, "code_bits"])

    return docs.select(*own).mapInArrow(run, schema)


# -- grams of many texts at once -------------------------------------------------------------------


def gram_chunks(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, owners): each byte with the ORDER bytes before it as one integer, and its text's index."""
    held, size = [], 0
    for i, t in enumerate(texts):
        p = PAD + (t or b"").lower() + b"\xff"
        for s in range(0, len(p) - ORDER, SLICE):
            held.append((i, p[s : s + SLICE + ORDER]))
            size += len(held[-1][1])
            if size >= SLICE:
                yield _grams(held)
                held, size = [], 0
    if held:
        yield _grams(held)


def _grams(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"".join(s for _, s in held), np.uint8)
    two = (a[:-1].astype(np.uint64) << np.uint64(8)) | a[1:]
    g = (two[:-4] << np.uint64(32)) | (two[2:-2] << np.uint64(16)) | two[4:]
    sizes = np.array([len(s) for _, s in held])
    ends = np.cumsum(sizes)[:-1]
    ok = np.ones(len(g), bool)
    ok[(ends[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return g[ok].astype(np.int64), np.repeat(np.array([i for i, _ in held]), sizes - ORDER)


def _distinct(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = np.sort(g)
    if not len(g):
        return _NONE
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    return g[at], np.diff(np.append(at, len(g)))


def _merge(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    if not len(keys):
        return _NONE
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def _counted(table: tuple, learnt: list[np.ndarray], others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = _distinct(np.concatenate(others))[0]
    return _merge(_merge(table, _distinct(np.concatenate(learnt))), (keys, np.zeros(len(keys), np.int64)))


def count_grams(docs: DataFrame) -> DataFrame:
    """text (binary), held_out to (g, n): every gram of the corpus, counted in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, learnt, others, size = _NONE, [], [], 0
        for b in batches:
            held = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for g, owner in gram_chunks(b.column(0).to_pylist()):
                out = held[owner]
                learnt.append(g[~out])
                others.append(g[out])
                size += len(g)
                if size > 2 * MERGE_KEYS:
                    table, learnt, others, size = _counted(table, learnt, others), [], [], 0
                    if len(table[0]) > MERGE_KEYS:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["g", "n"])
                        table = _NONE
        if learnt:
            table = _counted(table, learnt, others)
        if len(table[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["g", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def word_keys(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words, and the number of words of each text (without the end)."""
    flat, n = word_hashes([t.lower() if t else t for t in texts])
    return flat.view(np.int64), n


def count_words(docs: DataFrame) -> DataFrame:
    """text (binary), held_out to (w, c): the words of training texts, by hash, and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = _NONE, [], 0
        for b in batches:
            flat, n = word_keys(b.column(0).to_pylist())
            held += [flat, np.full(len(n), END)]
            size += len(flat) + len(n)
            if size > MERGE_KEYS:
                table, held, size = _merge(table, _distinct(np.concatenate(held))), [], 0
                if len(table[0]) > MERGE_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["w", "c"])
                    table = _NONE
        if held:
            table = _merge(table, _distinct(np.concatenate(held)))
        if len(table[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in table], names=["w", "c"])

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


# -- the trie as tables ----------------------------------------------------------------------------


def _low(g: Column, k: int) -> Column:
    """The gram's last k context bytes and its symbol."""
    return g.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def log_probabilities(grams: DataFrame) -> DataFrame:
    """(g, n) to (g, lp): the natural logarithm of each gram's probability under the trained trie."""
    seen = {ORDER: grams.filter("n > 0")}
    for k in range(ORDER - 1, -1, -1):
        seen[k] = materialize(seen[k + 1].groupBy(_low(F.col("g"), k).alias("g")).agg(F.sum("n").alias("n")), f"order{k}")

    def contexts(k: int) -> DataFrame:
        """(c, total, distinct, lost): lost is the weight of the context's successors in the next shorter one."""
        t = seen[k].withColumn("c", F.shiftright("g", 8))
        if k:
            t = t.withColumn("p", _low(F.col("g"), k - 1)).join(seen[k - 1].select(F.col("g").alias("p"), F.col("n").alias("np")), "p")
        else:
            t = t.withColumn("np", F.lit(0).cast("long"))
        return t.groupBy("c").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("np").alias("lost"))

    top = seen[ORDER].withColumn("c", F.shiftright("g", 8))
    sums = top.groupBy("c").agg(F.sum("n").alias("total"))
    known = top.join(sums, "c").select("g", F.log((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("lp"))
    zero = F.lit(0).cast("long")
    rest = grams.filter("n = 0").select("g", F.lit(0.0).alias("lp"), zero.alias("ex_n"), zero.alias("ex_d"), F.lit(False).alias("done"))
    for k in range(ORDER, -1, -1):
        ctx = contexts(k)
        rest = rest.withColumn("c", F.shiftright(_low(F.col("g"), k), 8)).withColumn("gk", _low(F.col("g"), k))
        rest = rest.join(ctx, "c", "left")
        if k < ORDER:
            rest = rest.join(seen[k].select(F.col("g").alias("gk"), F.col("n").alias("hit")), "gk", "left")
        else:
            rest = rest.withColumn("hit", F.lit(None).cast("long"))
        den = 2 * (F.col("total") - F.col("ex_n"))
        here = ~F.col("done") & F.col("total").isNotNull()
        step = F.when(here & F.col("hit").isNotNull(), F.log((2 * F.col("hit") - 1) / den)).when(here & (den > 0), F.log((F.col("distinct") - F.col("ex_d")) / den)).otherwise(F.lit(0.0))
        rest = rest.select(
            "g",
            (F.col("lp") + step).alias("lp"),
            F.when(F.col("total").isNotNull(), F.col("lost")).otherwise(zero).alias("ex_n"),
            F.when(F.col("total").isNotNull(), F.col("distinct")).otherwise(zero).alias("ex_d"),
            (F.col("done") | (here & F.col("hit").isNotNull())).alias("done"),
        )
    last = F.when(F.col("done"), F.lit(0.0)).otherwise(-F.log(256 - F.col("ex_d")))
    return known.unionByName(rest.select("g", (F.col("lp") + last).alias("lp")))


# -- asking and answering ----------------------------------------------------------------------------


def _group_keys(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The distinct grams and words of a group, each sorted."""
    grams = [_distinct(g)[0] for g, _ in gram_chunks(texts)]
    flat, _ = word_keys(texts)
    return {"g": _distinct(np.concatenate(grams))[0], "w": _distinct(np.append(flat, END))[0]}


def _ask(docs: DataFrame, n_buckets: dict[str, int]) -> DataFrame:
    def run(t: pa.Table) -> pa.Table:
        rows = []
        for kind, keys in _group_keys(t.column("text").to_pylist()).items():
            of = keys % n_buckets[kind]
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            rows += [(kind, int(of[x[0]]), keys[x].tobytes()) for x in np.split(order, cuts)]
        part = t.column("part")[0].as_py()
        return pa.table({"kind": [r[0] for r in rows], "bucket": pa.array([r[1] for r in rows], pa.int64()), "part": pa.array([part] * len(rows), pa.int64()), "asked": pa.array([r[2] for r in rows], pa.binary())})

    return docs.groupBy("part").applyInArrow(run, "kind string, bucket long, part long, asked binary")


def _answer(asked: DataFrame, models: dict[str, DataFrame], n_buckets: dict[str, int]) -> DataFrame:
    """Rows of the model come first in each bucket; the bucket's table is held while its questions stream by.

    models: by kind, (key, value).
    """
    spark = asked.sparkSession
    none = lambda t: F.lit(None).cast(t)
    both = asked.select("kind", "bucket", "part", "asked", none("long").alias("key"), none("double").alias("value"))
    for kind, m in models.items():
        both = both.unionByName(m.select(F.lit(kind).alias("kind"), F.pmod("key", F.lit(n_buckets[kind])).alias("bucket"), none("long").alias("part"), none("binary").alias("asked"), "key", F.col("value").cast("double").alias("value")))
    n = max(sum(n_buckets.values()) // TASK_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = both.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("part").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for b in batches:
            kinds, buckets, parts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            i, out = 0, []
            while i < b.num_rows:
                if (kinds[i], buckets[i]) != at:
                    at, held, ready = (kinds[i], buckets[i]), [], None
                if parts[i] is None:
                    j = i
                    while j < b.num_rows and parts[j] is None and (kinds[j], buckets[j]) == at:
                        j += 1
                    held.append((b.column(4)[i:j].to_numpy(), b.column(5)[i:j].to_numpy()))
                    i = j
                    continue
                if ready is None:
                    keys, values = (np.concatenate([x[k] for x in held] or [np.empty(0)]) for k in (0, 1))
                    order = np.argsort(keys)
                    ready = np.append(keys[order].astype(np.int64), np.iinfo(np.int64).max), np.append(values[order], 0.0)
                want = np.frombuffer(b.column(3)[i].as_buffer(), np.int64)
                near = np.minimum(np.searchsorted(ready[0], want), len(ready[0]) - 1)
                out.append((*at, parts[i], np.where(ready[0][near] == want, ready[1][near], 0.0).tobytes()))
                i += 1
            if out:
                k, bk, p, a = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(bk, pa.int64()), pa.array(p, pa.int64()), pa.array(a, pa.binary())], names=["kind", "bucket", "part", "answer"])

    return both.mapInArrow(run, "kind string, bucket long, part long, answer binary")


class _Lookup:
    """Index of each query in sorted keys: one probe of a table of slots, binary search for the rest."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, bits = keys, max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, g: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(g)]
        miss = np.flatnonzero(self.keys[at] != g)
        at[miss] = np.searchsorted(self.keys, g[miss])
        return at


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", test: Column | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where test (default: the id's hash) is false and scores all.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(test if test is not None else held_out(doc_id), F.lit(False)).alias("held_out"))
    counted = materialize(count_grams(slim), "grams")
    vocab = materialize(count_words(slim), "words")
    n_tokens, n_types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    models = {"g": log_probabilities(counted).select(F.col("g").alias("key"), F.col("lp").alias("value")), "w": vocab.select(F.col("w").alias("key"), F.col("c").alias("value"))}
    size = slim.agg(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = {"g": _prime(1 + max(counted.count() // BUCKET_KEYS, size // BUCKET_BYTES)), "w": _prime(1 + max(n_types // BUCKET_KEYS, size // (4 * BUCKET_BYTES)))}
    parts = 1 + size // group_bytes
    tasks = max(parts // TASK_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = slim.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts))).repartition(tasks, "part")
    answers = _answer(_ask(dealt, n_buckets), models, n_buckets).repartition(tasks, "part")
    log_all = math.log10(n_tokens + n_types + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left.column("text").to_pylist()
        keys = _group_keys(texts)
        values = {k: np.zeros(len(v)) for k, v in keys.items()}
        of = {k: v % n_buckets[k] for k, v in keys.items()}
        for kind, bucket, answer in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "answer")), strict=True):
            values[kind][of[kind] == bucket] = np.frombuffer(answer)
        total, find = np.zeros(len(texts)), _Lookup(keys["g"])
        for part, owner in gram_chunks(texts):
            total += np.bincount(owner, values["g"][find(part)], len(texts))
        flat, n = word_keys(texts)
        owner = np.repeat(np.arange(len(n)), n)
        counts = values["w"][_Lookup(keys["w"])(flat)]
        end = values["w"][np.searchsorted(keys["w"], END)]
        base = np.bincount(owner, np.log10(counts + 1), len(n)) + math.log10(end + 1) - (n + 1) * log_all
        known = np.bincount(owner, counts > 0, len(n)).astype(np.int64) + int(end > 0)
        cols = {"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n + 1), "n_known": pa.array(known)}
        return pa.table(cols | {"train_tokens": pa.array(np.full(len(n), n_tokens)), "base_score": pa.array(base), "score": pa.array(total / math.log(10))})

    kind = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, kind)


def _prime(n: int) -> int:
    while n > 2 and any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
