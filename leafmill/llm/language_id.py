"""Language ID by a linear-chain conditional random field over words.

Emissions are sums of weights of hashed affixes and character n-grams, and of a lexicon feature (the
languages that a word was seen in); transitions between the labels of neighbouring words are learned
with them. Training maximises the likelihood on a bounded sample (`per_lang` documents of each
language, whole texts, chosen by hash); each word carries its document's label. Half of the training
chains are spliced of two pieces, so that transitions see switches. Prediction runs
forward-backward over the whole chain of a text's words: the marginals label every word, so code-switched texts get both
labels, and a document gets the language with the largest mean marginal. Long chains are cut into
segments that are run side by side; messages between segments come from products of their transfer
matrices, so the marginals are those of the whole chain.

Edge cases: a null text, or one without a letter, is `und` with score 0; memory is linear in a batch's words; without labelled rows all is `und`; repeated
rows are predicted alike; other columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.llm.common import BASE_1, mix, powers, read, small_batches

DIM, SEGMENT, PER_LANG, EPOCHS, RATE, L2 = 1 << 16, 256, 250, 3, 0.2, 1e-6
#: Bounds of the training sample: characters of a text, and languages.
MAX_TEXT, MAX_LANGS = 200_000, 256
_CACHE = 300_000


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def has_letter(word: str) -> bool:
    return word.isalpha() or any(c.isalpha() for c in word)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, one after another, and their number for each word.

    Of `^word$`: prefixes and suffixes of 2 to 5 characters and all trigrams. A word without a letter
    has none. All words are hashed at once.
    """
    told = np.fromiter(map(has_letter, words), bool, len(words))
    sizes = np.zeros(len(words), np.int64)
    mine = [f"^{w}$" for w, x in zip(words, told.tolist(), strict=True) if x]
    if not mine:
        return np.empty(0, np.int64), sizes
    c = np.frombuffer("".join(mine).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, mine), np.int64, len(mine))
    first = np.cumsum(n) - n
    up, down = powers(BASE_1, len(c))
    s = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(mix(c + np.uint64(1)) * up[: len(c)], out=s[1:])
    gram = lambda lo, hi, kind: (mix((s[hi] - s[lo]) * down[lo] + np.uint64(kind)) % np.uint64(DIM)).astype(np.int64)
    each = n - 2 + 8  # trigrams, prefixes and suffixes
    start = np.cumsum(each) - each
    out = np.empty(int(each.sum()), np.int64)
    lo = np.repeat(first, n - 2) + _ramp(n - 2)
    out[np.repeat(start, n - 2) + _ramp(n - 2)] = gram(lo, lo + 3, 0)
    for k in range(2, 6):
        out[start + n - 4 + k] = gram(first, first + np.minimum(k, n), k)
        out[start + n + k] = gram(first + np.maximum(n - k, 0), first + n, 8 + k)
    sizes[told] = each
    return out, sizes


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Crf:
    """Weights (DIM, L), lexicon {word: row of L}, transitions (L, L) and start (L)."""

    def __init__(self, labels: list[str]) -> None:
        n = len(labels)
        self.labels, self.weights = labels, np.zeros((DIM, n))
        self.trans, self.start, self.lexicon = np.zeros((n, n)), np.zeros(n), {}
        self.lex_weight = np.zeros(n)
        self._index: dict[str, int] = {}
        self._rows, self._told = np.zeros((0, n)), np.zeros(0, bool)

    # -- emissions ----------------------------------------------------------------------------

    def _emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows for distinct words, and which have a letter."""
        flat, sizes = features(words)
        out = np.zeros((len(words), len(self.labels)))
        told = sizes > 0
        if told.any():
            n = sizes[told]
            out[told] = np.add.reduceat(self.weights[flat], np.cumsum(n) - n)
        get = self.lexicon.get
        for i, lex in enumerate(map(get, words)):
            if lex is not None:
                out[i] += lex * self.lex_weight
        return out, told

    def emissions(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row for each word, and which have a letter; rows of seen words are kept, up to a fixed number."""
        if len(self._index) > _CACHE:
            self._index, self._rows, self._told = {}, self._rows[:0], self._told[:0]
        new = list(set(words).difference(self._index))
        if new:
            rows, told = self._emissions(new)
            self._index.update(zip(new, range(len(self._rows), len(self._rows) + len(new)), strict=True))
            self._rows, self._told = np.concatenate((self._rows, rows)), np.concatenate((self._told, told))
        at = np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))
        return self._rows[at], self._told[at]

    # -- forward-backward -----------------------------------------------------------------------

    def marginals(self, emit: np.ndarray, mask: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """emit (B, T, L), mask (B, T): label marginals (B, T, L), and summed pair marginals if asked for.

        before (B, L): weights of the first labels by what comes before the segment (default: the start);
        after (B, L): of the last ones by what comes after it (default: all alike).
        """
        b, t, n = emit.shape
        e = np.exp(emit - emit.max(2, keepdims=True))
        move = np.exp(self.trans)
        fwd, bwd = np.empty((t, b, n)), np.ones((t, b, n))
        end = np.ones((b, n)) if after is None else after
        a = e[:, 0] * (np.exp(self.start) if before is None else before)
        fwd[0] = a / a.sum(1, keepdims=True)
        for k in range(1, t):
            a = (fwd[k - 1] @ move) * e[:, k]
            fwd[k] = a / a.sum(1, keepdims=True)
        back = move.T
        bwd[t - 1] = end
        for k in range(t - 2, -1, -1):
            a = (bwd[k + 1] * e[:, k + 1]) @ back
            a /= a.sum(1, keepdims=True)
            bwd[k] = np.where(mask[:, k + 1, None], a, end)
        post = fwd * bwd
        post /= post.sum(2, keepdims=True)
        post = post.transpose(1, 0, 2)
        if not pairs:
            return post
        total = np.zeros((n, n))
        for k in range(1, t):
            p = fwd[k - 1][:, :, None] * move * (e[:, k] * bwd[k])[:, None, :]
            p /= p.sum((1, 2), keepdims=True)
            total += (p * mask[:, k, None, None]).sum(0)
        return post, total

    def transfer(self, emit: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """(B, L, L): for each label of a segment's first word, the weights of those of its last word, up to a factor."""
        e = np.exp(emit - emit.max(2, keepdims=True))
        out, move = e[:, 0, :, None] * np.eye(len(self.labels)), np.exp(self.trans)
        for k in range(1, emit.shape[1]):
            a = (out @ move) * e[:, k, None, :]
            out = np.where(mask[:, k, None, None], a / a.sum((1, 2), keepdims=True), out)
        return out

    def messages(self, matrices: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """before and after of segments in a row, by their transfer matrices; first: which begin a chain."""
        move, n = np.exp(self.trans), len(self.labels)
        before, after = np.tile(np.exp(self.start), (len(first), 1)), np.ones((len(first), n))
        for i in range(1, len(first)):
            if not first[i]:
                a = before[i - 1] @ matrices[i - 1] @ move
                before[i] = a / a.sum()
        for i in range(len(first) - 2, -1, -1):
            if not first[i + 1]:
                a = move @ (matrices[i + 1] @ after[i + 1])
                after[i] = a / a.sum()
        return before, after

    # -- training --------------------------------------------------------------------------------

    def fit(self, docs: list[tuple[str, int]], segment: int = 64, batch: int = 256) -> "Crf":
        n, rng = len(self.labels), np.random.default_rng(7)
        types: dict[str, int] = {}
        segs, seen = [], Counter()
        for text, label in docs:
            ids = [types.setdefault(w, len(types)) for w in tokens(text)]
            seen.update((i, label) for i in set(ids))
            segs += [(ids[i : i + segment], [label] * len(ids[i : i + segment])) for i in range(0, len(ids), segment)]
        for i in rng.permutation(len(segs))[: len(segs) // 2].tolist() if n > 1 else ():
            # the first words of one chain, then those of another
            (ids, labels), (ids_2, labels_2) = segs[i], segs[int(rng.integers(len(segs)))]
            k = int(rng.integers(len(ids) + 1))
            segs[i] = (ids[:k] + ids_2[: segment - k], labels[:k] + labels_2[: segment - k])
        lex = np.zeros((len(types), n))
        for (i, label), c in seen.items():
            lex[i, label] = c
        many = lex.sum(1) >= 2
        lex = np.where(many[:, None], (lex + 0.1) / (lex.sum(1, keepdims=True) + 0.1 * n) - 1 / n, 0.0)
        self.lexicon = {w: lex[i] for w, i in types.items() if many[i]}
        flat, sizes = features(list(types))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        sq = [np.full(x.shape, 1e-8) for x in (self.weights, self.trans, self.start, self.lex_weight)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(segs))
            for at in range(0, len(order), batch):
                part = [segs[i] for i in order[at : at + batch]]
                t = max(len(s) for s, _ in part)
                ids, mask, label = np.zeros((len(part), t), np.int64), np.zeros((len(part), t), bool), np.zeros((len(part), t), np.int64)
                for r, (s, of) in enumerate(part):
                    ids[r, : len(s)], mask[r, : len(s)], label[r, : len(s)] = s, True, of
                used, inv = np.unique(ids[mask], return_inverse=True)
                spans = [flat[ends[u] : ends[u + 1]] for u in used]
                size = np.array([len(s) for s in spans])
                idx, owner = np.concatenate(spans), np.repeat(np.arange(len(used)), size)
                rows = np.zeros((len(used), n))
                for k in range(n):
                    rows[:, k] = np.bincount(owner, self.weights[idx, k], len(used))
                rows += lex[used] * self.lex_weight
                emit = np.zeros((*ids.shape, n))
                emit[mask] = rows[inv]
                post, pair = self.marginals(emit, mask, pairs=True)
                gold = np.eye(n)[label]
                diff = (gold - post) * mask[:, :, None] / len(part)
                g_rows = np.zeros((len(used), n))
                for k in range(n):
                    g_rows[:, k] = np.bincount(inv, diff[mask][:, k], len(used))
                gw = np.zeros_like(self.weights)
                for k in range(n):
                    gw[:, k] = np.bincount(idx, g_rows[owner, k], DIM)
                gp = np.zeros((n, n))
                np.add.at(gp, (label[:, :-1][mask[:, 1:]], label[:, 1:][mask[:, 1:]]), 1)
                grads = gw - L2 * self.weights, (gp - pair) / len(part) - 0.01 * self.trans, diff[:, 0].sum(0), (g_rows * lex[used]).sum(0)
                for x, g, s in zip((self.weights, self.trans, self.start, self.lex_weight), grads, sq, strict=True):
                    s += g * g
                    x += RATE * g / np.sqrt(s)
        self.weights = self.weights.astype(np.float32)
        return self

    # -- prediction ------------------------------------------------------------------------------

    def _label(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text, its words, their marginals (n_words, L) and which have a letter."""
        words = [tokens(t) for t in texts]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        emit, told = self.emissions([w for ws in words for w in ws])
        post = np.zeros_like(emit)
        parts = -(-sizes // SEGMENT)
        start = np.repeat(np.cumsum(sizes) - sizes, parts) + SEGMENT * _ramp(parts)
        size = np.minimum(SEGMENT, np.repeat(np.cumsum(sizes), parts) - start)
        n = len(self.labels)

        def blocks(which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            order = which[np.argsort(size[which], kind="stable")]
            for at in range(0, len(order), 512):
                part = order[at : at + 512]
                mask = np.arange(size[part[-1]]) < size[part][:, None]
                rows = np.repeat(start[part], size[part]) + _ramp(size[part])
                block = np.zeros((*mask.shape, n))
                block[mask] = emit[rows]
                yield part, mask, rows, block

        before, after = np.tile(np.exp(self.start), (len(size), 1)), np.ones((len(size), n))
        long = np.flatnonzero(np.repeat(parts > 1, parts))
        if len(long):
            matrices = np.empty((len(size), n, n))
            for part, mask, _, block in blocks(long):
                matrices[part] = self.transfer(block, mask)
            before[long], after[long] = self.messages(matrices[long], _ramp(parts)[long] == 0)
        for part, mask, rows, block in blocks(np.arange(len(size))):
            post[rows] = self.marginals(block, mask, before=before[part], after=after[part])[mask]
        cuts = np.cumsum(sizes)[:-1]
        return list(zip(words, np.split(post, cuts), np.split(told, cuts), strict=True)) if len(texts) else []

    def label_words(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """For each text, its words and their marginals (n_words, L)."""
        return [(w, p) for w, p, _ in self._label(texts)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for _, post, told in self._label(texts):
            if not told.any():
                langs.append("und")
                scores.append(0.0)
                continue
            mean = post[told].mean(0)
            k = int(mean.argmax())
            langs.append(self.labels[k])
            scores.append(float(min(1.0, mean[k])))
        return langs, scores


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG, max_bytes: int = 8 << 20, max_text: int = MAX_TEXT, max_langs: int = MAX_LANGS) -> Crf:
    """Learn from rows that aren't held out, on a bounded sample: about per_lang rows a language and max_bytes in all of each, of the max_langs
    most frequent languages; of a text, training reads max_text characters. Rows are taken by a hash of id and text, equal ones once."""
    rows = docs.filter(~held_out(doc_id)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(lang).alias("l"), F.substring(text, 1, max_text).alias("t"), F.xxhash64(F.col(doc_id), F.col(text), F.lit("crf")).alias("u"))
    sizes = rows.groupBy("l").agg(F.approx_count_distinct("u").alias("n"), F.avg(F.octet_length("t")).alias("b"), F.count("*").alias("all"))
    counts = {r.l: (max(r.n, 1), r.b) for r in sizes.orderBy(F.col("all").desc(), "l").limit(max_langs).collect()}
    labels = sorted(counts)
    crf = Crf(labels)
    if not labels:
        return crf
    keep = F.lit(False)
    for name, (n, size) in counts.items():
        share = min(1.0, per_lang / n, max_bytes / max(size * n, 1))
        keep = keep | ((F.col("l") == name) & (F.pmod(F.col("u"), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
    some = rows.filter(keep).dropDuplicates(["l", "u"])
    got = some.orderBy("u", "l").limit(2 * per_lang * len(labels)).collect()
    return crf.fit([(r.t, labels.index(r.l)) for r in got])


def predict(docs: DataFrame, crf: Crf, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score. The model's size is fixed by DIM and the sample."""
    spark = docs.sparkSession
    small_batches(spark)
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    held = spark.sparkContext.broadcast(crf)
    schema = T.StructType([docs.schema[c] for c in own]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs, scores = model.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
            cols = [batch.column(batch.schema.get_field_index(c)) for c in own]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*own, "lang_pred", "score"])

    return docs.select(*own).mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
