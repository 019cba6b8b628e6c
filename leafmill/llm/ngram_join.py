"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of distinct five-word shingles; equal sets form one class. All shingles are put
in one global order, rare ones first, by a sketch of fixed size that counts documents per hash cell.
Two classes with similarity t or more share l shingles among the first n - ceil(t n) + l of each. A
class picks the l (1 to `MOST_MATCHES`) with the least estimated cost of candidates; a pair must
share as many as the smaller l of the two asks for.

- Prefix shingles give lists of classes; lists with the same members are merged, their number is
  the number of shared shingles. Lists of at most `SMALL` classes give pairs, which must share
  enough shingles; longer lists are compared in blocks, never as rows of pairs. Either way a pair
  stays only if an exact bound from parity bitmaps allows the similarity.
- Surviving pairs form clusters. Inside a cluster, in blocks of bounded size, pairs are verified on
  the whole sets, and the links kept are those needed to connect what links.
- Blocks of one list or cluster are first connected inside, then by one row of each component, and
  only rows outside the largest component are shown to all other blocks.
- Components of the links over classes, and membership of documents in classes, give the result.

Edge cases: null, empty and blank texts have no shingles and link with nothing; fewer than five
words are one shingle; repeated rows and equal texts share a class; a null id is no component's
least id unless there's no other; other columns pass through `join_components`; an empty table gives
an empty result. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import join_uneven, materialize, read, row_key, shingle_hashes, small_batches, split_words
from leafmill.llm.components import Forest, components

N, PERCENT = 5, 80
CELLS, SLICE = 1 << 20, 1 << 12
MOST_MATCHES, SMALL, BLOCK, LEAST_BITS, GROUP_BYTES = 4, 32, 4096, 512, 32 << 20


def shingle_sets(texts: list[bytes | None], n: int = N) -> list[np.ndarray]:
    return [shingle_hashes(h, n) for h in split_words([t.lower() if t else t for t in texts])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def least_overlap(n, percent: int):
    """ceil(t n): what a set of n shares at least with any partner."""
    return (percent * n + 99) // 100


def prefix(s: np.ndarray, heavy: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The shingles of s to look up, and how many of them a partner must share.

    heavy: for each cell, the estimated number of documents as a power of two, 0 for the common run
    of cells. Cost of l: documents met in the lists, and candidates met l times, taken to fall with
    the square of l.
    """
    n = len(s)
    level = heavy[(s >> np.uint64(44)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    keep = least_overlap(n, percent)
    met = np.cumsum(np.exp2(level[order].astype(float)))
    best, cost = 1, None
    for m in range(1, min(MOST_MATCHES, keep) + 1):
        scan = met[n - keep + m - 1]
        c = scan + 4 * scan / m**2 + 2 * m
        if cost is None or c < cost:
            best, cost = m, c
    return s[order[: n - keep + best]], best


def _classes_and_sketch(docs: DataFrame, n: int) -> DataFrame:
    """Rows of documents (rk_id, rk_hash, n_shingles, cls, bitmap), and at each task's end its sketch in slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        names = ["rk_id", "rk_hash", "n_shingles", "cls", "bitmap", "slice", "cells"]
        for b in batches:
            sizes, classes, maps, held = [], [], [], []
            for s in shingle_sets(b.column(2).to_pylist(), n):
                sizes.append(len(s))
                classes.append(_class(s) if len(s) else None)
                maps.append(parity(s) if len(s) else None)
                held.append(s >> np.uint64(44))
            if held:
                cells += np.bincount(np.concatenate(held).astype(np.int64), minlength=CELLS)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(maps, pa.list_(pa.int64())), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        k = CELLS // SLICE
        none = pa.nulls(k).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(k, pa.list_(pa.int64())), pa.array(range(k), pa.int32()), pa.array([cells[i * SLICE : (i + 1) * SLICE].astype(np.uint32).tobytes() for i in range(k)], pa.binary())], names=names)

    return docs.mapInArrow(run, "rk_id long, rk_hash long, n_shingles long, cls long, bitmap array<long>, slice int, cells binary")


def _heavy(rows: DataFrame) -> np.ndarray:
    """The summed sketch as levels: one byte for each of CELLS cells, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["slice", "cells"])

    got = rows.filter("slice IS NOT NULL").select("slice", "cells").repartition("slice").mapInArrow(add, "slice int, cells binary").collect()
    cells = np.zeros(CELLS, np.int64)
    for r in got:
        cells[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(bytes(r.cells), np.int64)
    over = cells / max(4.0, 2 * float(cells.mean()))
    return np.where(over > 1, np.ceil(np.log2(np.maximum(cells, 1))), 0).astype(np.uint8)


def _prefixes(docs: DataFrame, heavy, n: int, percent: int) -> DataFrame:
    """(token, cls, meta): prefix shingles of each class once a task; meta = 8 * set size + matches asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, levels = set(), heavy.value
        for b in batches:
            tokens, classes, metas = [], [], []
            if len(done) > 1_000_000:
                done.clear()
            for s in shingle_sets(b.column(2).to_pylist(), n):
                if not len(s) or (c := _class(s)) in done:
                    continue
                done.add(c)
                p, m = prefix(s, levels, percent)
                tokens.append(_signed(p))
                classes.append(np.full(len(p), c))
                metas.append(np.full(len(p), 8 * len(s) + m))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, metas)], names=["token", "cls", "meta"])

    return docs.mapInArrow(run, "token long, cls long, meta long")


def parity(s: np.ndarray) -> np.ndarray:
    """Bit b: parity of the hashes that are b modulo the number of bits, a power of two of at least 4 a hash.

    Halves combined by exclusive or are the bitmap of half the size, so bitmaps of unequal sizes compare.
    """
    bits = max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length())
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """(cls, cluster, blocks, text) to (cls, cluster, blocks, n, bitmap, hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(3).to_pylist(), n)
            cols = [pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols], names=["cls", "cluster", "blocks", "n", "bitmap", "hashes"])

    return docs.select("cls", "cluster", "blocks", "text").mapInArrow(run, "cls long, cluster long, blocks int, n long, bitmap array<long>, hashes binary")


class Bitmaps:
    """The bitmaps of a block by size, with an upper bound of the overlap of one row with others."""

    def __init__(self, t: pa.Table) -> None:
        maps = t.column("bitmap").combine_chunks()
        flat, ends = maps.flatten().to_numpy().view(np.uint64), np.concatenate(([0], np.cumsum(maps.value_lengths().to_numpy())))
        self.sizes = t.column("n").to_numpy()
        self.width = np.diff(ends)
        self.at = np.zeros(len(t), np.int64)
        self.held: dict[tuple[int, int], np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            mine = np.flatnonzero(self.width == w)
            self.at[mine] = np.arange(len(mine))
            self.held[w, w] = flat[ends[mine][:, None] + np.arange(w)]

    def _folded(self, w: int, to: int) -> np.ndarray:
        if (w, to) not in self.held:
            m = self._folded(w, 2 * to)
            self.held[w, to] = m[:, :to] ^ m[:, to:]
        return self.held[w, to]

    def maybe(self, i: int, js: np.ndarray, percent: int) -> np.ndarray:
        """Those of js that may link with i: differing bits are differing shingles, so they bound the overlap."""
        n, mine = self.sizes, int(self.width[i])
        js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
        out = []
        for w in np.unique(self.width[js]).tolist():
            of = js[self.width[js] == w]
            to = min(w, mine)
            differ = np.bitwise_count(self._folded(w, to)[self.at[of]] ^ self._folded(mine, to)[self.at[i]]).sum(1, dtype=np.int64)
            both = n[of] + n[i]
            overlap = np.minimum((both - differ) // 2, np.minimum(n[of], n[i]))
            out.append(of[100 * overlap >= percent * (both - overlap)])
        return np.concatenate(out) if out else js


def _edges(cls: np.ndarray, forest: Forest) -> pa.Table:
    root = forest.roots()
    at = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"u": cls[at], "v": cls[root[at]]})


def _likely(t: pa.Table, percent: int):
    """Of rows js those that may link with row i, one of each component is enough."""
    maps = Bitmaps(t)

    def linked(i: int, js: np.ndarray, forest: Forest) -> Iterator[int]:
        found = maps.maybe(i, js, percent)
        if len(found):
            _, first = np.unique(forest.roots()[found], return_index=True)
            yield from found[first].tolist()

    return linked


def _certain(t: pa.Table, percent: int):
    """Of rows js those that link with row i, by their whole sets; rows of components that are joined meanwhile are left out."""
    maps, sizes, raw = Bitmaps(t), t.column("n").to_numpy(), t.column("hashes")
    sets: dict[int, np.ndarray] = {}

    def of(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer(raw[i].as_buffer(), np.uint64)
        return sets[i]

    def linked(i: int, js: np.ndarray, forest: Forest) -> Iterator[int]:
        for j in maps.maybe(i, js, percent).tolist():
            if forest.root(i) != forest.root(j):
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    yield j

    return linked


def _compare(rows: DataFrame, keys: list[str], percent: int, links) -> DataFrame:
    """Edges of a forest of what links, for each group of rows (cls, side, root): pairs of one side are passed by
    where a group has two, and pairs of one root always."""

    def run(t: pa.Table) -> pa.Table:
        cls, side = t.column("cls").to_numpy(), t.column("side").to_numpy()
        root, forest, linked = t.column("root").to_numpy(), Forest(len(cls)), links(t, percent)
        two = len(side) > 0 and side.min() != side.max()
        for i in range(1, len(cls)):
            js = np.flatnonzero(root[:i] != root[i])
            if two:
                js = js[side[js] != side[i]]
            js = js[forest.roots()[js] != forest.root(i)]
            for j in linked(i, js, forest) if len(js) else ():
                forest.join(i, j)
        return _edges(cls, forest)

    return rows.groupBy(*keys).applyInArrow(run, "u long, v long")


def _links(rows: DataFrame, key: str, percent: int, links, several: bool) -> DataFrame:
    """Edges that connect what links among the rows (key, cls, blocks and what links reads) of each key.

    A key's rows are dealt to blocks and compared inside them. What is connected then stands for itself by
    one row: these are compared between all blocks. At last the rows outside a key's largest component are
    compared with those of all other blocks, so that no link is lost. A list of near copies is so met
    about once, however long it is; rows that link with nothing in a long list still meet all others, in pairs of blocks.
    several: does any key have more than one block?
    """
    rows = materialize(rows, "dealt") if several else rows
    own = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own)
    alone = rows.withColumns({"side": F.lit(0), "root": F.col("cls")})
    found = _compare(alone, [key, "own"], percent, links)
    if not several:
        return found
    found = materialize(found, "links")
    many = rows.filter("blocks > 1")

    def rooted() -> DataFrame:
        roots = components(found).withColumnRenamed("u", "cls")
        return materialize(many.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "rooted")

    rows = rooted()
    heads = rows.dropDuplicates([key, "root"])
    n = rows.groupBy(key).agg(F.count("*").alias("m"), F.count_distinct("root").alias("m_heads"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("blocks") * F.col("m_heads") / F.col("m")).cast("int"))
    dealt = heads.join(n, key).withColumn("parts", parts).withColumn("side", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"b1": F.least("side", "other"), "b2": F.greatest("side", "other")})
    found = materialize(found.unionByName(_compare(dealt.drop("m", "m_heads", "parts", "other"), [key, "b1", "b2"], percent, links)), "links")
    rows = rooted()
    sizes = rows.groupBy(key, "root").agg(F.count("*").alias("m"))
    rows = rows.join(sizes.groupBy(key).agg(F.max_by("root", F.struct("m", "root")).alias("top")), key)
    at = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    guests = rows.filter(F.col("root") != F.col("top")).withColumn("at", at).filter("at <> own").withColumn("side", F.lit(1))
    met = materialize(guests.select(key, "at", "own").distinct(), "met")
    if not met.isEmpty():
        hosts = rows.withColumnRenamed("own", "at").withColumn("side", F.lit(0)).join(met, [key, "at"])
        found = found.unionByName(_compare(hosts.drop("top").unionByName(guests.drop("top")), [key, "at", "own"], percent, links))
    return found


def components_by_row(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, small: int = SMALL, block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(rk_id, rk_hash, n_shingles, component_id, root: a class of the component), one row for each row key of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100: bitmaps are halved once at most")
    keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("binary").alias("text"))
    rows = materialize(_classes_and_sketch(keyed, n), "classes")
    heavy = spark.sparkContext.broadcast(_heavy(rows))
    members = rows.filter("slice IS NULL").select("rk_id", "rk_hash", "n_shingles", "cls")

    # lists of classes that share a prefix shingle; one for each set of members
    tokens = _prefixes(keyed, heavy, n, percent).filter("token IS NOT NULL").repartition("token").dropDuplicates(["token", "cls"])
    lists = tokens.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2"), F.min("meta").alias("meta"))
    lists = lists.filter("m > 1 AND meta > 0")  # as meta is used and tokens aren't null, both uses of `tokens` read the same shuffle
    chosen = lists.groupBy("m", "x1", "x2").agg(F.min("token").alias("token"), F.count("*").alias("shared")).select("token", "m", "shared")
    lists = materialize(tokens.join(chosen, "token"), "lists")

    # bitmaps of the classes in lists, from one row each
    one = members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("rk_id", "rk_hash")).alias("k")).select("cls", "k.*")
    listed = one.join(lists.select("cls").distinct(), "cls", "left_semi")
    maps = rows.select("rk_id", "rk_hash", "cls", F.col("n_shingles").alias("n"), "bitmap").join(listed, ["cls", "rk_id", "rk_hash"], "left_semi")
    maps = materialize(maps.select("cls", "n", "bitmap"), "bitmaps")

    # candidates that may link
    few = lists.filter(F.col("m") <= small).select("token", "cls", "shared", F.floor(F.col("meta") / 8).alias("n"), F.pmod("meta", F.lit(8)).alias("l"))
    other = few.select("token", F.col("cls").alias("v"), F.col("n").alias("vn"), F.col("l").alias("vl"))
    pairs = few.withColumnRenamed("cls", "u").join(other, "token").filter((F.col("u") < F.col("v")) & (100 * F.least("n", "vn") >= percent * F.greatest("n", "vn")))
    pairs = pairs.groupBy("u", "v").agg(F.sum("shared").alias("shared"), F.min(F.least("l", "vl")).alias("asked")).filter("shared >= asked").select("u", "v")
    pairs = pairs.join(maps.select(F.col("cls").alias("u"), F.col("n"), F.col("bitmap")), "u").join(maps.select(F.col("cls").alias("v"), F.col("n").alias("vn"), F.col("bitmap").alias("vbitmap")), "v")
    half = lambda c, other: F.when(F.size(c) > F.size(other), F.zip_with(F.slice(c, 1, F.size(other)), F.slice(c, F.size(other) + 1, F.size(other)), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(half("bitmap", "vbitmap"), half("vbitmap", "bitmap"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    overlap = F.least(F.floor((F.col("n") + F.col("vn") - differ) / 2), F.col("n"), F.col("vn"))
    pairs = pairs.withColumn("o", overlap).filter(100 * F.col("o") >= percent * (F.col("n") + F.col("vn") - F.col("o"))).select("u", "v")
    many = lists.filter(F.col("m") > small).select("token", "cls", F.ceil(F.col("m") / block).cast("int").alias("blocks")).join(maps, "cls")
    clusters = components(pairs.unionByName(_links(many, "token", percent, _likely, not lists.filter(F.col("m") > block).isEmpty())))

    # links inside the clusters
    inside = clusters.select(F.col("u").alias("cls"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("cls"), F.col("root").alias("cluster")).distinct())
    sized = inside.join(maps.select("cls", "n"), "cls")
    blocks = materialize(sized.groupBy("cluster").agg(F.ceil(F.sum(9 * F.col("n") + LEAST_BITS // 8) / group_bytes).cast("int").alias("blocks")), "blocks")
    wanted = inside.join(blocks, "cluster").join(one, "cls")
    picked = keyed.join(wanted, ["rk_id", "rk_hash"]).dropDuplicates(["rk_id", "rk_hash"])
    links = components(_links(_sets(picked, n), "cluster", percent, _certain, not blocks.filter("blocks > 1").isEmpty()))

    # back to documents
    ids = members.join(links.withColumnRenamed("u", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = ids.withColumn("id", F.nullif("rk_id", F.lit(-(2**63))))
    ids = materialize(ids, "ids")
    least = materialize(ids.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), "least")
    named = join_uneven(ids.filter("root IS NOT NULL"), least, ["root"]).drop("n")
    by_row = named.unionByName(ids.filter("root IS NULL").withColumn("component_id", F.lit(None).cast("long"))).groupBy("rk_id", "rk_hash").agg(F.first("n_shingles").alias("n_shingles"), F.first(F.coalesce("component_id", "id")).alias("component_id"), F.first("root").alias("root"))
    return materialize(by_row, "joined")


def _joined(docs: DataFrame, by_row: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, list[str]]:
    """docs with the columns of by_row; the own columns are called c0, c1 and so on meanwhile."""
    own = [c for c in docs.columns if c not in ("n_shingles", "component_id")]
    return docs.select(*row_key(doc_id, text), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)]).join(by_row, ["rk_id", "rk_hash"], "left"), own


def join_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with n_shingles and component_id (the least id of the documents that links reach)."""
    full, own = _joined(docs, components_by_row(docs, doc_id=doc_id, text=text, **options), doc_id, text)
    return full.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "n_shingles", "component_id")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with one row of each component: the one with the least id, then the least text hash.

    Documents without shingles are all kept.
    """
    by_row = components_by_row(docs, doc_id=doc_id, text=text, **options)
    first = by_row.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct("rk_id", "rk_hash")).alias("k")).select("k.*", F.lit(True).alias("first"))
    marked = by_row.join(first, ["rk_id", "rk_hash"], "left").select("rk_id", "rk_hash", F.when(F.col("n_shingles") == 0, F.lit(0)).when(F.col("first"), F.lit(1)).alias("most"))
    full, own = _joined(docs, marked.filter("most IS NOT NULL"), doc_id, text)
    nth = F.row_number().over(W.partitionBy("rk_id", "rk_hash").orderBy("rk_id"))
    return full.withColumn("nth", nth).filter((F.col("most") == 0) | (F.col("nth") <= F.col("most"))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT rid, count(*)::BIGINT AS n FROM s GROUP BY rid),
o AS (SELECT a.rid AS u, b.rid AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
l AS (SELECT u, v FROM o JOIN n p ON p.rid = u JOIN n q ON q.rid = v WHERE 100 * c >= 80 * (p.n + q.n - c)),
b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (WITH RECURSIVE t(rid, node) AS (SELECT rid, rid FROM d UNION SELECT t.rid, b.v FROM t JOIN b ON b.u = t.node) SELECT rid, node FROM t)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (rid)
JOIN (SELECT r.rid, min(x.doc_id) AS component_id FROM r JOIN d x ON x.rid = r.node GROUP BY r.rid) m USING (rid)
"""
