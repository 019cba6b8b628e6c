"""Shared pieces of the training-data operators: reading, scratch tables, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word definition `[^\x20\x09-\x0D]+`.
WS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SCRATCH: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def small_batches(spark: SparkSession, rows: int = 512, size: int = 8 << 20) -> None:
    """Bound the Arrow batches of the session by rows and bytes, so that a batch of very long texts fits a Python worker.

    The settings stay: plans read them when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leafmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder, for one table; drop_scratch deletes it."""
    path = f"{scratch_dir(spark)}/leafmill/{name}-{uuid.uuid4().hex}"
    if not _SCRATCH:
        atexit.register(drop_scratch)
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def scratch_mark() -> int:
    """How many scratch tables there are: what is written later can be dropped by itself."""
    return len(_SCRATCH)


def drop_scratch(since: int = 0, but: DataFrame | None = None) -> None:
    """Delete the scratch tables written since a mark, but for the one of `but`; results that read them must have been used."""
    kept = [x for x in _SCRATCH[since:] if but is not None and x[1] == getattr(but, "scratch_path", None)]
    gone, _SCRATCH[since:] = [x for x in _SCRATCH[since:] if x not in kept], kept
    while gone:
        spark, path = gone.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


HOT_SHARE = 10_000


def join_uneven(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n") -> DataFrame:
    """Inner join of rows with keys (a written table), one row for each value of `on`, where keys[n] is how many rows have it.

    A key of more than a HOT_SHARE-th of all rows is dealt to so many parts that none has more. There are at
    most HOT_SHARE such keys; they alone are broadcast, to tell the rows which part they go to.
    """
    most = max(1000, (keys.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE)
    hot = keys.filter(F.col(n) > most).select(*on, F.ceil(F.col(n) / most).cast("int").alias("_parts"))
    if hot.isEmpty():
        return rows.join(keys, on)
    part = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_parts")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_part", part).drop("_parts")
    last = F.when(F.col(n) > most, F.ceil(F.col(n) / most) - 1).otherwise(F.lit(0)).cast("int")
    return dealt.join(keys.withColumn("_part", F.explode(F.sequence(F.lit(0), last))), [*on, "_part"]).drop("_part")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two columns that tell rows apart: rows with equal id and text count as the same document."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("rk_id"), F.xxhash64(text).alias("rk_hash")]


class WordHash(dict):
    """Word (bytes) to 64-bit hash, for small vocabularies that are held anyway."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the murmur3 finaliser), elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n modulo 2**64 and their inverses; base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        m = max(n + 1, 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (both[0], both[1])
    return have


def range_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int) -> np.ndarray:
    """Hash of each h[lo:hi], independent of its place: a polynomial modulo 2**64, finalised."""
    up, down = powers(base, len(h) + 1)
    s = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=s[1:])
    return mix((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64))


BASE_1, BASE_2, BASE_3 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_GROUP, _LONG = 1 << 18, 1 << 22


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts, one after another, and the number of words of each.

    A word's hash is a polynomial over its bytes, finalised; all words of about _GROUP bytes are
    hashed at once, without a Python object for each.
    """
    flat, counts, group, size = [], [], [], 0
    for t in texts:
        t = t or b""
        if len(t) > _LONG:
            flat.append(_hash_group(group, counts))
            words = t.split()
            parts = [_hash_group([b" ".join(words[i : i + 20_000])], []) for i in range(0, len(words), 20_000)]
            flat += parts
            counts.append(len(words))
            group, size = [], 0
            continue
        group.append(t)
        size += len(t)
        if size > _GROUP:
            flat.append(_hash_group(group, counts))
            group, size = [], 0
    flat.append(_hash_group(group, counts))
    return np.concatenate(flat), np.array(counts, np.int64)


def _hash_group(group: list[bytes], counts: list[int]) -> np.ndarray:
    a = np.frombuffer(b" " + b" ".join(group) + b" ", np.uint8)
    space = _SPACE[a]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(BASE_3, len(a))
    s = np.cumsum(_CODE[a] * up[: len(a)])
    edges = np.cumsum([1] + [len(t) + 1 for t in group])
    counts.extend(np.diff(np.searchsorted(starts, edges)).tolist())
    return mix((s[ends - 1] - s[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))


def split_words(texts: list[bytes | None]) -> list[np.ndarray]:
    """word_hashes as one array for each text."""
    flat, counts = word_hashes(texts)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word runs of one document, sorted; fewer words: the whole run as one."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = max(1, len(h) - n + 1)
    lo = np.arange(k)
    return np.unique(range_hash(h, lo, np.minimum(lo + n, len(h)), BASE_1))
