"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines ends a chunk where it is 0 modulo `mean_lines`, unless
the chunk has fewer than `min_lines` lines yet. So the same run of lines is cut alike wherever it stands,
but for the chunks at its ends. Only the last chunk of a text can be shorter; it is compared together
with the one before it, and goes if both together occur earlier. Chunks of at least `min_lines` lines whose
bytes occur more than once in the corpus are removed, all but the first by (doc_id, position).

Texts are cut once, to chunks with their places in bytes and 64-bit hashes. Only chunks whose hash repeats
are compared byte for byte: those are aggregated by their bytes to the first place of each, and a document
keeps the chunks that are first. So a chunk that stands everywhere is met by partial sums, never as rows of one task.

Edge cases: null and empty texts have no chunks and stay as they are; chunks without any word are
never removed; a text that is a single line is never a multi-line chunk; of rows with equal id and
text both keep a chunk that is the first of its kind (they are the same document); an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import join_uneven, materialize, mix, read, row_key, small_batches

MEAN_LINES, MIN_LINES, ROLL = 4, 2, 2
_ROLL_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEY = ["rk_id", "rk_hash"]


def boundaries(text: bytes, mean_lines: int = MEAN_LINES, roll: int = ROLL, min_lines: int = MIN_LINES) -> tuple[list[int], list[int]]:
    """First line of each chunk of a text, with the number of lines at the end; and the places of lines in bytes.

    A boundary depends on the `roll` lines before it and on the chunk's length.
    """
    lines = text.split(b"\n")
    n = len(lines)
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x) + 1)
    if n <= min_lines:
        return [0, n], at
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, n)
    rolled = np.zeros(n, np.uint64)
    for k in range(roll - 1, -1, -1):
        rolled *= _ROLL_BASE
        rolled[k:] += h[: n - k]
    cuts = np.flatnonzero((mix(rolled) >> np.uint64(32)) % np.uint64(mean_lines) == 0) + 1
    first = [0]
    for c in cuts.tolist():
        if c < n and c - first[-1] >= min_lines:
            first.append(c)
    return [*first, n], at


def line_chunks(text: str, mean_lines: int = MEAN_LINES, roll: int = ROLL, min_lines: int = MIN_LINES) -> list[list[str]]:
    """The lines of text, in chunks of at least min_lines but for the last."""
    lines = text.split("\n")
    first, _ = boundaries(text.encode(), mean_lines, roll, min_lines)
    return [lines[x:y] for x, y in zip(first, first[1:], strict=False)]


def compared(first: list[int], at: list[int], min_lines: int) -> list[tuple[int, int, int]]:
    """(chunk, start, end in bytes) of what is compared; a short last chunk is compared with the one before it."""
    out = []
    for i in range(len(first) - 1):
        x = first[i - 1] if i and first[i + 1] - first[i] < min_lines else first[i]
        if first[i + 1] - x >= min_lines:
            out.append((i, at[x], at[first[i + 1]] - 1))
    return out


def _chunks(keyed: DataFrame, min_lines: int) -> DataFrame:
    """rk_id, rk_hash, text to (rk_id, rk_hash, pos, start, size, h): the chunks that hold a word; positions in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, pos, start, size, h = [], [], [], [], []
            for d, t in enumerate(b.column(2).to_pylist()):
                for i, x, y in compared(*boundaries(t), min_lines) if t else ():
                    body = t[x:y]
                    if body.strip():
                        owner.append(d)
                        pos.append(i)
                        start.append(x)
                        size.append(y - x)
                        h.append(xxhash.xxh3_64_intdigest(body))
            o = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(o), b.column(1).take(o), pa.array(pos, pa.int32()), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(np.array(h, np.uint64).view(np.int64))], names=[*_KEY, "pos", "start", "size", "h"])

    return keyed.mapInArrow(run, "rk_id long, rk_hash long, pos int, start int, size int, h long")


def repeated_chunks(keyed: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """keyed: rk_id, rk_hash, text (binary). (rk_id, rk_hash, drop: positions of chunks that equal, byte for byte, an earlier one of the corpus)."""
    chunks = materialize(_chunks(keyed, min_lines).dropDuplicates([*_KEY, "pos"]), "chunks")
    often = materialize(chunks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "often")
    wanted = join_uneven(chunks, often, ["h"]).groupBy(*_KEY).agg(F.collect_list(F.struct("pos", "start", "size")).alias("wanted"))
    wanted = materialize(wanted, "wanted")
    # texts are sorted to what is asked of them at any size: no table that grows is broadcast
    texts = keyed.join(wanted.hint("merge"), _KEY).dropDuplicates(_KEY)
    bodies = texts.select(*_KEY, "text", F.explode("wanted").alias("w")).select(*_KEY, F.col("w.pos").alias("pos"), F.expr("substring(text, w.start + 1, w.size)").alias("body"))
    first = bodies.groupBy("body").agg(F.min(F.struct(*_KEY, "pos")).alias("p")).select("p.*")
    kept = first.groupBy(*_KEY).agg(F.collect_list("pos").alias("kept"))
    drop = F.array_except(F.transform("wanted", lambda w: w["pos"]), F.coalesce("kept", F.array().cast("array<int>")))
    return wanted.join(kept, _KEY, "left").select(*_KEY, drop.alias("drop")).filter(F.size("drop") > 0)


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """docs with the later copies of repeated chunks cut from the text; adds n_lines and n_removed (lines)."""
    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(*row_key(doc_id, text), F.col(text).cast("binary").alias("text"))
    drop = repeated_chunks(keyed, min_lines)
    mine = docs.select(*row_key(doc_id, text), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own)])
    joined = mine.join(drop.hint("merge"), _KEY, "left").drop(*_KEY)
    at = own.index(text)

    def cut(t: str, gone: list[int]) -> tuple[str, int]:
        first, edge = boundaries(raw := t.encode(), min_lines=min_lines)
        gone, n = set(gone), len(first) - 1
        kept = [raw[edge[first[i]] : edge[first[i + 1]] - 1] for i in range(n) if i not in gone]
        return b"\n".join(kept).decode(), sum(first[i + 1] - first[i] for i in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(len(own)).to_pylist()
            texts, removed = b.column(at), [0] * b.num_rows
            lines = pc.add(pc.count_substring(texts, "\n"), 1).cast(pa.int64())
            lines = pc.if_else(pc.fill_null(pc.equal(texts, ""), True), 0, lines)
            if any(gone):
                new = texts.to_pylist()
                for i, g in enumerate(gone):
                    if g:
                        new[i], removed[i] = cut(new[i], g)
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1 : len(own)], lines, pa.array(removed, pa.int64())], names=[*[f"c{i}" for i in range(len(own))], "n_lines", "n_removed"])

    out = joined.mapInArrow(run, joined.drop("drop").schema.add("n_lines", "long").add("n_removed", "long"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], "n_lines", "n_removed")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
