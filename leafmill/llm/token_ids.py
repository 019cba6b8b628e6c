"""Token ids of documents in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by id and sorted before they are encoded, so one file holds a range
of ids, its rows ascend, and the files follow each other in the order of their part numbers. A row is
(doc_id, part, start_in_part, end_in_part, ids). ORC stores the ids as run-length encoded integers in stripes of
`stripe_bytes`; readers take stripes in parallel, and a search for documents skips files, stripes and
groups of `index_stride` rows by the least and greatest doc_id of each and by the Bloom filters.

The start of a document in the whole sequence is the sum of what the parts before hold (one row a
part, the only thing that meets in one task and is broadcast) plus its start in its own part.

Encoding is the library's own, by pieces: a text can be cut before a space or line break between two
characters that are no white space, and between a letter and a mark, as a byte-level pre-tokenizer starts
a piece there whatever stands around. Places to cut are found in the bytes of a whole Arrow batch, whose pieces Arrow
tells apart. The distinct pieces that a worker doesn't know yet are joined and encoded by the library in groups,
and remembered, MOST_WORDS of them at most. Texts that hold an added token's string, and tokenizers of another kind, go
through the library whole.

Edge cases: a null or empty text has no ids but the end id; null doc_ids stand first; rows with equal
doc_id follow each other in the order of the input, which must read the same again (a table, not a
sample) as parts are recomputed from it when an executor is lost; an empty table gives files without
rows; other columns are left out; a text of any length is one row.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leafmill.llm.common import read, scratch_path, small_batches

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
STRIPE_BYTES, INDEX_STRIDE, FALSE_HITS = 16 << 20, 1000, 0.01
#: A writer looks at the size of its stripe after so many rows; rows can be long.
CHECK_ROWS = 100
#: Packed ids hardly shrink any further; a fast codec does.
COMPRESSION = "snappy"
#: Pieces that a worker remembers at most, the longest it remembers, in bytes, and how many it encodes at once.
MOST_WORDS, MOST_CHARS, GROUP = 800_000, 64, 100
#: Documents encoded at once: the more, the fewer lookups of the same piece.
BATCH_ROWS = 1024
SCHEMA = "doc_id long, part int, start_in_part long, end_in_part long, ids array<int>"


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers by its name, or a path as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: How byte-level vocabularies write a space.
SPACE = "\u0120"
#: Marks that no letter before them goes together with.
MARKS = ".,;:!?)\"'#$%&*|<>"
#: Kinds of bytes: white space, ASCII letters, marks, first bytes of two that make a letter (but for SIGNS), first bytes of what may be white space.
WHITE, LETTER, MARK, LATIN, WIDE = range(1, 6)
KIND = np.zeros(256, np.uint8)
KIND[list(b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")] = WHITE
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[list(MARKS.encode())] = MARK
KIND[0xC3:0xC9] = LATIN
KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = WIDE
SIGNS = np.array([int.from_bytes(c.encode()) for c in "\u00d7\u00f7"])
WIDE_2 = np.array([int.from_bytes(c.encode()) for c in "\x85\xa0"])
WIDE_3 = np.array([int.from_bytes(c.encode()) for c in "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"])


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def cut_places(a: np.ndarray) -> np.ndarray:
    """Where UTF-8 text (bytes) can be cut, as a mask of the bytes that begin a piece.

    That is before a space or line break between two characters that are no white space, and between a letter
    and a mark: there a byte-level pre-tokenizer ends a piece and starts another whatever stands around.
    """
    cut = np.zeros(len(a), bool)
    if len(a) < 2:
        return cut
    kind = KIND[a]
    solid = kind != WHITE
    wide = np.flatnonzero(kind == WIDE)
    if len(wide):
        two = a[wide].astype(np.int64) << 8 | a[np.minimum(wide + 1, len(a) - 1)]
        three = two << 8 | a[np.minimum(wide + 2, len(a) - 1)]
        of_two, of_three = wide[np.isin(two, WIDE_2)], wide[np.isin(three, WIDE_3)]
        for at in (of_two, of_two + 1, of_three, of_three + 1, of_three + 2):
            solid[at] = False
    letter = kind == LETTER
    latin = np.flatnonzero(kind[:-1] == LATIN)
    letter[latin + 1] = ~np.isin(a[latin].astype(np.int64) << 8 | a[latin + 1], SIGNS)
    cut[1:-1] = ((a[1:-1] == 0x20) | (a[1:-1] == 0x0A)) & solid[:-2] & solid[2:]
    cut[1:] |= (kind[1:] == MARK) & letter[:-1]
    return cut


class Encoder:
    """Texts to ids as bytes (int32). `known` holds the ids of pieces (UTF-8, with the space or line break before them)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.whole, self.known = Tokenizer.from_file(path), {}
        pre = spec.get("pre_tokenizer") or {}
        self.added = [x["content"] for x in spec.get("added_tokens") or []]
        self.by_piece = not any(spec.get(k) for k in ("normalizer", "truncation", "padding")) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(map(re.compile(r"\s").search, self.added))
        vocab = self.whole.get_vocab()
        self.spaced = np.zeros(1 + max(vocab.values()), bool)
        self.spaced[[i for token, i in vocab.items() if token.startswith(SPACE)]] = True
        breaks = self.plain("\n")
        self.break_id = np.frombuffer(breaks, np.int32)[0] if len(breaks) == 4 else -1
        self.by_piece = self.by_piece and self.break_id >= 0

    def plain(self, text: str) -> bytes:
        return _bytes(self.whole.encode(text, add_special_tokens=False).ids)

    def learn(self, pieces: list[bytes], alone: set[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces. Those without white space but at their start are encoded together, the others and `alone` one by one."""
        found, spaced, broken, bare = {}, [], [], []
        for p in pieces:
            text = p.decode()
            kind = spaced if text[0] == " " else broken if text[0] == "\n" else bare
            if text.split() == [text if kind is bare else text[1:]] and p not in alone:
                kind.append(p)
            else:
                found[p] = self.plain(text)
        for kind, mark in ((spaced, b""), (broken, b""), (bare, b"\n")):
            for at in range(0, len(kind), GROUP):
                self.encode_together(kind[at : at + GROUP], mark, found)
        return found

    def encode_together(self, pieces: list[bytes], mark: bytes, found: dict[bytes, bytes]) -> None:
        """Encode pieces as one text, each by its own space or line break, or after a mark (a line break) that isn't its own."""
        (e,) = self.whole.encode_batch_fast([(mark + mark.join(pieces)).decode()], add_special_tokens=False)
        ids = np.array(e.ids, np.int32)
        starts = self.spaced[ids] if pieces[0][:1] == b" " else ids == self.break_id
        cuts = [*(4 * np.flatnonzero(starts)).tolist(), 4 * len(ids)]
        flat, skip = ids.tobytes(), 4 * len(mark)
        for p, i, j in zip(pieces, cuts[:-1], cuts[1:], strict=True):
            found[p] = flat[i + skip : j]

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each text begin and end, and the ids (int32) of all, each text's with `end` behind.

        Pieces are offsets into the array's bytes; Python sees the distinct ones of the array only.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return np.zeros(1, np.int32), np.zeros(0, np.int32)
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        a = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        at = at - at[0]
        cut, alone = cut_places(a), set()
        for i in np.flatnonzero(self.uncut(texts)):
            cut[at[i] : at[i + 1]] = False
            alone.add(a[at[i] : at[i + 1]].tobytes())
        cut[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(a))), pa.py_buffer(a)]).dictionary_encode()
        ids = [*self.ids_of(pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), alone), end]
        last = np.searchsorted(starts, at[1:])
        codes = np.insert(pieces.indices.to_numpy(), last, len(ids) - 1)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        first, sizes = (np.cumsum(sizes, dtype=np.int32) - sizes)[codes], sizes[codes]
        ends = np.cumsum(sizes, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), np.int32)
        return np.append(0, ends[last + np.arange(len(last))]), flat[np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1], dtype=np.int32)]

    def uncut(self, texts: pa.Array) -> np.ndarray:
        """Which texts go through the library whole."""
        if not self.by_piece:
            return np.ones(len(texts), bool)
        return np.logical_or.reduce([np.zeros(len(texts), bool), *(pc.match_substring(texts, token).to_numpy(zero_copy_only=False) for token in self.added)])

    def ids_of(self, pieces: list[bytes], alone: set[bytes]) -> list[bytes]:
        """Ids of distinct pieces; what is new is remembered, if it isn't long."""
        ids = list(map(self.known.get, pieces))
        fresh = [p for p, x in zip(pieces, ids, strict=True) if x is None]
        found = self.learn(fresh, alone)
        if len(self.known) + len(fresh) > MOST_WORDS:
            self.known = {}
        self.known.update(islice(((p, x) for p, x in found.items() if len(p) <= MOST_CHARS), MOST_WORDS))
        return [found[p] if x is None else x for p, x in zip(pieces, ids, strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        at, flat = self.encode_array(pa.array(texts, pa.large_string()))
        return [flat[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One a worker for each tokenizer."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(tokenizer_path(name))
    return _ENCODERS[name]


def write_ids(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, index_stride: int = INDEX_STRIDE) -> None:
    """Write the ids of every document, each with end_id behind, to ORC files under path."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("end_in_part", pa.int64()), ("ids", pa.list_(pa.int32()))])
    end = np.array([end_id], np.int32).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            at, flat = enc.encode_array(b.column(1), end)
            ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part, np.int32)), pa.array(start + at[:-1].astype(np.int64)), pa.array(start + at[1:].astype(np.int64)), ids], schema=schema)
            start += int(at[-1])

    small_batches(docs.sparkSession, BATCH_ROWS)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("at", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("at")]
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_HITS), "orc.stripe.size": str(stripe_bytes), "orc.rows.between.memory.checks": str(CHECK_ROWS), "orc.row.index.stride": str(index_stride), "orc.create.index": "true", "compression": COMPRESSION}
    ranged.mapInArrow(encoded, SCHEMA).write.options(**options).orc(path)


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows. Filters on doc_id are pushed down to files, stripes, row groups and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """rows of open_ids with `start`: ids of all documents before; stored holds all rows of the files."""
    totals = stored.groupBy("part").agg(F.max("end_in_part").alias("held"))
    before = totals.select("part", F.coalesce(F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents, read from the row groups whose statistics and Bloom filters may hold them."""
    return open_ids(spark, path).filter(F.col("doc_id").isin(doc_ids))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of rows with starts."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            at, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "start", "ids").mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    write_ids(read(spark, sf_dir, "documents"), path)
    stored = open_ids(spark, path)
    return digests(with_starts(stored, stored))
