"""Batched calls of an external function (a model, a command, a service) over the rows of a table.

The function takes and returns a pandas frame; a batch that fails is halved, down to single rows at
the given depth, and a row that still fails becomes a row with its error, so that one bad row stops
neither its batch nor the job. Rows that got no result are reported, not lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Call = Callable[[pd.DataFrame], pd.DataFrame]


def call_in_batches(rows: DataFrame, key: str, call: Call, result: str, size: int = 12, depth: int = 4) -> DataFrame:
    """Columns key, those of `result` (a DDL string), status (done, missing, error), error, calls (made for this row).

    The key is unique and not null. Results with other keys are ignored, the first of repeated ones counts.
    """
    kind = rows.schema[key].dataType.simpleString()
    names = [part.split()[0] for part in result.split(",")]

    def answer(batch: pd.DataFrame, level: int, calls: int) -> list[dict]:
        try:
            got = call(batch).drop_duplicates(key).set_index(key)
        except Exception as e:  # noqa: BLE001  whatever the function raises belongs to its rows
            if len(batch) == 1:
                return [{key: batch[key].iloc[0], "status": "error", "error": f"{type(e).__name__}: {e}", "calls": calls + 1}]
            step = 1 if level + 1 >= depth else (len(batch) + 1) // 2
            return [r for i in range(0, len(batch), step) for r in answer(batch.iloc[i : i + step], level + 1, calls + 1)]
        out = []
        for k in batch[key]:
            there = k in got.index
            out.append({key: k, "status": "done" if there else "missing", "error": None, "calls": calls + 1} | ({n: got.at[k, n] for n in names} if there else {}))
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), size):
                yield pd.DataFrame(answer(frame.iloc[i : i + size], 0, 0), columns=[key, *names, "status", "error", "calls"])

    return rows.mapInPandas(run, f"{key} {kind}, {result}, status string, error string, calls long")


def unanswered(rows: DataFrame, stored: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Rows whose stored result is missing or belongs to another fingerprint: those to be computed again."""
    same = stored.select(F.col(key), F.col(fingerprint)).distinct()
    return rows.join(same, [key, fingerprint], "left_anti")


def latest_results(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored results overlaid by new ones that are done; a failed call keeps what was stored."""
    done = new.filter("status = 'done'")
    shared = [c for c in stored.columns if c in done.columns]
    return done.select(*shared).unionByName(stored.join(done.select(key), key, "left_anti").select(*shared))


def call_by_chunks(rows: DataFrame, keys: list[str], order: str, size: int, call: Call, fallback: Call, result: str, recoverable: tuple[type[BaseException], ...] = (TimeoutError, ValueError)) -> DataFrame:
    """Pages of a document in chunks of `size`: a chunk that fails is called page by page, a page that fails goes to `fallback`.

    Both functions take the frame of a chunk (keys, order and all other columns) and return rows of `result` (a DDL
    string). Columns keys, first and last (order of the chunk's ends), those of result, source (call or fallback) and
    reason (why the fallback took over). An error that isn't recoverable fails the job, as a wrong setting would
    fail every chunk. A document's chunks are bounded by size, so they are made without gathering the document.
    """
    names = [part.split()[0] for part in result.split(",")]
    by = W.partitionBy(*keys).orderBy(order)
    chunked = rows.withColumn("_chunk", F.floor((F.row_number().over(by) - 1) / size))
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys), *(f"{n} {rows.schema[order].dataType.simpleString()}" for n in ("first", "last")), result, "source string", "reason string"])

    def one(frame: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return [call(frame)[names].assign(source="call", reason=None)]
        except recoverable as e:
            if len(frame) > 1:
                return [r for i in range(len(frame)) for r in one(frame.iloc[i : i + 1])]
            return [fallback(frame)[names].assign(source="fallback", reason=f"{type(e).__name__}: {e}"[:220])]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(order)
        got = pd.concat(one(frame.drop(columns="_chunk").reset_index(drop=True)))
        head = {k: frame[k].iloc[0] for k in keys} | {"first": frame[order].iloc[0], "last": frame[order].iloc[-1]}
        return got.assign(**head)[[*head, *names, "source", "reason"]]

    return chunked.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def merge_chunks(stored: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """Stored results of chunks (keys, first, last) without those that were run again, and the new ones."""
    chunk = [*keys, "first", "last"]
    return stored.join(again.select(*chunk).distinct(), chunk, "left_anti").unionByName(again)
