"""Chunks: records rolled over by bytes, and their descriptors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chunk_ordinals(sizes: np.ndarray, target: int, open_ordinal: int = 0, open_bytes: int = 0) -> tuple[np.ndarray, int, int]:
    """The chunk of each record, and the open chunk after them. A chunk is sealed before a record that would take it past
    ``target`` and after one that reaches it; a record is never split, and one over ``target`` is alone."""
    out = np.empty(len(sizes), np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        room = target - open_bytes
        to = int(np.searchsorted(total, total[at] + room, side="right")) - 1  # records up to here fit
        if to <= at:
            if open_bytes:  # seal before the record
                open_ordinal, open_bytes = open_ordinal + 1, 0
                continue
            to = at + 1
        out[at:to] = open_ordinal
        open_bytes += int(total[to] - total[at])
        at = to
        if open_bytes >= target:
            open_ordinal, open_bytes = open_ordinal + 1, 0
    return out, open_ordinal, open_bytes


def rolled_over(records: DataFrame, keys: Sequence[str], target: int) -> DataFrame:
    """``records`` (keys, iteration, line, bytes) with ordinal.

    Rollover is a fold along a stream, so a stream is one ordered run: partitions are dealt by key and sorted, and a task
    goes through its runs batch by batch with nothing but the open chunk in hand; no stream is ever held whole. Without
    ``keys`` all rows are one stream: see ``along_one_stream``.
    """
    if not keys:
        return along_one_stream(records, target)
    schema = T.StructType([*records.schema.fields, T.StructField("ordinal", T.LongType(), False)])
    keys = list(keys)
    dealt = records.repartition(*keys).sortWithinPartitions(*keys, "iteration")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, ordinal, size = None, 0, 0
        for batch in batches:
            key = list(batch[keys].itertuples(index=False, name=None))
            out = np.empty(len(batch), np.int64)
            edges = [0, *(k for k in range(1, len(batch)) if key[k] != key[k - 1]), len(batch)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if key[a] != open_key:
                    open_key, ordinal, size = key[a], 0, 0
                out[a:b], ordinal, size = chunk_ordinals(batch["bytes"].to_numpy(np.int64)[a:b], target, ordinal, size)
            yield batch.assign(ordinal=out)

    return dealt.mapInPandas(run, schema)


def chunk_starts(records: DataFrame, target: int | None) -> list[int]:
    """The first iteration of every chunk of one stream, a chunk per record where ``target`` is None.

    Only (iteration, bytes) go to the task that folds them: records are read and encoded side by side, and their lines stay
    where they are. What comes back is a number for each chunk, as many as the recording's metadata lists.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, ordinal, size = -1, 0, 0
        for batch in batches:
            out, ordinal, size = chunk_ordinals(batch["bytes"].to_numpy(np.int64), target, ordinal, size)
            new = np.concatenate([[True], out[1:] != out[:-1]]) if len(out) else np.zeros(0, bool)
            if len(out):
                new[0] = out[0] != last
                last = out[-1]
            yield pd.DataFrame({"first": batch["iteration"].to_numpy()[new].astype(str)})

    if target is None:
        return sorted(int(r["iteration"]) for r in records.select("iteration").collect())
    small = records.select("iteration", "bytes").repartition(1).sortWithinPartitions("iteration")
    return sorted(int(r["first"]) for r in small.mapInPandas(run, "first string").collect())


def along_one_stream(records: DataFrame, target: int | None) -> DataFrame:
    """``records`` of one stream with ordinal: each finds its chunk among the chunks' first iterations."""
    starts = chunk_starts(records, target)
    schema = T.StructType([*records.schema.fields, T.StructField("ordinal", T.LongType(), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ordinal=np.array([bisect_right(starts, int(i)) - 1 for i in batch["iteration"]], np.int64))

    return records.mapInPandas(run, schema)


def individual(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each record a chunk of its own."""
    if not keys:
        return along_one_stream(records, None)
    return records.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*keys).orderBy("iteration")) - 1).cast("bigint"))


def chunk_file(ordinal: Column) -> Column:
    return F.format_string("chunk-%06d.jsonl", ordinal)


def descriptors(chunked: DataFrame, keys: Sequence[str], checksum: bool = True) -> DataFrame:
    """(keys, ordinal, file, records, bytes, checksum, first_iteration, last_iteration) of every chunk."""
    sha = [F.concat(F.lit("sha256:"), F.sha2(F.expr("listagg(concat(line, '\n')) WITHIN GROUP (ORDER BY iteration)"), 256)).alias("checksum")] if checksum else []
    found = chunked.groupBy(*keys, "ordinal").agg(F.count(F.lit(1)).alias("records"), F.sum("bytes").alias("bytes"), *sha, F.min("iteration").alias("first_iteration"), F.max("iteration").alias("last_iteration"))
    return found.select(*keys, "ordinal", chunk_file(F.col("ordinal")).alias("file"), "records", "bytes", *(["checksum"] if checksum else []), "first_iteration", "last_iteration")


def stream_summary(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, chunk_count, records, bytes, first_iteration, last_iteration), from descriptors alone."""
    return chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.min("first_iteration").alias("first_iteration"), F.max("last_iteration").alias("last_iteration"))


def rewound(chunks: DataFrame, records: DataFrame, keys: Sequence[str], checkpoint: int) -> DataFrame:
    """Descriptors after a rewind to ``checkpoint``: whole chunks up to it stay, later ones go, and only the one across it
    is described anew from its records."""
    kept = chunks.filter(F.col("last_iteration") <= checkpoint)
    across = chunks.filter((F.col("first_iteration") <= checkpoint) & (F.col("last_iteration") > checkpoint)).select(*keys, "ordinal")
    again = descriptors(records.filter(F.col("iteration") <= checkpoint).join(across, [*keys, "ordinal"]), keys, "checksum" in chunks.columns)
    return kept.unionByName(again)
