"""Best-fit packing of token pieces into sequences under several capacities at once.

A bin has three residual capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces go
in order of falling length into the feasible bin with the best score: the smallest weighted norm of what would be left
("norm"), or the largest weighted dot product of demand and residual ("dot"). Pieces are dealt by hash into groups of a
bounded expected size, each packed by one task; a group costs at most a few partly filled sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.bpe import Encoder, Merges
from kymo.llm.common import text_or_empty, tidied, written

END_ID = 1


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold. ``attention`` bounds the sum of squared piece lengths; the default never binds."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Raises ValueError for a piece that no empty bin can hold; ties go to the oldest bin."""
    n = len(lengths)
    square = lengths.astype(np.int64) ** 2
    if n and (lengths.max() > cap.tokens or square.max() > cap.attention or cap.documents < 1):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    least = int(lengths.min()) if n else 0
    caps = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights) / caps**2
    left = np.zeros((3, 1024))
    names = np.zeros(1024, np.int64)
    opened = live = 0
    for i in order.tolist():
        need = (int(lengths[i]), 1, int(square[i]))
        k = -1
        if live:
            t, d, a = left[:, :live]
            fits = np.flatnonzero((t >= need[0]) & (d >= 1) & (a >= need[2]))
            if len(fits):
                t, d, a = t[fits], d[fits], a[fits]
                if cap.score == "norm":
                    k = int(fits[np.argmin(weights[0] * (t - need[0]) ** 2 + weights[1] * (d - 1) ** 2 + weights[2] * (a - need[2]) ** 2)])
                else:
                    k = int(fits[np.argmax(weights[0] * need[0] * t + weights[1] * d + weights[2] * need[2] * a)])
        if k < 0:
            k = live
            if k == left.shape[1]:
                left, names = np.concatenate([left, np.zeros_like(left)], 1), np.concatenate([names, np.zeros_like(names)])
            left[:, k], names[k] = caps, opened
            opened, live = opened + 1, live + 1
        where[i], offset[i] = names[k], cap.tokens - left[0, k]
        left[:, k] -= need
        if left[0, k] < least or left[1, k] < 1:  # closed for good; the others keep their order
            left[:, k : live - 1] = left[:, k + 1 : live].copy()
            names[k : live - 1] = names[k + 1 : live].copy()
            live -= 1
    return where, offset


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str, memory: int) -> Encoder:
    return Encoder(Merges(tokenizer_file), memory=memory, decode=False)


def pieces(docs: DataFrame, tokenizer_file: str, tokens: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, memory: int = 800_000) -> DataFrame:
    """Each text's ids with ``END_ID`` behind them, cut into pieces of ``tokens``; only the last may be shorter.

    id, piece, start, length, ids_crc32 and, if asked for, ids (array<int>). Null text counts as empty: one piece of one
    id. Repeated rows and null ids stay; an empty table gives an empty result; other columns aren't read. ``memory``: words
    whose ids a worker remembers, at some 200 bytes each.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, memory)
        for batch in batches:
            row, number, start, length, crc, ids = [], [], [], [], [], []

            def flush() -> pa.RecordBatch:
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]  # noqa: B023
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))  # noqa: B023
                for x in (row, number, start, length, crc, ids):  # noqa: B023
                    x.clear()
                return pa.RecordBatch.from_arrays(columns, names=["i", "p", "s", "l", "c", "ids"][: len(columns)])

            for k, (raw, _) in enumerate(encoder.encode(t.as_py() for t in batch.column(1))):
                raw += end
                for j, at in enumerate(range(0, len(raw), 4 * tokens)):
                    part = raw[at : at + 4 * tokens]
                    row.append(k)
                    number.append(j)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                if with_ids and len(row) >= 1000:
                    yield flush()
            yield flush()

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(tidied(run), schema)


def pack_pieces(found: DataFrame, id_col: str = "doc_id", capacity: Capacity = Capacity(), group_rows: int = 24_000) -> DataFrame:
    """``found`` with sequence_id and offset. ``group_rows``: the expected rows of one task's group.

    Rows are dealt by their place in the table, so that neither null ids nor repeated rows fill a group.
    """
    groups = max(1, round(found.count() / group_rows))
    schema = found.schema.add("sequence_id", "long").add("offset", "long")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        group = group.drop_columns("_group").sort_by([(id_col, "ascending"), ("piece", "ascending")])
        where, offset = best_fit(group["length"].to_numpy().astype(np.int64), capacity)
        return group.append_column("sequence_id", pa.array(where + (key[0].as_py() << 40))).append_column("offset", pa.array(offset))

    return found.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))).groupBy("_group").applyInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), with_ids: bool = True, group_rows: int = 24_000, memory: int = 800_000) -> DataFrame:
    """All texts packed; see ``pieces`` for its columns and edge cases. Offsets in a sequence run gapless from 0."""
    found = written(pieces(docs, tokenizer_file, capacity.tokens, id_col, text_col, with_ids, memory), "pieces")
    return pack_pieces(found, id_col, capacity, group_rows)
