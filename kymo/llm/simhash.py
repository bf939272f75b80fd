"""SimHash near-duplicates through an embedding of segment popcounts.

A 64-bit fingerprint is mapped to 32 counts, one for each segment of two bits. The Manhattan distance of two such
vectors never exceeds the Hamming distance of the fingerprints. The range join under that distance runs on a grid: the
segments form ``limit + spare`` blocks, and vectors within Manhattan distance ``limit`` agree on at least ``spare`` whole
blocks, so every choice of ``spare`` blocks is one grid whose cells are the counts there. More spare blocks make more and
narrower cells: links are the same for every ``spare``, and the number of fingerprints chooses the cheapest. Within a cell
pairs are tested by Manhattan distance, then by Hamming distance. Counts are held in unary (sorted bits), so both tests are one XOR and a
popcount.

Cells with more than ``cell_rows`` fingerprints are dealt into blocks whose pairs go to different tasks. A task sends a
spanning forest of the links it finds, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import plainly_named, text_or_empty, tidied, written
from kymo.llm.components import components

LOW = 0x5555555555555555


def fingerprint(text: str, width: int = 4, seed: int = 42) -> bytes:
    """Eight bytes, the highest bit first. No words: zero; fewer than ``width`` words: one shingle of all."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change and only ASCII white space parts
    if not words:
        return bytes(8)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:k].tolist(), ends[-k:].tolist(), strict=True)])
    hashes = np.frombuffer(raw, "u1").reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, same: bool = False) -> DataFrame:
    """(id, fp long), with ``same`` also _same, a hash of the text. Null text has no words. Every row gives one row; other
    columns aren't read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = b"".join(fingerprint(t.as_py(), width) for t in batch.column(1))
            own = [batch.column(0), pa.array(np.frombuffer(fp, ">i8").astype(np.int64)), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(own, names=["i", "fp", "same"][: len(own)])

    more = [F.xxhash64(text_col).alias("same")] if same else []
    return docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"), *more).mapInArrow(tidied(run), f"`{id_col}` {kind}, fp long" + (", _same long" if same else ""))


def unary(fp: Column) -> Column:
    """Per segment of two bits its count in unary: 00, 01 or 11."""
    low = F.lit(LOW)
    right = F.shiftrightunsigned(fp, 1)
    any_bit, both = fp.bitwiseOR(right).bitwiseAND(low), fp.bitwiseAND(right).bitwiseAND(low)
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(limit: int = 4, spare: int = 2) -> list[int]:
    """For each choice of ``spare`` blocks of segments the bits of its grid, as signed 64-bit numbers."""
    n = limit + spare
    edges = [round(32 * k / n) for k in range(n + 1)]
    block = [sum(3 << 2 * s for s in range(edges[k], edges[k + 1])) for k in range(n)]
    masks = [sum(block[k] for k in c) for c in combinations(range(n), spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cheapest_spare(n: int, limit: int = 4) -> int:
    """The ``spare`` with the least work for ``n`` fingerprints: rows of all grids, at some 20 pair tests each, and the
    pairs that meet in a cell by chance. Two counts of random bits agree with a probability of 3/8."""

    def work(spare: int) -> float:
        grids = comb(limit + spare, spare)
        return grids * (20 * n + n * n / 2 * 0.375 ** (32 * spare / (limit + spare)))

    return min(range(2, 9), key=work)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _links_in_runs(cell: np.ndarray, fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between members of equal ``cell`` (which is sorted): all of them in short runs, a spanning forest in long ones."""
    n = len(fp)
    t = (fp | fp >> np.uint64(1)) & np.uint64(LOW) | ((fp & fp >> np.uint64(1)) & np.uint64(LOW)) << np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [n]]))
    end = np.repeat(first + size, size)
    at = np.flatnonzero(np.repeat(size, size) <= 48)
    shift = 1
    while len(at):
        at = at[at + shift < end[at]]
        near = at[np.bitwise_count(t[at] ^ t[at + shift]) <= limit]
        near = near[np.bitwise_count(fp[near] ^ fp[near + shift]) <= limit]
        if len(near):
            yield fp[near], fp[near + shift]
        shift += 1
    for a, m in zip(first[size > 48].tolist(), size[size > 48].tolist(), strict=True):
        own, counts = fp[a : a + m], t[a : a + m]
        rest, front = np.arange(1, m), [0]
        while front or len(rest):
            if not front:  # what is left isn't linked to anything found so far
                front, rest = [int(rest[0])], rest[1:]
            x = front.pop()
            near = np.bitwise_count(counts[rest] ^ counts[x]) <= limit
            near[near] = np.bitwise_count(own[rest[near]] ^ own[x]) <= limit
            if near.any():
                hit = rest[near]
                yield np.repeat(own[x], len(hit)), own[hit]
                front.extend(hit.tolist())
                rest = rest[~near]


def links(prints: DataFrame, limit: int = 4, spare: int | None = None, cell_rows: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct values fp of ``prints``: enough of them for the same components as all links."""
    spare = spare or cheapest_spare(prints.count(), limit)
    u = unary(F.col("fp"))
    grids = F.array(*(F.struct(F.lit(k).cast("int").alias("g"), u.bitwiseAND(F.lit(m)).alias("c")) for k, m in enumerate(grid_masks(limit, spare))))
    cells = prints.select("fp", F.inline(grids))
    large = written(cells.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows), "large-cells")
    if large.isEmpty():
        dealt = cells.select("fp", "g", "c", F.lit(0).alias("p"), F.lit(0).alias("q"))
    else:
        dealt = cells.join(large, ["g", "c"], "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / cell_rows), F.lit(1)).cast("int"))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        dealt = dealt.select("fp", "g", "c", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
        dealt = dealt.select("fp", "g", "c", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, "g", "c", "p", "q").sortWithinPartitions("g", "c", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None

        def found(frame: pd.DataFrame) -> pa.RecordBatch:
            names = ["g", "c", "p", "q"]
            cell = frame[names].ne(frame[names].shift()).any(axis=1).to_numpy().cumsum()
            forest, a, b = _Forest(), [], []
            for x, y in _links_in_runs(cell, frame["fp"].to_numpy().view(np.uint64), limit):
                for i, j in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), strict=True):
                    if forest.join(i, j):
                        a.append(i)
                        b.append(j)
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        waiting: list[pd.DataFrame] = []
        rows = 0
        for batch in batches:
            frame = batch.to_pandas()
            waiting.append(frame)
            rows += len(frame)
            if rows >= 200_000:
                held = pd.concat(waiting, ignore_index=True)
                last = (held[["g", "c", "p", "q"]] == held[["g", "c", "p", "q"]].iloc[-1]).all(axis=1)
                yield found(held[~last])
                waiting = [held[last]]
                rows = len(waiting[0])
        if waiting:
            yield found(pd.concat(waiting, ignore_index=True))

    return dealt.mapInArrow(tidied(run), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4, spare: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, fp (long), component_id (the smallest id reachable over links).

    Fingerprints within ``limit`` bits are linked; texts without words (null ones too) share the fingerprint zero. A null
    id takes its component's smallest id, null only where the component has none. An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    own = written(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct-fingerprints")
    roots = components(links(own.select("fp"), limit, spare))
    labelled = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = labelled.groupBy("_root").agg(F.min("_least").alias("component_id"))
    named = written(labelled.join(least, "_root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4, spare: int | None = None) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, all columns kept.

    Rows are judged by id and text: of rows that share an id, those go whose text is a near copy of one that stays. Rows
    with a null id stay. What goes is a table of ids and text hashes: Spark broadcasts it where its size allows and
    shuffles the texts only where it doesn't.
    """

    def work(plain: DataFrame, id_col: str, text_col: str) -> DataFrame:
        prints = written(fingerprints(plain, id_col, text_col, width, same=True), "fingerprints")
        own = written(prints.groupBy("fp").agg(F.min(F.when(F.col(id_col).isNotNull(), F.struct(F.col(id_col).alias("id"), "_same"))).alias("_least")), "distinct-fingerprints")
        roots = components(links(own.select("fp"), limit, spare))
        labelled = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
        least = labelled.groupBy("_root").agg(F.min("_least").alias("_first"))
        named = written(labelled.join(least, "_root").select("fp", "_first"), "fingerprint-components")
        found = written(prints.filter(F.col(id_col).isNotNull()).join(named, "fp").select(id_col, "_same", "_first"), "near-copies")
        stays = (F.col(id_col) == F.col("_first")["id"]) & (F.col("_same") == F.col("_first")["_same"])
        gone = written(found.filter(~stays).select(F.col(id_col).alias("_gone"), F.col("_same").alias("_gone_same")).distinct(), "near-copies-gone")
        kept = plain.withColumn("_same", F.xxhash64(text_col)).join(gone, (F.col(id_col) == F.col("_gone")) & (F.col("_same") == F.col("_gone_same")), "left_anti")
        if found.groupBy(id_col, "_same").count().filter("count > 1").isEmpty():
            return kept
        return kept.filter(F.col(id_col).isNull()).unionByName(kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col, "_same"]))

    return plainly_named(docs, work, id_col, text_col)
