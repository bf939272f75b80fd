"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

Lines are compared in lower case with runs of white space as one space; blank lines are never compared and always stay.
Each line has a 128-bit digest, by which exact copies meet, and band keys of a MinHash signature. Buckets of a band that
hold two or more different lines are candidates; equal buckets of several bands count once. Members' texts meet by
bucket, where a breadth-first search with exact Jaccard similarity of the shingle sets finds a spanning forest of the
links. Buckets over ``bucket_rows`` lines are dealt into blocks whose pairs go to different tasks, so no bucket is cut.
Of each component the line that comes first by (id, line number) stays.

Signatures: short lines take ``bands * rows`` hash functions; long ones one hash whose minima are kept per bin (empty
bins borrow from the next). Length is the number of different shingles. Lines between the two lengths get both kinds, so
similar lines always share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.llm.common import SPACES, bit_table, maybe_in, plainly_named, text_or_empty, tidied, written
from kymo.llm.components import components
from kymo.llm.simhash import _Forest

_U = np.uint64


@dataclass(frozen=True)
class Fuzzy:
    """``width`` characters a shingle; similarity from ``least`` on; recall at ``least`` is 1 - (1 - least^rows)^bands."""

    width: int = 8
    least: float = 0.8
    bands: int = 12
    rows: int = 4
    short: int = 128
    long: int = 100
    bucket_rows: int = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """Full avalanche of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def shingles(lines: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, line by line, and where each line starts. A line under ``width`` characters is one shingle."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    pad = "\0" * (width - 1)
    codes = np.frombuffer((pad.join(lines) + pad).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    codes += _U(1)
    n = max(len(codes) - width + 1, 0)
    h, wide = codes, 1
    while 2 * wide <= width:  # by doubling, then a character at a time
        h = h[:-wide] * _U(pow(0x100000001B3, wide, 1 << 64)) + h[wide:]
        wide *= 2
    for k in range(wide, width):
        h = h[:-1] * _U(0x100000001B3) + codes[k : k + len(h) - 1]
    starts = np.concatenate([[0], np.cumsum(size + width - 1)[:-1]]) if len(lines) else np.zeros(0, np.int64)
    count = np.maximum(size - width + 1, 1)
    offsets = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], count)
    return mixed(h[at]), offsets


def different(hashes: np.ndarray, offsets: np.ndarray, least: int, most: int | None = None) -> np.ndarray:
    """Each line's number of different shingles; lines with fewer than ``least`` keep their number with repeats, and so do
    those whose shingles' first bytes alone show more than ``most`` different ones."""
    count = np.diff(offsets)
    many = np.flatnonzero(count >= least)
    if most is not None and len(many):
        shown = np.zeros(len(count) << 8, bool)
        for a in range(0, len(hashes), 1 << 20):
            row = np.searchsorted(offsets, (a, min(a + (1 << 20), len(hashes)) - 1), side="right") - 1
            rows = np.arange(row[0], row[1] + 1)
            n = np.minimum(offsets[rows + 1], a + (1 << 20)) - np.maximum(offsets[rows], a)
            shown[(np.repeat(rows << 8, n)) + (hashes[a : a + (1 << 20)] >> _U(56)).astype(np.int64)] = True
        many = many[shown.reshape(-1, 256)[many].sum(axis=1) <= most]
    for a in range(0, len(many), 1 << 14):
        own = many[a : a + (1 << 14)]
        n = count[own]
        row = np.repeat(np.arange(len(own)), n)
        at = np.arange(len(row)) + np.repeat(offsets[own] - (np.cumsum(n) - n), n)
        key = np.sort(row.astype(_U) << _U(50) | hashes[at] >> _U(14))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        count[own] = np.bincount((key[new] >> _U(50)).astype(np.int64), minlength=len(own))
    return count


def signatures(hashes: np.ndarray, offsets: np.ndarray, fuzzy: Fuzzy) -> tuple[np.ndarray, np.ndarray]:
    """(line, band key) pairs."""
    count, kinds = np.diff(offsets), different(hashes, offsets, fuzzy.long, fuzzy.short)
    k = fuzzy.bands * fuzzy.rows
    out_line, out_key = [], []

    def banded(line: np.ndarray, sig: np.ndarray, kind: int) -> None:
        key = np.full((len(line), fuzzy.bands), kind, _U) + np.arange(fuzzy.bands, dtype=_U) * _U(2)
        for r in range(fuzzy.rows):
            key = mixed(key * _U(0x9E3779B97F4A7C15) ^ sig[:, r :: fuzzy.rows])
        out_line.append(np.repeat(line, fuzzy.bands))
        out_key.append(key.ravel())

    short = np.flatnonzero(kinds <= fuzzy.short)
    if len(short):
        first = np.cumsum(count[short]) - count[short]
        own = hashes[np.repeat(kinds <= fuzzy.short, count)]
        own = (own >> _U(32)).astype(np.uint32)
        sig = np.empty((len(short), k), _U)
        rng = np.random.default_rng(20_240_601)
        for j, (a, b) in enumerate(rng.integers(1, 1 << 32, (k, 2), dtype=np.uint32)):
            sig[:, j] = np.minimum.reduceat(own * (a | np.uint32(1)) + b, first)
        banded(short, sig, 0)
    long = np.flatnonzero(kinds >= fuzzy.long)
    if len(long):
        own = hashes[np.repeat(kinds >= fuzzy.long, count)]
        cell = np.repeat(np.arange(len(long)) * k, count[long]) + ((own >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
        none = _U(0xFFFFFFFFFFFFFFFF)
        sig = np.full(len(long) * k, none)
        np.minimum.at(sig, cell, own & _U(0xFFFFFFFF))  # the bits that didn't choose the bin
        sig = sig.reshape(-1, k)
        for step in range(1, k):
            empty = sig == none
            if not empty.any():
                break
            sig = np.where(empty, np.where(np.roll(empty, -1, axis=1), none, np.roll(sig, -1, axis=1) + _U(step)), sig)
        banded(long, sig, 1)
    if not out_line:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(out_line), np.concatenate(out_key)


def _spaced(line: str) -> str:
    """White space as single spaces within; of printable lines, where only the space is white, most need no splitting."""
    return line.strip() if line.isprintable() and "  " not in line else " ".join(line.split())


def comparable(line: str) -> str:
    """What is compared of a line."""
    return _spaced(line.lower())


def _lines(texts: pa.Array) -> Iterator[tuple[int, int, str]]:
    """(row, line number, comparable line) of the lines with a word."""
    for k, text in enumerate(texts):
        if text.is_valid:
            for j, line in enumerate(text.as_py().lower().split("\n")):
                if line := _spaced(line):
                    yield k, j, line


def _digests(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines), "<i8").reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def occurrences(docs: DataFrame, id_col: str, text_col: str, fuzzy: Fuzzy) -> DataFrame:
    """Every line with a word: id, row (a number of its own for each row of ``docs``), same (a hash of the row's text),
    line, hi and lo (its digest), keys (its band keys)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in batches:
            rows, numbers, held, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                hi, lo = _digests(held)  # noqa: B023
                new = []  # copies of a line give its keys once a task
                for k, x in enumerate(lo.tolist()):
                    if x not in signed:
                        signed.add(x)
                        new.append(k)
                if len(signed) > 200_000:
                    signed.clear()
                line, key = signatures(*shingles([held[k] for k in new], fuzzy.width), fuzzy)  # noqa: B023
                line = np.array(new, np.int64)[line]
                order = np.argsort(line, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(held)))])  # noqa: B023
                keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[order].view(np.int64)))
                own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 2, 3)]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.array(numbers, pa.int32()), pa.array(hi), pa.array(lo), keys], names=["i", "row", "same", "line", "hi", "lo", "keys"])  # noqa: B023

            for k, j, line in _lines(batch.column(1)):
                rows.append(k)
                numbers.append(j)
                held.append(line)
                size += len(line)
                if size > 250_000:
                    yield flush()
                    rows, numbers, held, size = [], [], [], 0
            if held:
                yield flush()

    read = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text_col).alias("same"))
    return read.mapInArrow(tidied(run), f"_id {kind}, _row long, _same long, _line int, hi long, lo long, keys array<long>")


def _texts(docs: DataFrame, id_col: str, text_col: str, seen: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lo, hi, text) of the lines whose lo is in ``wanted``, read where each stands first.

    Bit tables over rows and lines spare reading and shuffling most others; the join decides.
    """
    signed = seen.filter("signed").join(wanted, "lo", "left_semi")  # of a line's copies one a task at least
    place = F.struct(F.col("_id").isNull().alias("none"), F.xxhash64("_id").alias("id"), F.col("_line").alias("line"))
    places = written(signed.groupBy("lo", "hi").agg(F.min(place).alias("p")).select("lo", "hi", F.col("p.id").alias("id"), F.col("p.line").alias("line")), "line-places")
    near_row, near_line = bit_table(places.select("id").distinct(), "id"), bit_table(places.select("lo"), "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            on = pa.array(maybe_in(near_row, ids))
            batch = batch.filter(on)
            ids = ids[on.to_numpy(zero_copy_only=False)]
            held, rows, numbers, size = [], [], [], 0

            def found() -> pa.RecordBatch:
                hi, lo = _digests(held)  # noqa: B023
                on = np.flatnonzero(maybe_in(near_line, lo))
                return pa.record_batch({"id": pa.array(ids[rows][on]), "line": pa.array(np.array(numbers, np.int32)[on]), "hi": pa.array(hi[on]), "lo": pa.array(lo[on]), "text": pa.array([held[i] for i in on], pa.string())})  # noqa: B023

            for k, j, line in _lines(batch.column(1)):
                held.append(line)
                rows.append(k)
                numbers.append(j)
                size += len(line)
                if size > 1_000_000:
                    yield found()
                    held, rows, numbers, size = [], [], [], 0
            if held:
                yield found()

    found = docs.select(F.xxhash64(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidied(run), "id long, line int, hi long, lo long, text string")
    return found.join(places, ["id", "line", "hi", "lo"]).select("lo", "hi", "text")


def _linked(frame_bucket: np.ndarray, texts: list[str], node: list[tuple[int, int]], fuzzy: Fuzzy, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Spanning links between members of equal bucket (sorted) whose shingle sets have Jaccard similarity of ``least`` or more."""
    n = len(texts)
    hashes, offsets = shingles(texts, fuzzy.width)
    key = np.sort(np.repeat(np.arange(n).astype(_U) << _U(50), np.diff(offsets)) | hashes >> _U(14))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    row, hashes = (key >> _U(50)).astype(np.int64), key & _U((1 << 50) - 1)
    size = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    ends = np.concatenate([np.flatnonzero(frame_bucket[1:] != frame_bucket[:-1]) + 1, [n]])
    begins = np.concatenate([[0], ends[:-1]])
    both = np.zeros(n, np.int64)  # of each pair that is a bucket of its own, at its first row
    pairs = np.flatnonzero(ends - begins == 2)
    of_pair = np.zeros(n, bool)
    of_pair[begins[pairs]] = of_pair[begins[pairs] + 1] = True
    on = of_pair[row]
    lead = np.repeat(begins, ends - begins)[row[on]]
    key = np.sort(lead.astype(_U) << _U(50) | hashes[on])
    np.add.at(both, (key[1:][key[1:] == key[:-1]] >> _U(50)).astype(np.int64), 1)
    alike = both[begins[pairs]] >= fuzzy.least * (size[begins[pairs]] + size[begins[pairs] + 1] - both[begins[pairs]])
    for x in begins[pairs][alike].tolist():
        if forest.join(node[x], node[x + 1]):
            yield x, x + 1
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b - a <= 2:
            continue
        rest, front = np.arange(a + 1, b), [a]
        while len(rest):
            if not front:
                front, rest = [int(rest[0])], rest[1:]
                continue
            x = front.pop()
            own, n_own, n_rest = hashes[first[x] : first[x] + size[x]], size[x], size[rest]
            fits = np.flatnonzero(fuzzy.least * np.maximum(n_own, n_rest) <= np.minimum(n_own, n_rest))
            if not len(fits):
                continue
            count = n_rest[fits]
            edge = np.cumsum(count) - count
            theirs = hashes[np.arange(int(count.sum())) + np.repeat(first[rest[fits]] - edge, count)]
            at = np.minimum(np.searchsorted(own, theirs), n_own - 1)
            common = np.add.reduceat(own[at] == theirs, edge, dtype=np.int64)
            joined = fits[common >= fuzzy.least * (n_own + count - common)]
            if len(joined):
                for y in rest[joined].tolist():
                    if forest.join(node[x], node[y]):
                        yield x, y
                front.extend(rest[joined].tolist())
                rest = np.delete(rest, joined)


def line_links(docs: DataFrame, seen: DataFrame, id_col: str, text_col: str, fuzzy: Fuzzy) -> DataFrame:
    """Links (a, b) between different lines, each by its whole digest (lo, hi); ``seen`` is ``occurrences`` as a table."""
    spark = docs.sparkSession
    keyed = seen.select(F.explode("keys").alias("key"), "lo").filter("key IS NOT NULL").repartition("key")  # one exchange, read twice
    shared = keyed.groupBy("key").agg(F.min("lo").alias("x"), F.max("lo").alias("y")).filter("x <> y").select("key")
    members = written(keyed.join(shared.hint("merge"), "key").select("key", "lo").distinct(), "line-buckets")
    alike = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("lo")).alias("s"), F.bit_xor(F.xxhash64("lo", F.lit(1))).alias("t"), F.min("lo").alias("x"))
    once = written(alike.groupBy("n", "s", "t", "x").agg(F.min("key").alias("key")).select("key", "n"), "line-buckets-once")
    chosen = members.join(once, "key")
    texts = written(_texts(docs, id_col, text_col, seen, chosen.select("lo").distinct()), "line-texts")
    blocks = F.ceil(F.col("n") / fuzzy.bucket_rows).cast("int")
    dealt = chosen.select("lo", "key", blocks.alias("k")).withColumn("own", F.pmod(F.xxhash64("lo"), F.col("k")).cast("int"))
    dealt = dealt.select("lo", "key", "own", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    dealt = dealt.select("lo", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")).join(texts, "lo")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "p", "q", "lo", "hi", "text").repartition(parts, "key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = _Forest()
        held: list[tuple] = []
        chars = 0

        def found(rows: list[tuple]) -> pa.RecordBatch:
            bucket = np.concatenate([[0], np.cumsum([x[0] != y[0] for x, y in zip(rows, rows[1:], strict=False)])])
            pairs = list(_linked(bucket, [r[2] for r in rows], [r[1] for r in rows], fuzzy, forest))
            ends = (pa.StructArray.from_arrays([pa.array([rows[p[k]][1][j] for p in pairs], pa.int64()) for j in (0, 1)], ["lo", "hi"]) for k in (0, 1))
            return pa.RecordBatch.from_arrays(list(ends), names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            nodes = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            for key, node, text in zip(keys, nodes, batch.column(5), strict=True):
                if (chars > 500_000 or len(held) > 8_000) and held[-1][0] != key:
                    yield found(held)
                    held, chars = [], 0
                held.append((key, node, text.as_py()))
                chars += len(held[-1][2])
        if held:
            yield found(held)

    return dealt.mapInArrow(tidied(run), "a struct<lo:long,hi:long>, b struct<lo:long,hi:long>")


def _decided(docs: DataFrame, id_col: str, text_col: str, fuzzy: Fuzzy) -> tuple[DataFrame, DataFrame]:
    """``occurrences`` as a table, and of each line _id, _row, _same, _line, keep (where the line that stays stands) and kept."""
    seen = written(occurrences(docs, id_col, text_col, fuzzy).withColumn("signed", F.size("keys") > 0), "lines")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_line").alias("line"), F.col("_row").alias("row"))
    first = seen.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(line_links(docs, seen, id_col, text_col, fuzzy))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    lines = written(first.join(roots, F.struct("lo", "hi") == F.col("node"), "left").select("hi", "lo", "n", "first", "root"), "line-components")
    similar = lines.filter("root IS NOT NULL")
    stay = similar.groupBy("root").agg(F.min("first").alias("keep"))
    named = similar.join(stay, "root").select("hi", "lo", "n", "keep").unionByName(lines.filter("root IS NULL AND n > 1").select("hi", "lo", "n", F.col("first").alias("keep")))
    named = written(named, "line-names")  # a line that isn't here stands once and is like no other
    # At most a thousand lines make up a thousandth of all each. They are broadcast, and their rows are spread in the join.
    often = F.col("n") * 1000 >= (lines.agg(F.sum("n")).first()[0] or 0)
    own = seen.select("hi", "lo", "_id", "_row", "_same", "_line").join(F.broadcast(named.filter(often).select("hi", "lo", F.col("keep").alias("_often"))), ["hi", "lo"], "left")
    own = own.withColumn("_hi", F.when(F.col("_often").isNull(), F.col("hi")).otherwise(F.xxhash64("_row", "_line")))
    others = named.filter(~often).select(F.col("hi").alias("_other_hi"), F.col("lo").alias("_other_lo"), F.col("keep").alias("_other"))
    own = own.join(others, F.col("_often").isNull() & (F.col("_hi") == F.col("_other_hi")) & (F.col("lo") == F.col("_other_lo")), "left")
    keep = F.coalesce("_often", "_other", place).alias("keep")
    stays = (F.col("_row") == F.col("keep")["row"]) & (F.col("_line") == F.col("keep")["line"])
    return seen, own.select("_id", "_row", "_same", "_line", keep).select("_id", "_row", "_same", "_line", "keep", stays.alias("kept"))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy: Fuzzy = Fuzzy()) -> DataFrame:
    """One row per line with a word: id, line_no (from 0), keep_id, keep_line_no, kept.

    Null and empty texts have no lines; an empty table gives an empty result. Rows with a null id come last among equal
    lines. Rows that share an id, or have none, are told apart: of each component one line of one row is kept. Only id
    and text are read.
    """
    _, decided = _decided(docs, id_col, text_col, fuzzy)
    return decided.select(F.col("_id").alias(id_col), F.col("_line").alias("line_no"), F.col("keep")["id"].alias("keep_id"), F.col("keep")["line"].alias("keep_line_no"), "kept")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fuzzy: Fuzzy = Fuzzy(), count_col: str | None = None, keep_emptied: bool = True) -> DataFrame:
    """``docs`` with the lines that stay, in order and as written; all other columns as they are (``count_col``, if named
    and there, becomes the new text's length). A null text stays null. A text that loses all lines with words becomes
    what blank lines it has, or its row goes unless ``keep_emptied``; rows without words to begin with stay. A line goes
    only from the row it was judged in; of rows equal in id and text one has the lines that stay."""

    def work(plain: DataFrame, id_col: str, text_col: str, *count: str) -> DataFrame:
        seen, decided = _decided(plain, id_col, text_col, fuzzy)
        worded = lambda line: F.length(F.translate(line, SPACES, "")) > 0
        # Rows are found again by id and text. Where several are equal in both, the first holds all that stays of them.
        copies = seen.select("_id", "_same", "_row").distinct().groupBy("_id", "_same").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
        copies = written(copies.filter("n > 1").select(F.col("_id").alias("_copy_id"), F.col("_same").alias("_copy_same"), "_first"), "row-copies")
        repeats = not copies.isEmpty()
        gone = decided.filter(~F.col("kept"))
        if repeats:
            on_copy = F.col("_id").eqNullSafe(F.col("_copy_id")) & (F.col("_same") == F.col("_copy_same"))
            gone = gone.join(copies, on_copy, "left").filter(F.col("_first").isNull() | (F.col("_row") == F.col("_first")))
        gone = written(gone.groupBy(F.col("_id").alias("_gone_id"), F.col("_same").alias("_gone_same")).agg(F.collect_set("_line").alias("_gone")), "dropped-lines")
        # What goes grows with the corpus: the join is shuffled at every size instead of changing its plan with it.
        hashed = plain.withColumn("_same", F.xxhash64(text_col))
        joined = hashed.join(gone.hint("merge"), F.col(id_col).eqNullSafe(F.col("_gone_id")) & (F.col("_same") == F.col("_gone_same")), "left")
        if repeats:
            on_copy = F.col(id_col).eqNullSafe(F.col("_copy_id")) & (F.col("_same") == F.col("_copy_same"))
            again = joined.join(copies, on_copy, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "_same").orderBy("_same")))
            lines = F.split(text_col, "\n")
            all_of = F.filter(F.transform(lines, lambda x, k: F.when(worded(x), k)), lambda k: k.isNotNull())
            again = again.withColumn("_gone", F.when(F.col("_n") > 1, all_of).otherwise(F.col("_gone"))).drop("_n")
            joined = joined.join(copies, on_copy, "left_anti").unionByName(again)
        rest = F.filter(F.split(text_col, "\n"), lambda _, k: ~F.array_contains("_gone", k))
        kept = joined.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n")))
        if not keep_emptied:
            kept = kept.filter(F.col("_gone").isNull() | worded(F.col(text_col)))
        return kept.withColumns({c: F.length(text_col).cast(plain.schema[c].dataType) for c in count})

    return plainly_named(docs, work, id_col, text_col, *([count_col] if count_col in docs.columns else []))
