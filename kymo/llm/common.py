"""What the operators share: the folder for intermediate tables, worker imports and small columns."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError, Py4JNetworkError
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: one space and the five control characters from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder of ``spark.checkpoint.dir``; a temporary one only where none is set, as in local tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="kymo-shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (the same path on every machine)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when its rows are through, what it freed goes back to the system.

    Workers live on through many stages, and the allocators would keep the most that any of them took.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return work


def give_back() -> None:
    """Freed memory of this process to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


_FOLDERS: dict[str, str] = {}


def own_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; it goes when the driver's Python ends."""
    key = spark.sparkContext.applicationId + shared_dir(spark)
    if key not in _FOLDERS:
        _FOLDERS[key] = f"{shared_dir(spark)}/kymo-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[key])
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(_remove, system, path)
    return _FOLDERS[key]


def _remove(system, path) -> None:
    with contextlib.suppress(Py4JError, Py4JNetworkError, OSError):  # the JVM may be gone
        system.delete(path, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, and a lost executor costs only a new read."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def put_bytes(spark: SparkSession, data: bytes, what: str) -> str:
    """Write ``data`` as one file in the shared folder and hand it to every executor; the name for SparkFiles.get."""
    name = f"{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{own_folder(spark)}/{name}")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    spark.sparkContext.addFile(path.toString())
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bit_table(wanted: DataFrame, column: str) -> tuple[str, int]:
    """A bit for each value of a long column, in a table of at most 16 MB whatever the input, handed to the executors.

    It spares a shuffle of rows that surely have no partner; the join behind it decides.
    """
    n = max(wanted.count(), 1)
    slots = min(1 << 27, max(64, 1 << (64 * n - 1).bit_length()))
    slot = F.pmod(F.col(column), F.lit(slots))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    words = wanted.select(F.shiftright(slot, 6).alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(slots // 64, np.int64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy()
    return put_bytes(wanted.sparkSession, bits.tobytes(), "bits"), slots


def maybe_in(found: tuple[str, int], values: np.ndarray) -> np.ndarray:
    """On an executor: False where a value surely isn't in the table."""
    name, slots = found
    bits = np.memmap(SparkFiles.get(name), dtype="<u8", mode="r")
    slot = values % slots
    return (bits[slot // 64] >> (slot % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def _cut(rows: DataFrame, column: str, most: int) -> tuple[int, int]:
    """The largest x such that more than ``most`` rows have ``column`` >= x, and how many have more than x.

    ``column`` holds numbers from 0; a round of at most 1024 counts reaches the driver, and few rounds do.
    """
    top = rows.agg(F.max(column)).first()[0] or 0
    low, high, held = 0, top, 0
    step = 1 if top < 1024 else None
    while True:
        if step is None:  # most rows are small: one count each below 1023, then equal ranges
            place = F.least(F.col(column), F.lit(1023))
        else:
            place = F.floor((F.col(column) - low) / F.lit(step)).cast("long")
        found = rows.filter(F.col(column).between(low, high)).groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for p, n in sorted(((r["p"], r["n"]) for r in found), reverse=True):
            if held + n > most:
                break
            held += n
        if step is None and p < 1023:
            return p, held
        if step is not None:
            if step == 1:
                return low + p, held
            low, high = low + p * step, min(high, low + (p + 1) * step - 1)
        else:
            low = 1023
        step = max(1, -(-(high - low + 1) // 1024))


def most_frequent(counts: DataFrame, word: str, n: str, most: int) -> list[tuple]:
    """Exactly ``most`` (word, n) of the rows (all, where there are no more): the highest n first, among equal n by a hash of
    the word, then by the word. No more than these rows and their hash ties reach the driver. ``n`` is never null or under 0."""
    rows = counts.select(F.col(word).alias("word"), F.col(n).cast("long").alias("n"), F.xxhash64(word).bitwiseAND(F.lit((1 << 50) - 1)).alias("h"))
    if most < 1:
        return []
    if rows.count() <= most:
        taken, tied = rows, []
    else:
        least, held = _cut(rows, "n", most)
        taken, ties = rows.filter(F.col("n") > least), rows.filter(F.col("n") == least)
        tied = []
        if held < most:
            edge, more = _cut(ties, "h", most - held)
            taken = taken.union(ties.filter(F.col("h") > edge))
            tied = sorted(r["word"] for r in ties.filter(F.col("h") == edge).collect())[: most - held - more]
            tied = [(w if isinstance(w, str) else bytes(w), least) for w in tied]
    found = [(r["word"] if isinstance(r["word"], str) else bytes(r["word"]), r["n"]) for r in taken.select("word", "n").collect()]
    return found + tied


def plainly_named(docs: DataFrame, work, *names: str) -> DataFrame:
    """``work(renamed docs, *renamed names)`` on columns c0, c1, ..., so that no name of ``docs`` clashes with one inside;
    the result has those columns and gets the old names back."""
    columns = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    return work(plain, *(f"c{columns.index(n)}" for n in names)).select(*plain.columns).toDF(*columns)
