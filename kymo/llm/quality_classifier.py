"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

``score = w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)``, through a logistic function: pairwise
interactions of all features in time linear in their number. It is fitted on a bounded sample of labelled rows
(``Settings.most_rows``) and scores every whole text. Language, source, id and labels are never features; the metadata is
what the text itself shows (its length and shape).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import plainly_named, put_bytes, text_or_empty, tidied
from kymo.llm.license_scan import grams, word_hashes

#: Bytes of words: all but the space and the control characters from tab to carriage return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False

_CLASSES = [re.compile(x) for x in (rb"[#*$%&<>]", rb"[A-Z]", rb"[A-Za-z]", rb"[0-9]", rb"!", rb"\|", rb"\n", rb"[.,;:?]", rb"[\x80-\xff]")]
BYTE_CLASSES = np.array([[bool(c.match(bytes([b]))) for b in range(256)] for c in _CLASSES], np.uint8)
N_STATISTICS = 15


@dataclass(frozen=True)
class Settings:
    most_rows: int = 12_000  # of labelled rows that are fitted
    buckets: int = 1 << 16
    rank: int = 8
    epochs: int = 12
    batch: int = 128
    rate: float = 0.15
    decay: float = 1e-5
    seed: int = 7
    threshold: float = 0.3


def held_out(id_col: Column) -> Column:
    """Rows that never teach: crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share of the text's words) for each distinct bucket of a text, and statistics per text."""
    n = len(texts)
    hashes, counts = word_hashes([t.lower() for t in texts], NOT_SPACE)
    text = np.repeat(np.arange(n), counts)
    words = np.maximum(counts, 1)
    key, first, times = np.unique(text << 32 | (hashes % np.uint64(buckets)).astype(np.int64), return_index=True, return_counts=True)
    row, bucket = key >> 32, key & 0xFFFFFFFF
    share = times / words[row]
    size = np.fromiter(map(len, texts), np.int64, n)
    buf = np.frombuffer(b"\0".join(texts) + b"\0", "u1")
    start = np.cumsum(size + 1) - size - 1
    per = np.stack([np.add.reduceat(c[buf], start, dtype=np.int64) for c in BYTE_CLASSES], 1).astype(float)
    letters = np.maximum(per[:, 2], 1)
    same = np.zeros(n)
    triple = np.ones(n)
    if len(hashes) > 2:
        pair = np.flatnonzero((hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1]))
        same = np.bincount(text[pair], minlength=n) / words
        g = grams(hashes, 3)
        on = text[: len(g)] == text[2:]
        kinds = np.unique((text[: len(g)][on].astype(np.uint64) << np.uint64(40)) ^ (g[on] >> np.uint64(24)))
        triple = np.bincount((kinds >> np.uint64(40)).astype(np.int64), minlength=n)[:n] / np.maximum(counts - 2, 1)
        triple[counts < 3] = 1.0
    top = np.zeros(n)
    np.maximum.at(top, row, share)
    distinct = np.bincount(row, minlength=n) / words
    statistics = np.stack(
        [np.log1p(counts), np.log1p(size), size / words, per[:, 0] / words, per[:, 1] / letters, per[:, 3] / np.maximum(size, 1), per[:, 4] / words, per[:, 5] / words,
         per[:, 6] / words, per[:, 7] / words, per[:, 8] / np.maximum(size, 1), same, triple, top, distinct], 1,
    )
    return row, bucket, share, statistics


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def to_bytes(self) -> bytes:
        out = BytesIO()
        np.savez(out, w0=self.w0, w=self.w, v=self.v, mean=self.mean, scale=self.scale)
        return out.getvalue()

    @classmethod
    def load(cls, path: str) -> Machine:
        got = np.load(path)
        return cls(float(got["w0"]), got["w"], got["v"], got["mean"], got["scale"])

    @property
    def buckets(self) -> int:
        return len(self.w) - N_STATISTICS

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) with the statistics as features behind the buckets, sorted by text."""
        row, bucket, share, statistics = features(texts, self.buckets)
        shown = np.clip((statistics - self.mean) / self.scale, -4, 4)
        n = len(texts)
        all_rows = np.concatenate([row, np.repeat(np.arange(n), N_STATISTICS)])
        feature = np.concatenate([bucket, np.tile(self.buckets + np.arange(N_STATISTICS), n)])
        value = np.concatenate([np.sqrt(share), shown.ravel() / np.sqrt(N_STATISTICS)])
        order = np.argsort(all_rows, kind="stable")
        return all_rows[order], feature[order], value[order].astype(np.float32)

    def margin(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums v_f x by text."""
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        vx = self.v[feature] * value[:, None]
        total = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), first)
        return self.w0 + np.add.reduceat(self.w[feature] * value, first) + 0.5 * ((total**2).sum(1) - squares), total

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        margin, _ = self.margin(*self.rows(texts))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _moments(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each statistic."""
    statistics = np.concatenate([features(texts[a : a + 500], buckets)[3] for a in range(0, len(texts), 500)])
    return statistics.mean(0), statistics.std(0) + 1e-6


def fit(texts: list[bytes], labels: np.ndarray, settings: Settings = Settings()) -> Machine:
    """Adagrad on the logistic loss. Without rows of both labels only the smoothed base rate is learnt."""
    rng = np.random.default_rng(settings.seed)
    size = settings.buckets + N_STATISTICS
    base = (labels.sum() + 1) / (len(labels) + 2)
    model = Machine(float(np.log(base / (1 - base))), np.zeros(size, np.float32), rng.normal(0, 0.02, (size, settings.rank)).astype(np.float32), np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    if len(set(labels.tolist())) < 2:
        model.v[:] = 0
        return model
    # No labelled row need be empty; a hundredth of empty texts teaches that they are no good ones.
    empty = len(texts) // 100 + 1
    texts, labels = [*texts, *[b""] * empty], np.concatenate([labels, np.zeros(empty)])
    model.mean, model.scale = _moments(texts, settings.buckets)
    found = []
    for a in range(0, len(texts), 500):  # in narrow types: the driver holds features of all fitted rows
        row, feature, value = model.rows(texts[a : a + 500])
        found.append(((row + a).astype(np.int32), feature.astype(np.int32), value))
    row, feature, value = (np.concatenate([f[j] for f in found]) for j in range(3))
    del found
    start = np.searchsorted(row, np.arange(len(texts) + 1))
    good = labels.mean()
    weight = np.where(labels > 0.5, 0.5 / good, 0.5 / (1 - good))  # both labels weigh alike
    model.w0 = 0.0
    gw, gv, g0 = np.full(size, 1e-3, np.float32), np.full((size, settings.rank), 1e-3, np.float32), 1e-3
    for _ in range(settings.epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(texts), settings.batch):
            take = order[a : a + settings.batch]
            count = start[take + 1] - start[take]
            at = np.arange(count.sum()) + np.repeat(start[take] - (np.cumsum(count) - count), count)
            own, f, x = np.repeat(np.arange(len(take)), count), feature[at], value[at]
            margin, total = model.margin(own, f, x)
            slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[take]) * weight[take] / len(take)).astype(np.float32)
            by = np.argsort(f, kind="stable")
            f, x, own = f[by], x[by], own[by]
            first = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            which = f[first]
            dw = np.add.reduceat(slope[own] * x, first) + settings.decay * model.w[which]
            dv = np.add.reduceat((slope[own] * x)[:, None] * (total[own] - model.v[f] * x[:, None]), first, axis=0) + settings.decay * model.v[which]
            gw[which] += dw**2
            gv[which] += dv**2
            g0 += float(slope.sum()) ** 2
            model.w[which] -= settings.rate * dw / np.sqrt(gw[which])
            model.v[which] -= settings.rate * dv / np.sqrt(gv[which])
            model.w0 -= settings.rate * float(slope.sum()) / g0**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings = Settings()) -> Machine:
    """Fit on labelled rows that aren't held out, at most about ``most_rows`` of them, taken by a hash of the id.

    Rows with a null label don't count; an id with several labels has the smallest; a null text counts as empty.
    """
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_label"))
    share = min(1.0, settings.most_rows / max(own.count(), 1))
    chosen = own.filter(F.pmod(F.xxhash64("_id", F.lit(settings.seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
    # About most_rows rows of an id and a label: the bound of what is broadcast here and collected below.
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).join(F.broadcast(chosen), "_id").toArrow()
    order = np.argsort([hash_of.as_py() for hash_of in rows["_id"]], kind="stable") if len(rows) else []
    texts = [rows["_text"][int(k)].as_py().encode("utf-8", "surrogatepass") for k in order]
    marks = rows["_label"].to_numpy().astype(float)[order] if len(rows) else np.zeros(0)
    del rows
    return fit(texts, marks, settings)


@lru_cache(maxsize=2)
def _loaded(name: str) -> Machine:
    return Machine.load(SparkFiles.get(name))


def _scored(docs: DataFrame, model: Machine, text: str, rest: list[str], settings: Settings) -> DataFrame:
    """``rest`` columns with score; the text passes by blocks of bounded size."""
    name = put_bytes(docs.sparkSession, model.to_bytes(), "machine")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _loaded(name)
        for batch in batches:
            scores, held, size = [], [], 0
            for t in batch.column(len(rest)):
                held.append((t.as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size > 500_000:
                    scores.append(machine.score(held))
                    held, size = [], 0
            scores.append(machine.score(held))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(np.concatenate(scores).astype(float))], names=[*map(str, range(len(rest))), "score"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").alias("_kymo_text")).mapInArrow(tidied(run), f"{kinds}, score double")


def scored(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score, predicted. Null text counts as empty; an empty text is scored by
    its statistics. Repeated rows and null ids stay; an empty table gives an empty result."""
    found = _scored(docs, model, text_col, [id_col], settings)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with their columns. Every row is judged by its own text: a null text as an
    empty one, repeated rows and null ids each for itself. An empty table gives an empty result."""
    return plainly_named(docs, lambda plain, _, text: _scored(plain, model, text, plain.columns, settings).filter(F.col("score") >= settings.threshold), id_col, text_col)
