"""Scores of a gated recurrent language model in numpy, beside an add-one unigram score.

Tokens are words (ASCII lower case, parted by ASCII white space) and one end per text. A GRU reads the words so far; the
output softmax is factored by classes: first the class, then the word within it. ``frequent`` words have classes of their
own by falling count; the others fall into ``rare`` classes by their last two bytes, within which a word has its smoothed
share of the training tokens. So every word has a probability, seen or not, and all of them sum to one.

Counts are taken over all training texts. The network gets a warm start on a bounded sample on the driver; then shards,
dealt and ordered by a hash of id and text and as many as the training tokens ask for, train it further on all their texts
by truncated backpropagation, with the state carried from window to window, and the results are averaged by tokens in a
tree. So scores depend on the rows alone, not on how files or partitions hold them. Texts are scored whole: windows bound the memory, and the state
passes through them to the end of the text.

Counts of at most ``known`` frequent words are broadcast; the other words of a text meet their counts by a join.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby, repeat

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import most_frequent, put_bytes, text_or_empty, written

#: Stands for the end of a text among the words; no word has a space.
END = b" "
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Settings:
    frequent: int = 1024
    members: int = 32  # words of a class
    rare: int = 32
    hidden: int = 16
    window: int = 32
    streams: int = 512
    known: int = 200_000
    warm_texts: int = 1_500
    warm_bytes: int = 100_000  # longer texts aren't in the warm start's sample; the shards train on them
    shard_tokens: int = 2_500_000  # a shard's training tokens, while that makes no more than most_shards
    most_shards: int = 65_536
    warm_epochs: int = 2
    rate: float = 0.08
    clip: float = 0.05
    chunk_tokens: int = 2_000_000
    seed: int = 5


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 7, is 2. A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-2:]) % rare


class Vocabulary:
    """The broadcast words with their counts, the END first, then by falling count; ids beyond them are rare."""

    def __init__(self, words: list[bytes], counts: np.ndarray, rare_tokens: np.ndarray, rare_words: np.ndarray, tokens: int, kinds: int, s: Settings):
        self.settings, self.tokens, self.kinds = s, tokens, kinds
        self.index = {w: k for k, w in enumerate(words)}
        self.log_count = np.log10(counts + 1.0)
        self.count = counts
        classes = np.fromiter((rare_class(w, s.rare) for w in words), np.int32, len(words))
        #: What the network sees of each known word: itself, or its rare class.
        self.unit = np.where(np.arange(len(words)) < s.frequent, np.arange(len(words)), s.frequent + classes).astype(np.int32)
        self.rare_share = np.log10(rare_tokens + rare_words + 1.0)
        self.rare_tokens = rare_tokens
        self.n_units = s.frequent + s.rare
        self.n_classes = s.frequent // s.members + s.rare

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(units with the END, ids of known words with the END, words that aren't broadcast)."""
        words = words_of(text)
        get = self.index.get
        ids = np.zeros(len(words) + 1, np.int64)  # the END has id 0
        ids[:-1] = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(ids < 0)
        units = self.unit[ids]
        if not len(missing):
            return units, ids, []
        other = [words[k] for k in missing.tolist()]
        s = self.settings
        units[missing] = [s.frequent + rare_class(w, s.rare) for w in other]
        return units, ids[ids >= 0], other


class Network:
    """Parameters as float32 arrays by name, and windows forth and back."""

    NAMES = ("table", "u", "wc", "bc", "wm", "bm")

    def __init__(self, p: dict[str, np.ndarray], s: Settings):
        self.p, self.s = p, s
        self.n_frequent_classes = s.frequent // s.members

    @classmethod
    def new(cls, vocab: Vocabulary) -> Network:
        s = vocab.settings
        rng = np.random.default_rng(s.seed)
        h, f = s.hidden, np.float32
        counts = np.zeros(s.frequent)
        own = vocab.count[: s.frequent]
        counts[: len(own)] = own
        by_class = np.concatenate([counts.reshape(-1, s.members).sum(1), vocab.rare_tokens]) + 1.0
        member = np.log(np.where(np.arange(s.frequent) < len(own), counts + 1.0, 1e-9))
        return cls(
            {
                "table": rng.normal(0, 0.3, (vocab.n_units + 1, 3 * h)).astype(f),  # the last is the start of a text
                "u": rng.normal(0, 0.25, (3 * h, h)).astype(f),
                "wc": rng.normal(0, 0.05, (vocab.n_classes, h)).astype(f),
                "bc": np.log(by_class / by_class.sum()).astype(f),
                "wm": rng.normal(0, 0.05, (s.frequent, h)).astype(f),
                "bm": (member - np.repeat(np.log(np.exp(member).reshape(-1, s.members).sum(1)), s.members)).astype(f),
            },
            s,
        )

    def forward(self, seen: np.ndarray, state: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
        """``seen`` (window, streams): units; states and gates of every step. ``start``: steps at which a text begins."""
        h = self.s.hidden
        w, b = seen.shape
        gx = np.ascontiguousarray(self.p["table"].T)[:, seen.ravel()].reshape(3 * h, w, b)
        u = self.p["u"]
        states = np.empty((w + 1, h, b), np.float32)
        states[0] = state
        before = np.empty((w, h, b), np.float32)
        gates = np.empty((w, 2 * h, b), np.float32)
        new, inner = np.empty((w, h, b), np.float32), np.empty((w, h, b), np.float32)
        any_start = start.any(axis=1)
        for t in range(w):
            old = states[t]
            if any_start[t]:
                old = old * ~start[t]
            before[t] = old
            a = u @ old
            g = gates[t]
            np.add(gx[: 2 * h, t], a[: 2 * h], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)  # may overflow; its reciprocal is 0 then
            g += 1
            np.reciprocal(g, out=g)
            inner[t] = a[2 * h :]
            n = new[t]
            np.multiply(g[h:], inner[t], out=n)
            n += gx[2 * h :, t]
            np.tanh(n, out=n)
            o = states[t + 1]
            np.subtract(old, n, out=o)
            o *= g[:h]
            o += n
        return states, before, gates, new, inner

    def output(self, flat: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets (units, -1 where there is none) for states (hidden, n); with ``grads``
        also the slope of the mean loss at the states."""
        s, p = self.s, self.p
        n = flat.shape[1]
        there = target >= 0
        cls = np.where(target < s.frequent, target // s.members, self.n_frequent_classes + target - s.frequent)
        cls[~there] = 0
        out = np.empty(n)
        scale = np.float32(1 / max(int(there.sum()), 1))
        slope = None if grads is None else np.empty_like(flat)
        back_c = np.ascontiguousarray(p["wc"].T)
        for a in range(0, n, 1024):  # what is worked on stays in the cache
            x, c, on = np.ascontiguousarray(flat[:, a : a + 1024]), cls[a : a + 1024], there[a : a + 1024]
            at = np.arange(len(c))
            logit = p["wc"] @ x
            logit += p["bc"][:, None]
            if not -60 < logit.min() <= logit.max() < 60:
                logit -= logit.max(axis=0)
            own = logit[c, at]
            np.exp(logit, out=logit)
            total = logit.sum(axis=0)
            out[a : a + 1024] = np.where(on, own - np.log(total), 0.0)
            if grads is not None:
                logit *= on * scale / total
                logit[c, at] -= on * scale
                grads["wc"] += logit @ x.T
                grads["bc"] += logit.sum(axis=1)
                slope[:, a : a + 1024] = back_c @ logit
        some = np.flatnonzero(there & (target < s.frequent))
        some = some[np.argsort(cls[some].astype(np.int16), kind="stable")]
        edges = np.searchsorted(cls[some], np.arange(self.n_frequent_classes + 1))
        picked = flat[:, some]
        back = np.empty_like(picked) if grads is not None else None
        for c in range(self.n_frequent_classes):
            a, b = int(edges[c]), int(edges[c + 1])
            if a == b:
                continue
            rows = slice(c * s.members, (c + 1) * s.members)
            x = picked[:, a:b]
            inner = p["wm"][rows] @ x
            inner += p["bm"][rows, None]
            if not -60 < inner.min() <= inner.max() < 60:
                inner -= inner.max(axis=0)
            member = target[some[a:b]] - c * s.members
            k = np.arange(b - a)
            own = inner[member, k]
            np.exp(inner, out=inner)
            total = inner.sum(axis=0)
            out[some[a:b]] += own - np.log(total)
            if grads is not None:
                inner *= scale / total
                inner[member, k] -= scale
                grads["wm"][rows] += inner @ x.T
                grads["bm"][rows] += inner.sum(axis=1)
                back[:, a:b] = p["wm"][rows].T @ inner
        if grads is not None:
            slope[:, some] += back
        return out, slope

    def backward(self, seen: np.ndarray, start: np.ndarray, kept: tuple[np.ndarray, ...], slope: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        h = self.s.hidden
        _, before, gates, new, inner = kept
        w, b = seen.shape
        z, r = gates[:, :h], gates[:, h:]
        to_new = (1 - z) * (1 - new * new)  # slopes of each step's state, for all steps at once
        to_z = (before - new) * z * (1 - z)
        to_r = inner * r * (1 - r)
        dx, dn_r = np.empty((w, 3 * h, b), np.float32), np.empty((w, h, b), np.float32)
        d = np.zeros((h, b), np.float32)
        ut = np.ascontiguousarray(self.p["u"].T)
        gates_t, new_t = np.ascontiguousarray(ut[:, : 2 * h]), np.ascontiguousarray(ut[:, 2 * h :])
        slope = np.ascontiguousarray(slope.transpose(1, 0, 2))
        begins = start.any(axis=1)
        for t in range(w - 1, -1, -1):
            d += slope[t]
            own = dx[t]
            np.multiply(d, to_z[t], out=own[:h])
            dn = np.multiply(d, to_new[t], out=own[2 * h :])
            np.multiply(dn, to_r[t], out=own[h : 2 * h])
            np.multiply(dn, r[t], out=dn_r[t])
            d *= z[t]
            d += gates_t @ own[: 2 * h]
            d += new_t @ dn_r[t]
            if begins[t]:
                d *= ~start[t]
        flat = before.transpose(1, 0, 2).reshape(h, -1).T
        grads["u"][: 2 * h] += dx[:, : 2 * h].transpose(1, 0, 2).reshape(2 * h, -1) @ flat
        grads["u"][2 * h :] += dn_r.transpose(1, 0, 2).reshape(h, -1) @ flat
        units = seen.ravel()
        order = np.argsort(units.astype(np.int16) if units.max(initial=0) < 32_000 else units, kind="stable")
        units = units[order]
        first = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1]]))
        rows = dx.transpose(0, 2, 1).reshape(w * b, 3 * h)
        grads["table"][units[first]] += np.add.reduceat(rows[order], first, axis=0)

    @np.errstate(over="ignore")
    def train(self, texts: list[np.ndarray], memory: dict[str, np.ndarray]) -> None:
        """One pass of Adagrad over the texts, truncated at windows; ``memory`` holds the squares so far."""
        for seen, start, target, state, _ in windows(texts, self.s, self.p["table"].shape[0] - 1):
            grads = {k: np.zeros_like(v) for k, v in self.p.items()}
            kept = self.forward(seen, state.now, start)
            state.now = kept[0][-1]
            flat = kept[0][1:].transpose(1, 0, 2).reshape(self.s.hidden, -1)
            _, slope = self.output(flat, target.ravel(), grads)
            self.backward(seen, start, kept, slope.reshape(self.s.hidden, *seen.shape), grads)
            for k, g in grads.items():
                norm = float(np.sqrt((g * g).sum()))
                if norm > self.s.clip:
                    g *= self.s.clip / norm
                memory[k] += g * g
                self.p[k] -= self.s.rate * g / np.sqrt(memory[k])

    @np.errstate(over="ignore")
    def log10(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each whole text; the state goes through all its windows."""
        out = np.zeros(len(texts))
        for seen, start, target, state, owner in windows(texts, self.s, self.p["table"].shape[0] - 1):
            states = self.forward(seen, state.now, start)[0]
            state.now = states[-1]
            got, _ = self.output(states[1:].transpose(1, 0, 2).reshape(self.s.hidden, -1), target.ravel(), None)
            on = owner.ravel() >= 0
            out += np.bincount(owner.ravel()[on], got[on], minlength=len(texts))
        return out / LN10


class _State:
    def __init__(self, now: np.ndarray):
        self.now = now


def windows(texts: list[np.ndarray], s: Settings, start_unit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, _State, np.ndarray]]:
    """Texts laid end to end in ``streams`` of like length, and cut into windows: units seen, starts, targets, the state
    to carry, and each target's text. Streams that have ended leave the later windows."""
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    if not order:
        return
    n = min(s.streams, len(order))
    heap = [(0, k) for k in range(n)]
    streams: list[list[int]] = [[] for _ in range(n)]
    for k in order:
        size, j = heapq.heappop(heap)
        streams[j].append(k)
        heapq.heappush(heap, (size + len(texts[k]), j))
    sizes = [sum(len(texts[k]) for k in x) for x in streams]
    by_size = sorted(range(n), key=lambda j: -sizes[j])
    target = [np.concatenate([texts[k] for k in streams[j]]).astype(np.int32) for j in by_size]
    owners = [np.repeat(np.array(streams[j], np.int32), [len(texts[k]) for k in streams[j]]) for j in by_size]
    begin = [np.cumsum([0, *(len(texts[k]) for k in streams[j])])[:-1] for j in by_size]
    lengths = np.array([sizes[j] for j in by_size])
    state = _State(np.zeros((s.hidden, n), np.float32))
    block = 32 * s.window  # laid out at once
    before = np.full(n, start_unit, np.int32)
    for base in range(0, int(lengths[0]), block):
        live = int(np.searchsorted(-lengths, -base, side="left"))
        want, owner = np.full((block, live), -1, np.int32), np.full((block, live), -1, np.int32)
        starts = np.zeros((block, live), bool)
        for j in range(live):
            part = target[j][base : base + block]
            want[: len(part), j] = part
            owner[: len(part), j] = owners[j][base : base + block]
            a, b = np.searchsorted(begin[j], (base, base + block))
            starts[begin[j][a:b] - base, j] = True
        seen = np.concatenate([before[None, :live], want[:-1]])
        seen[starts | (seen < 0)] = start_unit
        before = want[-1]
        for at in range(0, min(block, int(lengths[0]) - base), s.window):
            on = int(np.searchsorted(-lengths, -(base + at), side="left"))
            rows = slice(at, at + s.window)
            state.now = state.now[:, :on]
            yield seen[rows, :on], starts[rows, :on], want[rows, :on].astype(np.int64), state, owner[rows, :on]


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(w binary, c long) over all texts of ``docs``, ends included; each task counts before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"w": pa.array(list(seen), pa.binary()), "c": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text.as_py()))
                seen[END] += 1
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """What is broadcast: the ``known`` most frequent words of those up to 64 bytes, and the END; sums of the rest."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    got = most_frequent(counts.filter((F.octet_length("w") <= 64) & (F.col("w") != F.lit(bytearray(END)))), "w", "c", s.known)
    got.sort(key=lambda x: (-x[1], x[0]))
    end = counts.filter(F.col("w") == F.lit(bytearray(END))).select("c").collect()
    got = [(END, end[0]["c"] if end else 0), *got]
    cls = F.pmod(F.crc32(F.expr("substring(w, -2, 2)")), F.lit(s.rare)).cast("int")
    rare_n, rare_v = np.zeros(s.rare), np.zeros(s.rare)
    for r in counts.groupBy(cls.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        rare_n[r["k"]], rare_v[r["k"]] = r["n"], r["v"]
    for w, c in got[: s.frequent]:
        if c:
            k = rare_class(w, s.rare)
            rare_n[k] -= c
            rare_v[k] -= 1
    return Vocabulary([w for w, _ in got], np.array([c for _, c in got], float), rare_n, rare_v, int(total["n"] or 0), int(total["v"] or 0), s)


@lru_cache(maxsize=2)
def _unpickled(name: str):
    with open(SparkFiles.get(name), "rb") as f:
        return pickle.load(f)


def _chunks(texts: Iterator[tuple[int, str]], vocab: Vocabulary, s: Settings):
    """Lists of (row, units, ids, other words), each of about ``chunk_tokens`` tokens."""
    held, size = [], 0
    for row, text in texts:
        got = vocab.read(text)
        held.append((row, *got))
        size += len(got[0])
        if size >= s.chunk_tokens:
            yield held
            held, size = [], 0
    if held:
        yield held


def _averaged(found: DataFrame) -> list:
    """Weighted means of the shards' parameters: first in 16 tasks, in order of shards, then of those on the driver."""

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight, first = None, 0.0, 0
        for batch in batches:
            for shard, blob, w in zip(*(batch.column(k) for k in range(3)), strict=True):
                x, w = np.frombuffer(blob.as_py(), np.float32).astype(float), w.as_py()
                first = shard.as_py() if total is None else first
                total, weight = (x * w if total is None else total + x * w), weight + w
        if total is not None:
            yield pa.record_batch({"shard": pa.array([first], pa.int32()), "blob": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), "weight": pa.array([weight])})

    spread = found.repartition(16, F.pmod("shard", F.lit(16))).sortWithinPartitions("shard")
    return sorted(spread.mapInArrow(mean, "shard int, blob binary, weight double").collect(), key=lambda r: r["shard"])


def train(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> Network:
    """``docs``: the training texts."""
    s = vocab.settings
    spark = docs.sparkSession
    net = Network.new(vocab)
    memory = {k: np.full_like(v, 1e-6) for k, v in net.p.items()}
    n = docs.count()
    near = F.pmod(F.xxhash64(F.lit(s.seed), id_col), F.lit(1 << 20))
    sample = docs.filter((near < int(min(1.0, s.warm_texts / max(n, 1)) * (1 << 20))) & (F.octet_length(text_or_empty(text_col)) <= s.warm_bytes)).select(near.alias("k"), text_or_empty(text_col).alias("t"))
    warm = [vocab.read(r["t"])[0] for r in sorted(sample.collect(), key=lambda r: (r["k"], r["t"]))]
    for _ in range(s.warm_epochs):
        for a in range(0, len(warm), 500):
            net.train(warm[a : a + 500], memory)
    name = put_bytes(spark, pickle.dumps((vocab, net.p, memory)), "lm-start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, start, memory = _unpickled(name)

        def trained(texts: Iterator[str]) -> tuple[bytes, float]:
            own, squares = Network({k: v.copy() for k, v in start.items()}, s), {k: v.copy() for k, v in memory.items()}
            tokens = 0
            for part in _chunks(((0, t) for t in texts), vocab, s):
                own.train([x[1] for x in part], squares)
                tokens += sum(len(x[1]) for x in part)
            return np.concatenate([own.p[k].ravel() for k in Network.NAMES]).astype(np.float32).tobytes(), float(tokens)

        rows = ((k.as_py(), t) for batch in batches for k, t in zip(batch.column(0), batch.column(1), strict=True))
        for shard, own in groupby(rows, key=lambda r: r[0]):
            blob, tokens = trained(t.as_py() for _, t in own)
            yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "blob": pa.array([blob], pa.binary()), "weight": pa.array([tokens])})

    shards = max(1, min(s.most_shards, -(-vocab.tokens // s.shard_tokens)))
    place = F.xxhash64(F.lit(s.seed + 1), id_col, text_col)
    dealt = docs.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), text_or_empty(text_col).alias("t"))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "place").select("shard", "t")
    got = _averaged(dealt.mapInArrow(run, "shard int, blob binary, weight double"))
    if got:
        whole = sum(r["weight"] for r in got)
        mean = sum(np.frombuffer(bytes(r["blob"]), np.float32).astype(float) * (r["weight"] / whole) for r in got).astype(np.float32)
        at = 0
        for k in Network.NAMES:
            net.p[k] = mean[at : at + net.p[k].size].reshape(net.p[k].shape)
            at += net.p[k].size
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Texts whose id's ``held_out`` is false are learnt from. Null text counts as empty: one token, the end. Repeated rows
    and null ids are rows of their own; an empty table gives an empty result; without training texts all words are
    unseen. Only id and text are read.
    """
    s = settings
    spark = docs.sparkSession
    teaching = docs.select(F.col(id_col), F.col(text_col)).filter(~held_out(F.col(id_col)))
    counts = written(token_counts(teaching, text_col), "token-counts")
    vocab = vocabulary(counts, s)
    net = train(teaching, vocab, id_col, text_col)
    name = put_bytes(spark, pickle.dumps((vocab, net.p)), "lm")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = _unpickled(name)
        own = Network(p, s)
        for batch in batches:
            for part in _chunks(((k, t.as_py()) for k, t in enumerate(batch.column(1))), vocab, s):
                model = own.log10([x[1] for x in part])
                rows, tokens, known, base, extra, words, times = [], [], [], [], [], [], []
                for row, units, ids, other in part:
                    rare = units[units >= s.frequent] - s.frequent
                    log = vocab.log_count[ids]
                    own_rare = log[ids >= s.frequent].sum() - vocab.rare_share[rare].sum()
                    seen = Counter(other)
                    rows.append(row)
                    tokens.append(len(units))
                    known.append(int((vocab.count[ids] > 0).sum()))
                    base.append(float(log.sum()))
                    extra.append(float(own_rare))
                    words.append(list(seen))
                    times.append(list(seen.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model + np.array(extra)), pa.array(words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                    names=["i", "n", "known", "base", "model", "words", "times"],
                )

    schema = f"i {kind}, n long, known long, base double, model double, words array<binary>, times array<long>"
    found = docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, schema)
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = found.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnsRenamed({"words": "w", "times": "k"})
    sums = rare.join(counts, "w").groupBy("row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more"), F.sum("k").alias("also"))
    out = found.select("row", "i", "n", "known", "base", "model").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("i").alias(id_col),
        held_out(F.col("i")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n") * float(np.log10(vocab.tokens + vocab.kinds + 1))).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )
