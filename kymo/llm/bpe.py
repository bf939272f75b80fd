"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Words are counted over all documents; the frequent ones, with the ids that the tokenizer file's merges give them, become
a minimal acyclic automaton whose transitions carry outputs. The sum of the outputs on a word's path is its place in a
table of id sequences. The automaton is one file, which executors memory-map. Words that it doesn't hold are merged
exactly by the same merges.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import most_frequent, put_bytes, text_or_empty, written

#: Characters that str.split() takes as white space and the tokenizer doesn't.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
_SURE_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")


def byte_alphabet() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """The exact encoder of one word: the file's normalizer and splitting, then its merges in order of rank."""

    def __init__(self, tokenizer_file: str, cache: int = 100_000):
        import regex
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else lambda s: [s]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {self.vocab[a] << 20 | self.vocab[b]: (k, self.vocab[a + b]) for k, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        self.inner = [self.vocab[alphabet[b]] for b in range(256)]
        self.last = [self.vocab[alphabet[b] + self.suffix] for b in range(256)]
        whole = Tokenizer.from_file(tokenizer_file)
        self.normalizer, self.pre_tokenizer = whole.normalizer, whole.pre_tokenizer
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces_of_latin = regex.compile(split).findall
        self.byte_of = {c: b for b, c in alphabet.items()}
        self._inner, self._last = np.array(self.inner, np.int32), np.array(self.last, np.int32)
        self._pairs = _PairTable(self.ranks)
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.cache = cache

    def pieces(self, word: str) -> list[bytes]:
        """A word without white space as the pieces within which merges happen."""
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                return [low.encode()]
            if low[:-1].isalpha() and not low[-1].isalnum():
                return [low[:-1].encode(), low[-1:].encode()]
            return [p.encode() for p in self.pieces_of_latin(low)]
        if max(word) < "ƀ" and "\x85" not in word and "\xa0" not in word and "İ" not in word:  # composed already; no special lower case
            return [p.encode() for p in self.pieces_of_latin(word.lower())]
        found = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(word))
        return [bytes(self.byte_of[c] for c in p) for p, _ in found]

    def merged(self, piece: bytes) -> tuple[int, ...]:
        got = self.known.get(piece)
        if got is None:
            symbols = [self.inner[b] for b in piece]
            symbols[-1] = self.last[piece[-1]]
            got = tuple(self._short(symbols) if len(symbols) <= 48 else self._long(symbols))
            if len(piece) <= 64:
                if len(self.known) >= self.cache:
                    self.known.clear()
                self.known[piece] = got
        return got

    def _short(self, s: list[int]) -> list[int]:
        find = self.ranks.get
        none = (1 << 60, 0)
        best = [find(a << 20 | b, none) for a, b in zip(s, s[1:], strict=False)]
        while best:
            least = min(best)
            if least is none:
                break
            k = best.index(least)
            s[k : k + 2] = [least[1]]
            del best[k]
            if k:
                best[k - 1] = find(s[k - 1] << 20 | s[k], none)
            if k < len(best):
                best[k] = find(s[k] << 20 | s[k + 1], none)
        return s

    def _long(self, s: list[int]) -> list[int]:
        """The same by a heap, for pieces of any length."""
        n = len(s)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap = [(*self.ranks[key], k, key) for k in range(n - 1) if (key := s[k] << 20 | s[k + 1]) in self.ranks]
        heap = [(r, k, new, key) for r, new, k, key in heap]
        heapq.heapify(heap)
        while heap:
            _, k, new, key = heapq.heappop(heap)
            j = after[k] if alive[k] else -1
            if j < 0 or s[k] << 20 | s[j] != key:
                continue
            s[k], alive[j], after[k] = new, False, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (pair := s[a] << 20 | s[b]) in self.ranks:
                    rank, to = self.ranks[pair]
                    heapq.heappush(heap, (rank, a, to, pair))
        return [x for x, there in zip(s, alive, strict=True) if there]

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """``merged`` for many short pieces at once, each step joining the pair of least rank, leftmost first, of every piece."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        wide = int(size.max())
        flat = np.frombuffer(b"".join(pieces), "u1")
        start = np.cumsum(size) - size
        column = np.arange(wide)
        there = column < size[:, None]
        s = np.full((n, wide + 1), -1, np.int32)
        s[:, :wide][there] = self._inner[flat]
        s[np.arange(n), size - 1] = self._last[flat[start + size - 1]]
        none = _PairTable.NONE
        r = np.full((n, wide), none, np.int32)
        pair = column[:-1] + 1 < size[:, None]
        r[:, :-1][pair] = self._pairs.rank(s[:, : wide - 1][pair], s[:, 1:wide][pair])
        on = np.arange(n)
        while len(on):
            own = r[on]
            k = own.argmin(axis=1)
            rank = own[np.arange(len(on)), k]
            go = rank < none
            on, k, rank = on[go], k[go], rank[go]
            if not len(on):
                break
            later = column > k[:, None]
            own_s, own_r = s[on], r[on]
            moved = np.where(later, own_s[:, 1:], own_s[:, :-1])
            moved[np.arange(len(on)), k] = self._pairs.merged[rank]
            moved_r = np.where(later, np.concatenate([own_r[:, 1:], np.full((len(on), 1), none, np.int32)], 1), own_r)
            row = np.arange(len(on))
            right = np.where(k + 1 < wide, moved[row, np.minimum(k + 1, wide - 1)], -1)
            right[k + 1 >= wide] = -1
            moved_r[row, k] = np.where(right >= 0, self._pairs.rank(moved[row, k], np.maximum(right, 0)), none)
            has = k > 0
            moved_r[row[has], k[has] - 1] = self._pairs.rank(moved[row[has], k[has] - 1], moved[row[has], k[has]])
            s[on, :wide], r[on] = moved, moved_r
            s[on, wide] = -1
        held = s[:, :wide] >= 0
        raw = s[:, :wide][held].astype("<u4").tobytes()
        ends = (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        cut = [self.pieces(w) for w in words]
        new = list({p for ps in cut for p in ps})
        new.sort(key=len)
        ids: dict[bytes, bytes] = {}
        at = 0
        for most in (8, 12, 18, 28, 48):
            to = at
            while to < len(new) and len(new[to]) <= most:
                to += 1
            for a in range(at, to, 20_000):
                part = new[a : min(a + 20_000, to)]
                ids.update(zip(part, self.merged_together(part), strict=True))
            at = to
        for p in new[at:]:
            ids[p] = array("I", self.merged(p)).tobytes()
        return [ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps]) for ps in cut]

    def word(self, word: str) -> list[int]:
        return [i for p in self.pieces(word) for i in self.merged(p)]


class _PairTable:
    """Pairs of ids to (rank, merged id) for whole arrays at once: open addressing with a bounded number of probes."""

    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[int, tuple[int, int]]):
        self.bits = max(4, (4 * len(ranks)).bit_length())
        keys = np.fromiter(ranks, np.uint64, len(ranks))
        self.keys = np.full(1 << self.bits, 1 << 63, np.uint64)
        self.ranks = np.full(1 << self.bits, self.NONE, np.int32)
        self.merged = np.array([new for _, new in ranks.values()] + [0], np.int32)
        left, place, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            free = left[self.keys[place[left]] == 1 << 63]
            _, one = np.unique(place[free], return_index=True)
            put = free[one]
            self.keys[place[put]], self.ranks[place[put]] = keys[put], put
            left = np.setdiff1d(left, put)
            place[left] = place[left] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(20) | b.astype(np.uint64)
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], self.NONE)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] != 1 << 63))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            got = self.keys[at[todo]]
            hit = got == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (got != 1 << 63)]
        return out


class Lexicon:
    """A minimal acyclic transducer from words to id sequences, as one block of bytes."""

    MAGIC = 0x4B594D4F

    def __init__(self, block: np.ndarray):
        block = block.view(np.ndarray)  # of a memory map too
        magic, self.n_states, n_edges, self.n_words, n_ids, self.longest = (int(x) for x in block[:24].view("<u4"))
        if magic != self.MAGIC:
            raise ValueError("not a lexicon")
        at = 24

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            out = block[at : at + size].view(kind)
            at += size
            return out

        self.keys, self.targets, self.outputs = take(n_edges, "<u4"), take(n_edges, "<u4"), take(n_edges, "<u4")
        self.offsets, self.ids, self.final = take(self.n_words + 1, "<u4"), take(n_ids, "<u4"), take(self.n_states, "u1")
        self._offsets, self._ids = memoryview(self.offsets), memoryview(self.ids)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype="u1", mode="r"))

    @classmethod
    def build(cls, entries: dict[str, list[int]]) -> bytes:
        """Incremental minimisation over the sorted words: what can't change any more is replaced by an equal state."""
        words = sorted((w.encode("utf-8", "surrogatepass"), ids) for w, ids in entries.items())
        register: dict[tuple, int] = {}
        edges: list[dict[int, int]] = [{}]
        final = [False]
        free: list[int] = []
        path = [0]

        def new() -> int:
            if free:
                edges[k], final[k] = {}, False
                return free.pop()
            edges.append({})
            final.append(False)
            return len(edges) - 1

        def settle(down_to: int, word: bytes) -> None:
            while len(path) > down_to + 1:
                state = path.pop()
                key = (final[state], *edges[state].items())
                twin = register.setdefault(key, state)
                if twin != state:
                    edges[path[-1]][word[len(path) - 1]] = twin

        last = b""
        for word, _ in words:
            same = next((k for k, (a, b) in enumerate(zip(word, last, strict=False)) if a != b), min(len(word), len(last)))
            settle(same, last)
            for b in word[same:]:
                k = new()
                edges[path[-1]][b] = k
                path.append(k)
            final[path[-1]] = True
            last = word
        settle(0, last)
        order, number = [0], {0: 0}
        for state in order:
            for to in edges[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        counts: dict[int, int] = {}
        for state in _children_first(edges):
            counts[state] = final[state] + sum(counts[to] for to in edges[state].values())
        keys, targets, outputs = [], [], []
        for state in order:
            out = int(final[state])
            for b, to in edges[state].items():
                keys.append(number[state] << 8 | b)
                targets.append(number[to])
                outputs.append(out)
                out += counts[to]
        if len(order) >= 1 << 24:
            raise ValueError("too many states for one lexicon")
        offsets = np.cumsum([0, *(len(ids) for _, ids in words)])
        ids = [i for _, x in words for i in x]
        head = np.array([cls.MAGIC, len(order), len(keys), len(words), len(ids), max((len(w) for w, _ in words), default=0)], "<u4")
        parts = [head, *(np.array(x, "<u4") for x in (keys, targets, outputs, offsets, ids)), np.array([final[s] for s in order], "u1")]
        return b"".join(p.tobytes() for p in parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word, -1 where it isn't held; all words advance together, a byte at a time."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), "u1")
        start = np.concatenate([[0], np.cumsum(n)[:-1]]) if len(words) else np.zeros(0, np.int64)
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        on = np.flatnonzero((n <= self.longest) & (n > 0))
        state, total = np.zeros(len(on), np.int64), np.zeros(len(on), np.int64)
        step = 0
        while len(on):
            key = (state << 8 | text[start[on] + step]).astype(np.uint32)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            on, at = on[hit], at[hit]
            state, total = self.targets[at].astype(np.int64), total[hit] + self.outputs[at]
            step += 1
            end = n[on] == step
            good = end & (self.final[state] == 1)
            out[on[good]] = total[good]
            on, state, total = on[~end], state[~end], total[~end]
        return out

    def sequence(self, place: int) -> memoryview:
        return self._ids[self._offsets[place] : self._offsets[place + 1]]


def _children_first(edges: list[dict[int, int]]) -> Iterator[int]:
    seen, stack = set(), [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            yield state
        elif state not in seen:
            seen.add(state)
            stack.append((state, True))
            stack.extend((to, False) for to in edges[state].values() if to not in seen)


class Encoder:
    """Whole texts to ids: a bounded memory of words before the lexicon, and exact merges behind it."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None, memory: int = 300_000, decode: bool = True):
        self.merges, self.memory, self.decode = merges, memory, decode
        self.lexicon = lexicon or Lexicon(np.frombuffer(Lexicon.build({}), "u1"))
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def _learn(self, words: set[str]) -> None:
        """Make every word known. When the memory is full, the quarter that was learnt first stays: frequent words come early."""
        missing = list(words.difference(self.ids))
        if len(self.ids) + len(missing) > self.memory and self.ids:
            stay = list(islice(self.ids, self.memory // 4))
            self.ids = {w: self.ids[w] for w in stay}
            self.shown = {w: self.shown[w] for w in stay} if self.decode else {}
            missing = list(words.difference(self.ids))
        token = self.merges.tokens
        if not missing:
            return
        unseen = []
        for w, place in zip(missing, self.lexicon.find([w.encode("utf-8", "surrogatepass") for w in missing]).tolist(), strict=True):
            if place < 0:
                unseen.append(w)
            else:
                self.ids[w] = self.lexicon.sequence(place).tobytes()
        if unseen:
            self.ids.update(zip(unseen, self.merges.words(unseen), strict=True))
        if self.decode:
            for w in missing:
                self.shown[w] = " ".join([token[i] for i in memoryview(self.ids[w]).cast("I")])

    def _words(self, text: str) -> list[str]:
        if any(c in text for c in _SEPARATORS):
            return [w for w in _SURE_SPACE.split(text) if w]
        return text.split()

    def encode(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """Ids as little-endian unsigned 32-bit integers, and the tokens joined by spaces as decode() gives them."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 500_000:
                yield from self._several(held)
                held, size = [], 0
        yield from self._several(held)

    def _several(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        split, need = [], set()
        for text in texts:
            parts = self.merges.split_special(text) if "<|" in text else [text]
            words = [(p if k % 2 else self._words(p)) for k, p in enumerate(parts)]
            split.append(words)
            for k, w in enumerate(words):
                if not k % 2:
                    need.update(w)
        self._learn(need)
        ids, shown = self.ids.__getitem__, self.shown.__getitem__
        for words in split:
            if len(words) == 1:
                yield b"".join(map(ids, words[0])), " ".join(filter(None, map(shown, words[0]))) if self.decode else ""
                continue
            raw, said = [], []
            for k, w in enumerate(words):
                if k % 2:
                    raw.append(array("I", [self.merges.special[w]]).tobytes())
                    said.append(w)
                else:
                    raw.extend(map(ids, w))
                    if self.decode:
                        said.extend(filter(None, map(shown, w)))
            yield b"".join(raw), " ".join(said)


def word_counts(docs: DataFrame, text_col: str = "text", longest: int = 64) -> DataFrame:
    """(word, n) over all rows: each task counts what it sees before anything is shuffled. Longer words aren't counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            held = [(w, n) for w, n in seen.items() if len(w) <= longest]
            seen.clear()
            return pa.record_batch({"word": pa.array([w for w, _ in held], pa.string()), "n": pa.array([n for _, n in held], pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                seen.update(text.as_py().split())
                if len(seen) > 400_000:
                    yield flush()
        yield flush()

    return docs.select(text_or_empty(text_col).alias("t")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> list[str]:
    """The ``most`` most frequent of the words that occur twice or more; the bound of what reaches the driver."""
    return [w for w, _ in most_frequent(written(counts.filter("n > 1"), "word-counts"), "word", "n", most)]


@lru_cache(maxsize=2)
def _merges(tokenizer_file: str) -> Merges:
    return Merges(tokenizer_file)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(tokenizer_file: str, name: str) -> Encoder:
    """One encoder for a worker and lexicon: the next task finds its memory filled."""
    key = (tokenizer_file, name)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(_merges(tokenizer_file), Lexicon.open(SparkFiles.get(name)))
    return _ENCODERS[key]


def compile_lexicon(docs: DataFrame, tokenizer_file: str, text_col: str = "text", most_words: int = 250_000) -> str:
    """Build the lexicon from the counts over all documents and hand it to the executors; its name there."""
    merges = _merges(tokenizer_file)
    words = [w for w in frequent(word_counts(docs, text_col), most_words) if len(w.encode("utf-8", "surrogatepass")) <= 256 and not any(s in w for s in merges.special)]
    return put_bytes(docs.sparkSession, Lexicon.build({w: merges.word(w) for w in words}), "lexicon")


def encode(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 250_000) -> DataFrame:
    """One row per row of ``docs``: id, ids (array<int>), decoded (string).

    Null and empty texts have no ids and decode to an empty string. Repeated rows, null ids and ties stay as they are;
    an empty table gives an empty result; other columns aren't read.
    """
    name = compile_lexicon(docs, tokenizer_file, text_col, most_words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, name)
        for batch in batches:
            at, ids, decoded = 0, [], []
            for raw, shown in encoder.encode(t.as_py() for t in batch.column(1)):
                ids.append(np.frombuffer(raw, "<i4"))
                decoded.append(shown)
                if len(ids) >= 500:
                    yield _rows(batch, at, ids, decoded)
                    at, ids, decoded = at + len(ids), [], []
            yield _rows(batch, at, ids, decoded)

    return docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def _rows(batch: pa.RecordBatch, at: int, ids: list[np.ndarray], decoded: list[str]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, ids)])
    flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
    return pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())), pa.array(decoded, pa.string())], names=["i", "ids", "decoded"])


def digests(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", most_words: int = 250_000) -> DataFrame:
    """As ``encode``, with n_tokens and SHA-256 of ids and decoded text instead of the texts themselves."""
    name = compile_lexicon(docs, tokenizer_file, text_col, most_words)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file, name)
        for batch in batches:
            n, ids, decoded = [], [], []
            for raw, shown in encoder.encode(t.as_py() for t in batch.column(1)):
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                decoded.append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["i", "n", "a", "b"])

    return docs.select(F.col(id_col).alias("i"), text_or_empty(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
