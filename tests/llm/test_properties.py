"""Properties over random texts: encoding and extraction hold for whatever comes."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kymo.llm import bpe, html_extract, line_dedup, simhash
from kymo.llm.common import tidied

public_tokenizers = pytest.importorskip("public_tokenizers")
FILE = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.characters(exclude_categories=["Cs", "Cn", "Co"]), max_size=60)


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    merges = bpe.Merges(FILE)
    lexicon = bpe.Lexicon(np.frombuffer(bpe.Lexicon.build({w: merges.word(w) for w in ("the", "a", "and,", "Über")}), "u1"))
    return Tokenizer.from_file(FILE), bpe.Encoder(merges, lexicon, memory=50)


def test_encoding_is_the_library(both):
    lib, encoder = both

    @settings(max_examples=300, deadline=None)
    @given(st.lists(TEXT | st.sampled_from(["the and,", "it's 12 ½", "Σας ΣΑΣ", "<|endoftext|>x", "é́ Å"]), max_size=4))
    def run(texts):
        for text, (raw, shown) in zip(texts, encoder.encode(texts), strict=True):
            ids = lib.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(raw, "<u4").tolist() == ids and shown == lib.decode(ids, skip_special_tokens=False)

    run()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "<article>", "</article>", "<ul><li>", "<script>", "</script>", "<!--", "-->", "text, more", "<", "&amp;", "<br/>", "<td>", "<table>", "</table>", "<a href='x'>", "</a>"]), max_size=30))
def test_any_markup_is_read(parts):
    html_extract.main_text("".join(parts))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_manhattan_is_at_most_hamming(a, b):
    count = lambda x: [((x >> 2 * k) & 3).bit_count() for k in range(32)]
    assert sum(abs(x - y) for x, y in zip(count(a), count(b), strict=True)) <= (a ^ b).bit_count()


def test_similar_lines_share_a_band():
    fuzzy, rng = line_dedup.Fuzzy(), random.Random(9)
    found = total = 0
    for _ in range(300):
        n = rng.choice([30, 90, 140, 260, 700])
        a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
        at = rng.randrange(n - 1)
        b = a[:at] + rng.choice("xyz") + a[at + 1 :]
        x, y = ({s[k : k + 8] for k in range(max(1, len(s) - 7))} for s in (a, b))
        if len(x & y) < 0.8 * len(x | y):
            continue
        line, key = line_dedup.signatures(*line_dedup.shingles([a, b], 8), fuzzy)
        total += 1
        found += bool(set(key[line == 0]) & set(key[line == 1]))
    assert total > 100 and found >= 0.99 * total


def test_fingerprint_of_few_words():
    import xxhash

    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == bytes(8)
    assert simhash.fingerprint("One  TWO") == xxhash.xxh64_digest(b"one two", 42)


def test_tidied_changes_no_rows():
    batches = [pa.record_batch({"x": [1, 2]}), pa.record_batch({"x": pa.array([], pa.int64())}), pa.record_batch({"x": [None, 3]})]
    assert list(tidied(lambda rows: (b.slice(0, 1) for b in rows))(iter(batches))) == [b.slice(0, 1) for b in batches]
    assert list(tidied(lambda rows: rows)(iter([]))) == []
    with pytest.raises(ZeroDivisionError):
        list(tidied(lambda rows: (1 // 0 for _ in rows))(iter(batches)))
