"""Exact, near and line deduplication against brute force, with hard rows."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.llm import components, exact_dedup, line_dedup, simhash
from kymo.llm.common import workers_import

DOCS = "doc_id bigint, text string, lang string, _id string, _keep string, fp string, c0 string, node string"
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


@pytest.fixture(autouse=True)
def ready(spark):
    workers_import(spark)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "x", "y", None, "z", None) for i, t in rows], DOCS)


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()) + r.choice(["", "a", "us", "um"]) for _ in range(n)]


def corpus():
    rows = [(k, " ".join(words(k, 60 + k))) for k in range(20)]
    rows += [(100 + k, " ".join(words(3, 63)[:-1] + [f"w{k}"])) for k in range(80)]  # near copies of 3
    rows += [(200 + k, " ".join(words(5, 65))) for k in range(70)] + [(300, "\t".join(words(5, 65)))]  # copies of 5
    rows += [(400, None), (401, ""), (402, "  \n"), (403, " "), (None, "only here"), (None, " ".join(words(5, 65))), (500, "A b"), (501, "a B"), (502, "é É"), (503, "x " * 30_000)]
    rows += [(7, " ".join(words(7, 67)))]  # a repeated row
    return rows


def test_exact_groups(spark):
    rows = corpus()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for digest in (None, lambda t: F.substring(F.unhex(F.sha2(t, 256)), 1, 0)):  # the second makes all digests equal
        found = exact_dedup.exact_groups(frame(spark, rows), **({} if digest is None else {"digest": digest}))
        got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found.collect()), key=str)
        want = []
        for (i, _), t in zip(rows, norm, strict=True):
            ids = [j for (j, _), u in zip(rows, norm, strict=True) if u == t]
            keep = min((j for j in ids if j is not None), default=None)
            want.append((i, keep, len(ids), i == keep))
        assert got == sorted(want, key=str)
    kept = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(set(norm))
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def test_exact_is_native(spark):
    plan = exact_dedup.exact_groups(frame(spark, corpus()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_print(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unioned(n, links):
    up = list(range(n))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(a) for a in range(n)]


@pytest.mark.parametrize("cell_rows", [4096, 8])
def test_simhash_groups(spark, cell_rows, monkeypatch):
    rows = corpus()
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda p, limit, spare: links(p, limit, spare, cell_rows))
    prints = [brute_print(t) for _, t in rows]
    roots = unioned(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    want = [(rows[k][0], prints[k], min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[k] and rows[j][0] is not None), default=None)) for k in range(len(rows))]
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.groups(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for _, _, c in want if c is not None})
    assert simhash.groups(frame(spark, rows).limit(0)).count() == 0


def test_simhash_grid_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base[:60]:
        for _ in range(12):
            x = int(b)
            for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(bit)
            prints.append(x)
    prints = sorted(set(prints))
    roots = unioned(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    own = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(signed.index(r["a"]), signed.index(r["b"])) for r in simhash.links(own).collect()]
    assert unioned(len(prints), edges) == roots


def test_every_spare_gives_the_same_groups(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)]
    prints = sorted({x ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 6)), replace=False)) for x in base for _ in range(6)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = unioned(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    want = {p: min(q for q, r in zip(prints, roots, strict=True) if r == s) for p, s in zip(prints, roots, strict=True)}
    for spare in (2, 5):
        up = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 4, spare)).collect()}
        assert {p: up.get(p, p) for p in prints} == want
    assert [simhash.cheapest_spare(n) for n in (0, 10**5)] == [2, 2] and simhash.cheapest_spare(10**9) > 2


def test_lines_of_one_half_digest_keep_apart():
    """Links name lines by both halves: three lines share lo, two of them are alike."""
    texts = [" ".join(words(80, 20)), " ".join(words(80, 20)) + " x", " ".join(words(81, 20))]
    forest = simhash._Forest()
    got = list(line_dedup._linked(np.zeros(3, np.int64), texts, [(5, 1), (5, 2), (5, 3)], line_dedup.Fuzzy(), forest))
    assert got == [(0, 1)] and forest.root((5, 3)) == (5, 3)


def test_common_texts_take_the_salted_way(spark):
    """Over a thousand rows, so that some digests are under a thousandth of them and some are not."""
    rows = [(k, f"text {k}") for k in range(1500)] + [(2000 + k, "text 7") for k in range(300)] + [(3000, "text\n8"), (None, "text 7"), (None, "text 7")]
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(frame(spark, rows).repartition(6)).collect()}
    want = {(k, k, 1, True) for k in range(1500) if k not in (7, 8)} | {(7, 7, 303, True), (8, 8, 2, True), (3000, 8, 2, False), (None, 7, 303, False)}
    assert got == want | {(2000 + k, 7, 303, False) for k in range(300)}


def test_unary_distance_is_a_lower_bound(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 63), 1 << 63, 50, dtype=np.int64)
    got = [r[0] for r in spark.createDataFrame([(int(v),) for v in x], "fp long").select(simhash.unary(F.col("fp"))).collect()]
    for v, u in zip(x.tolist(), got, strict=True):
        counts = [((v >> 2 * k) & 3).bit_count() for k in range(32)]
        assert [((u >> 2 * k) & 3) for k in range(32)] == [(1 << c) - 1 for c in counts]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 800)] + [(3, 3)]
    own = spark.createDataFrame([*links, (None, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(own).collect()}
    roots = unioned(900, links)
    assert got == {k: r for k, r in enumerate(roots) if r != k}
    assert components.components(own.limit(0)).count() == 0


def line_rows():
    base = [" ".join(words(50 + k, 14)) for k in range(12)]
    near = [base[0] + f" x{k}" for k in range(60)]
    rows = [(1, "\n".join(base)), (2, "\n\n".join(base[3:6]) + "\n  \nNew line of text here"), (3, "\n".join(near)), (4, base[2].upper()), (5, None), (6, ""), (7, "short\nshort\nShort \nother"), (None, base[4]), (8, " ".join(words(9, 4000)))]
    return [*rows, (9, " ".join([*words(9, 3990), *words(10, 10)])), (10, base[0] + " x3"), (11, "é" * 10 + "\n" + "é" * 9)]


@pytest.mark.parametrize("bucket_rows", [512, 5])
def test_fuzzy_lines(spark, bucket_rows):
    fuzzy = line_dedup.Fuzzy(bucket_rows=bucket_rows)
    rows = line_rows()
    occ = [(i, n, line_dedup.comparable(x)) for i, t in rows for n, x in enumerate((t or "").split("\n")) if x.strip()]
    sets = [frozenset(x[a : a + 8] for a in range(max(1, len(x) - 7))) for _, _, x in occ]
    roots = unioned(len(occ), [(a, b) for a in range(len(occ)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    place = lambda k: (occ[k][0] is None, occ[k][0] or 0, occ[k][1])
    want = []
    for k in range(len(occ)):
        first = min((j for j in range(len(occ)) if roots[j] == roots[k]), key=place)
        want.append((occ[k][0], occ[k][1], occ[first][0], occ[first][1], first == k))
    got = [tuple(r) for r in line_dedup.decisions(frame(spark, rows), fuzzy=fuzzy).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    dropped = {(i, n) for i, n, _, _, kept in want if not kept}
    texts = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(frame(spark, rows), fuzzy=fuzzy).collect()}
    assert texts == {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in dropped) for i, t in rows}


def test_line_edges(spark):
    assert line_dedup.decisions(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert line_dedup.decisions(frame(spark, [(1, None), (2, ""), (3, " \n ")])).count() == 0
    out = line_dedup.drop_lines(frame(spark, [(1, "a line\nb"), (2, "a line")]).withColumn("n_chars", F.lit(7).cast("bigint")), count_col="n_chars")
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(1, "a line\nb", 8), (2, "", 0)]
    rest = line_dedup.drop_lines(frame(spark, [(1, "a line\nb"), (2, "a line"), (3, ""), (4, None)]), keep_emptied=False)
    assert sorted(r["doc_id"] for r in rest.collect()) == [1, 3, 4]
    hashes, offsets = line_dedup.shingles(["abcdefgh", "abc", "abcdefghi"], 8)
    assert np.diff(offsets).tolist() == [1, 1, 2] and hashes[0] == hashes[2]


def test_lines_go_only_from_the_row_they_were_judged_in(spark):
    """Rows without an id, rows that share one, and rows equal in id and text."""
    a, b, c, d = (" ".join(words(70 + k, 14)) for k in range(4))
    rows = [(1, a), (None, a + "\n" + b), (None, c), (2, a), (2, d), (None, c + "\nown line of it"), (3, "twice here\n \n" + a), (3, "twice here\n \n" + a)]
    for keep_emptied, emptied in ((True, [(2, ""), (3, " ")]), (False, [])):
        got = [(r["doc_id"], r["text"]) for r in line_dedup.drop_lines(frame(spark, rows), keep_emptied=keep_emptied).collect()]
        no_id = sorted(t for i, t in got if i is None and t)
        assert no_id in (sorted([b, c, "own line of it"]), sorted([b, c + "\nown line of it"]))  # either row may come first
        assert sorted(x for x in got if x[0] is not None) == sorted([(1, a), (2, d), (3, "twice here\n "), *emptied])
    kept = [r for r in line_dedup.decisions(frame(spark, rows)).collect() if r["kept"]]
    assert len(kept) == 6


def test_repetitive_lines_share_a_kind_of_signature(spark):
    """The kind goes by the different shingles, so lines of equal shingle sets meet whatever their lengths."""
    pairs = [("=" * 60, "=" * 200), ("ating. " * 10, "ating. " * 150)]
    for a, b in pairs:
        line, key = line_dedup.signatures(*line_dedup.shingles([a, b], 8), line_dedup.Fuzzy())
        assert set(key[line == 0]) & set(key[line == 1])
    rows = [(10 * k + j, x) for k, pair in enumerate(pairs) for j, x in enumerate(pair)]
    got = {r["doc_id"]: r["keep_id"] for r in line_dedup.decisions(frame(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 10: 10, 11: 10}
    hashes, offsets = line_dedup.shingles(["=" * 300, " ".join(words(1, 40)), "ab" * 80, "x"], 8)
    assert line_dedup.different(hashes, offsets, 2).tolist() == [len(set(hashes[a:b].tolist())) for a, b in zip(offsets, offsets[1:])]


def test_near_copies_are_judged_by_id_and_text(spark):
    a, b, c, d = (" ".join(words(90 + k, 60)) for k in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (4, b), (5, c + " "), (3, d), (None, a), (None, d)]
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (3, c), (3, d), (None, a), (None, d)], key=str)
    got = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(frame(spark, [(1, a), (1, a + " "), (2, None), (2, "")])).collect()]
    assert [i for i, _ in sorted(got, key=str)] == [1, 2]
