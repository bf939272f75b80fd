"""License scans by diagonal voting.

All rolling k-grams of words of every text are hashed and joined in Spark to their places in the templates. A hit at word
``p`` of a text and ``q`` of a template votes for the diagonal ``p - q``. Votes are counted by text, template and
diagonal; diagonals up to ``gap`` apart (words put in or left out) are merged, and those with enough votes name a span.
How many are enough follows from the share of words that the alignment asks for: no span is lost to changed words. Words
put in break grams too but cost no share, so a span with many of them may still have too few votes.
The span's words are then aligned with the template's to verify it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.llm.common import bit_table, maybe_in, text_or_empty, written


@dataclass(frozen=True)
class Template:
    """``exact`` templates are phrases: every place where the words stand counts, and nothing near it does."""

    label: str
    text: str
    exact: bool = False


PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)

TEMPLATES = PHRASES + (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
    Template("reserved", "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher"),
)

#: Bytes of a word once A-Z are lower case: digits, a-z and all of UTF-8 beyond ASCII.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[48:58] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_P = 0x100000001B3
_U = np.uint64


def words_of(text: str) -> list[bytes]:
    return _WORDS(text.encode("utf-8", "surrogatepass").lower())


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and their inverses."""
    up, down = np.full(n, _P, _U), np.full(n, pow(_P, -1, 1 << 64), _U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> _U(32)) * _U(0xD6E8FEB86659FD93)
    return x ^ x >> _U(32)


def word_hashes(texts: list[bytes], word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and each text's number of words; whole arrays at a time."""
    buf = np.frombuffer(b"\0".join(texts) + b"\0", "u1")
    up, down = _powers(1 << (len(buf) + 1).bit_length())
    word = word_bytes[buf]
    word[np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1] = False
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * up[: len(buf)])])
    hashes = _mixed((total[end] - total[start]) * down[start] + (end - start).astype(_U))
    text_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, text_end)]))
    return hashes, counts


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k words."""
    out = np.full(max(len(hashes) - k + 1, 0), k, _U)
    for j in range(k):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + hashes[j : j + len(out)])
    return out


def _needed(template: Template, k: int, least: float) -> tuple[int, int]:
    """Words a gram, and grams that a span has at least: of a phrase all, of other templates what changing as many words as
    ``least`` allows leaves. Grams are as much smaller than k as it takes for one to be left."""
    n = len(words_of(template.text))
    if template.exact:
        return min(k, n), max(1, n - k + 1)
    changed = max(x for x in range(n + 1) if n - x >= least * n)
    for size in range(min(k, n), 0, -1):
        if (left := n - size + 1 - changed * size) >= 1:
            return size, left
    return 1, 1


def _sizes(templates: tuple[Template, ...], k: int, least: float) -> list[int]:
    return [_needed(t, k, least)[0] for t in templates]


def template_places(spark: SparkSession, templates: tuple[Template, ...], k: int, least: float) -> DataFrame:
    """(gram, template, place): a few hundred rows, whatever the input. A template under k words is one gram."""
    rows = []
    for number, t in enumerate(templates):
        hashes, _ = word_hashes([b" ".join(words_of(t.text))])
        rows += [(int(g), number, place) for place, g in enumerate(grams(hashes, _sizes(templates, k, least)[number]).view(np.int64))]
    return spark.createDataFrame(rows, "gram long, template int, place int")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows by id and text hash, so that rows with a null or repeated id keep apart."""
    return docs.select(F.col(id_col).alias("i"), F.xxhash64(text_or_empty(text_col)).alias("h"), text_or_empty(text_col).alias("t"))


def hits(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...], k: int, least: float) -> DataFrame:
    """(i, h, template, place, at): every k-gram of every text that stands in a template."""
    kind = docs.schema[id_col].dataType.simpleString()
    sizes = sorted(set(_sizes(templates, k, least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[bytes] = []
            first = 0

            def rows(first: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
                hashes, counts = word_hashes(held)
                text = np.repeat(np.arange(len(held)), counts)
                at = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
                ids, keys = batch.column(0).slice(first, len(held)), batch.column(1).slice(first, len(held))  # noqa: B023
                for size in sizes:
                    gram = grams(hashes, size)
                    on = np.flatnonzero(text[: len(gram)] == text[size - 1 :])
                    for a in range(0, len(on), 100_000):
                        part = on[a : a + 100_000]
                        own = pa.array(text[part])
                        yield pa.RecordBatch.from_arrays([ids.take(own), keys.take(own), pa.array(at[part].astype(np.int32)), pa.array(gram[part].view(np.int64))], names=["i", "h", "at", "gram"])

            size = 0
            for n, t in enumerate(batch.column(2)):
                held.append(t.as_py().encode("utf-8", "surrogatepass").lower())
                size += len(held[-1])
                if size > 500_000:
                    yield from rows(first, held)
                    held, first, size = [], n + 1, 0
            if held:
                yield from rows(first, held)

    found = _keyed(docs, id_col, text_col).mapInArrow(run, f"i {kind}, h long, at int, gram long")
    return found.join(F.broadcast(template_places(docs.sparkSession, templates, k, least)), "gram")


def candidates(docs: DataFrame, id_col: str, text_col: str, templates: tuple[Template, ...], k: int, gap: int, least: float) -> DataFrame:
    """(i, h, template, low, high): merged diagonals with the grams that a span of the share ``least`` of a template's words has."""
    spark = docs.sparkSession
    needed = [(n, t.exact, _needed(t, k, least)[1]) for n, t in enumerate(templates)]
    needed = F.broadcast(spark.createDataFrame(needed, "template int, exact boolean, needed int"))
    by_diagonal = (
        hits(docs, id_col, text_col, templates, k, least)
        .groupBy("i", "h", "template", (F.col("at") - F.col("place")).alias("d"))
        .agg(F.collect_set("place").alias("places"))
        .select("i", "h", "template", "d", F.size("places").alias("n"))
        .join(needed, "template")
    )
    order = Window.partitionBy("i", "h", "template").orderBy("d")
    new = F.coalesce(F.col("d") - F.lag("d").over(order) > F.when(F.col("exact"), 0).otherwise(gap), F.lit(True))
    return (
        by_diagonal.withColumn("new", new.cast("int"))
        .withColumn("run", F.sum("new").over(order))
        .groupBy("i", "h", "template", "needed", "run")
        .agg(F.min("d").alias("low"), F.max("d").alias("high"), F.sum("n").alias("n"))
        .filter("n >= needed")
        .select("i", "h", "template", "low", "high")
    )


SPAN = "struct<label:string,template:int,exact:boolean,start:bigint,end:bigint,coverage:double>"


def verified(words: list[bytes], template: Template, number: int, low: int, high: int, least: float) -> dict | None:
    """The aligned span, or None: phrases word by word, longer templates by the share of their words that stand in order."""
    want = words_of(template.text)
    if template.exact:
        if words[low : low + len(want)] != want or low < 0:
            return None
        return {"label": template.label, "template": number, "exact": True, "start": low, "end": low + len(want), "coverage": 1.0}
    a = max(low, 0)
    blocks = SequenceMatcher(None, want, words[a : max(high, 0) + len(want)], autojunk=False).get_matching_blocks()
    same = sum(b.size for b in blocks)
    if same < least * len(want):
        return None
    full = [b for b in blocks if b.size]
    return {"label": template.label, "template": number, "exact": False, "start": a + full[0].b, "end": a + full[-1].b + full[-1].size, "coverage": same / len(want)}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, k: int = 3, gap: int = 3, least: float = 0.8) -> DataFrame:
    """One row per row of ``docs``: id, n_words and spans (label, template, exact, start, end, coverage), by start.

    Null and empty texts have no words and no spans. Rows with a null id and rows that repeat an id are told apart by
    their text; rows that repeat both have the same spans. An empty table gives an empty result; no other column is read.
    """
    found = written(candidates(docs, id_col, text_col, templates, k, gap, least), "license-candidates")
    near = bit_table(found.select("h").distinct(), "h")
    kind = docs.schema[id_col].dataType.simpleString()

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that surely have no candidate give up their words; the others keep the text for the join."""
        for batch in batches:
            on = maybe_in(near, batch.column(1).to_numpy())
            texts = batch.column(2)
            n, own = [], []
            for at in range(0, len(batch), 200):
                part = [t.as_py() for t in texts[at : at + 200]]
                n += word_hashes([t.encode("utf-8", "surrogatepass").lower() for t in part])[1].tolist()
                own += [t if keep else None for t, keep in zip(part, on[at : at + 200], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(own, pa.string())], names=["i", "h", "n", "t"])

    texts = _keyed(docs, id_col, text_col).mapInArrow(shorten, f"i {kind}, h long, n long, t string")
    spans = found.groupBy(F.col("i").alias("i2"), F.col("h").alias("h2")).agg(F.collect_list(F.struct("template", "low", "high")).alias("c"))
    joined = texts.join(spans, (F.col("h") == F.col("h2")) & F.col("i").eqNullSafe(F.col("i2")), "left").select("i", "n", F.when(F.col("c").isNotNull(), F.col("t")).alias("t"), "c")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("label", pa.string()), ("template", pa.int32()), ("exact", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column(2), batch.column(3), strict=True):
                if not wanted.is_valid:
                    out.append([])
                    continue
                words = words_of(text.as_py())
                got = (verified(words, templates[c["template"]], c["template"], c["low"], c["high"], least) for c in wanted.as_py())
                out.append(sorted((g for g in got if g), key=lambda g: (g["start"], g["end"], g["template"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct(kinds)))], names=["i", "n", "s"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("spans", T._parse_datatype_string(f"array<{SPAN}>"))])
    return joined.mapInArrow(verify, schema)
