"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Three combining stages, each of which groups by digest *and* whole content:

1. local: Spark's map-side aggregation joins the copies that a task sees, so a group that holds a third of all rows
   leaves each task as one row;
2. salted: those rows meet by (digest, salt, content), which spreads a common digest over ``salts`` tasks;
3. global: the salt winners meet by (digest, content).

Digests are counted first, without texts. One that makes up a thousandth of all rows or more is common; there are at most
a thousand of them. The others have one salt, so what the second stage gives is final for them and texts are shuffled
once. Every document then takes its winner by digest: common ones from a broadcast table of at most a thousand rows, the
others by a shuffled join without hot keys. Where two contents share a digest, which the global stage shows, those
documents are joined by digest and content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import SPACE_RUN, plainly_named, text_or_empty, written


def normalised(text: Column) -> Column:
    """Each run of white space as one space; nothing else changes."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256)),
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, digest (binary).

    Null text counts as empty, and all empty texts are one group. A null id never wins against another; in a group of
    null ids only, keep_id is null and kept is true. Rows that repeat an id and its text share one decision and each
    counts in group_size. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    base = docs.select(F.col(id_col).alias("_id"), normalised(text_or_empty(text_col)).alias("_text")).withColumn("_digest", digest(F.col("_text")))
    ids = written(base.select("_id", "_digest"), "exact-digests")
    common = ids.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") * 1000 >= ids.count())
    common = F.broadcast(written(common.select("_digest", F.lit(True).alias("_common")), "exact-common"))
    salted = (
        base.join(common, "_digest", "left")
        .withColumn("_salt", F.when(F.col("_common"), F.pmod(F.spark_partition_id(), F.lit(salts))))
        .groupBy("_digest", "_salt", "_text")
        .agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    # What has no salt is whole already: it goes on without its text, as a row of its own.
    apart = F.when(F.col("_salt").isNull(), F.monotonically_increasing_id()).alias("_apart")
    classes = (
        salted.select("_digest", apart, F.when(F.col("_salt").isNotNull(), F.col("_text")).alias("_text"), "_keep", "_n")
        .groupBy("_digest", "_apart", "_text")
        .agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    )
    winners = written(classes.groupBy("_digest").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_contents")), "exact-winners")
    clashing = winners.filter("_contents > 1").select("_digest")
    single = winners.filter("_contents = 1").drop("_contents")
    plain = ids.join(F.broadcast(single.join(common, "_digest", "left_semi")), "_digest").select("_id", "_digest", "_keep", "_n")
    plain = plain.unionByName(ids.join(common, "_digest", "left_anti").join(single, "_digest").select("_id", "_digest", "_keep", "_n"))
    if not clashing.isEmpty():
        own = base.join(clashing, "_digest", "left_semi")
        of = own.groupBy("_digest", "_text").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
        plain = plain.unionByName(own.join(of, ["_digest", "_text"]).select("_id", "_digest", "_keep", "_n"))
    return plain.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with all columns of ``docs``.

    Of rows that repeat both id and text an arbitrary one stays. Null texts count as empty; a null id stays only where
    its whole group has none.
    """
    digest = options.get("digest", lambda text: F.unhex(F.sha2(text, 256)))

    def work(plain: DataFrame, id_col: str, text_col: str) -> DataFrame:
        kept = exact_groups(plain, id_col, text_col, **options).filter("kept").select(F.col(id_col).alias("_keep"), F.col("digest").alias("_digest")).distinct()
        marked = plain.withColumn("_text", normalised(text_or_empty(text_col)))
        here = digest(F.col("_text")) == F.col("_digest")
        return marked.join(kept, F.col(id_col).eqNullSafe(F.col("_keep")) & here, "left_semi").dropDuplicates([id_col, "_text"])

    return plainly_named(docs, work, id_col, text_col)
