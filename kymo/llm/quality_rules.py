"""Quality rules: a table of thresholds compiled into one projection, without user functions or shuffles."""

from __future__ import annotations

import string
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kymo.llm.common import SPACE_RUN, SPACES, text_or_empty

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it as was for with be by on not he his but at are this have from or had an they which one "
    "le la les de des du et un une est que qui dans pour par sur pas au aux en avec ce il elle se ne plus "
    "der die das den dem des und ist ein eine zu von mit auf für im nicht sich auch als an es bei "
    "el los las del y que en un una es por con para su al se lo como más no sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A document of ``words`` words or more fails when ``metric`` is under ``least`` or over ``most``."""

    metric: str
    least: float | None = None
    most: float | None = None
    words: int = 0


#: The method's table. Ratios are per word or per line as their names say.
RULES = (
    Rule("n_words", least=10, most=1_000_000),
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("symbols_per_word", most=0.3),
    Rule("stop_word_ratio", least=0.02),
    Rule("shouting_word_ratio", most=0.5),
    Rule("dup_line_ratio", most=0.5),
    Rule("repeat_word_ratio", most=0.2),
    Rule("ellipsis_line_ratio", most=0.5),
    Rule("bullet_line_ratio", most=0.9),
)

#: The table for filtering: no text is too long, and a share of stop words is asked of 50 words or more (1 / 0.02), where
#: it means one at least; stop words count with ASCII punctuation at their ends.
FILTER_RULES = (Rule("n_words", least=10), *(replace(r, metric="bare_stop_word_ratio", words=50) if r.metric == "stop_word_ratio" else r for r in RULES if r.metric != "n_words"))


def _windows(words: Column, n: Column, width: int) -> Column:
    at = lambda i, k: F.get(words, i + k)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*(at(i, k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(words: Column, hashes: Column, width: int) -> Column:
    """Words that lie in a window found twice or more; equal hashes count once their words were compared."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(order: Column) -> Column:
        same = lambda x, y: (y["h"] == x["h"]) & (F.slice(words, x["i"] + 1, width) == F.slice(words, y["i"] + 1, width))
        return F.array_sort(F.transform(F.filter(order, lambda x, k: F.coalesce(same(x, F.get(order, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(order, k + 1)), F.lit(False))), lambda x: x["i"]))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1) - p, F.lit(width)))), F.lit(0).cast("bigint"), lambda a, x: a + x)

    bound = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  evaluated once
    return bound(order, lambda o: bound(repeated(o), covered))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5, bare: bool = False) -> DataFrame:
    """Counts per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and the method's ratios.

    ``bare`` adds n_bare_stop_words, which are found without ASCII punctuation at their ends, and bare_stop_word_ratio.
    Null text has no words. Ratios over no words or no lines are 0. Rows are neither dropped nor joined: repeated rows
    and null ids stay as they are, an empty table gives an empty result, and no other column is read.
    """
    has_word = lambda line: F.length(F.translate(line, SPACES, "")) > 0
    step = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    step = step.select(
        "_id", "_text",
        F.array_remove(F.split("_text", SPACE_RUN), "").alias("_words"),
        F.filter(F.split("_text", "\n"), has_word).alias("_lines"),
    )
    step = step.select("*", F.size("_words").alias("_n"), F.size("_lines").alias("_n_lines"))
    step = step.select("*", _windows(F.col("_words"), F.col("_n"), window).alias("_hashes"))
    either = sorted({form for w in STOP_WORDS for form in (w, w.capitalize())})
    extra = [F.size(F.filter("_words", lambda w: F.btrim(w, F.lit(string.punctuation)).isin(either))).cast("bigint").alias("n_bare_stop_words")] if bare else []
    counts = F.struct(
        F.col("_n").cast("bigint").alias("n_words"),
        F.length(F.translate("_text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), _repeat_words(F.col("_words"), F.col("_hashes"), window)).otherwise(F.lit(0)).cast("bigint").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(either))).cast("bigint").alias("n_stop_words"),
        F.size(F.filter("_words", lambda w: w.endswith("!!"))).cast("bigint").alias("n_shouting"),
        F.col("_n_lines").cast("bigint").alias("n_lines"),
        F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("bigint").alias("n_ellipsis_lines"),
        F.size(F.filter("_lines", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))).cast("bigint").alias("n_bullet_lines"),
        *extra,
    )
    # One row each: filters on the counts stay above this generator, so that no count is worked out twice.
    step = step.select(F.col("_id").alias(id_col), F.inline(F.array(counts)))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return step.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_stop_words", "n_words").alias("stop_word_ratio"),
        share("n_shouting", "n_words").alias("shouting_word_ratio"),
        share("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        share("n_repeat_words", "n_words").alias("repeat_word_ratio"),
        share("n_ellipsis_lines", "n_lines").alias("ellipsis_line_ratio"),
        share("n_bullet_lines", "n_lines").alias("bullet_line_ratio"),
        *([share("n_bare_stop_words", "n_words").alias("bare_stop_word_ratio")] if bare else []),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the metrics that fail, as one column."""
    tests = []
    for r in rules:
        asked = F.col("n_words") >= r.words if r.words else F.lit(True)
        if r.least is not None:
            tests.append(F.when(asked & (F.col(r.metric) < r.least), F.lit(f"{r.metric}<{r.least:g}")))
        if r.most is not None:
            tests.append(F.when(asked & (F.col(r.metric) > r.most), F.lit(f"{r.metric}>{r.most:g}")))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``measured`` with base_failed, failed_rules and kept. A document without words fails."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    bare = any(r.metric == "bare_stop_word_ratio" for r in rules)
    step = measured(docs, id_col, text_col, bare=bare).select("*", base.alias("base_failed"), compiled(rules).alias("failed_rules"))
    return step.select("*", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = FILTER_RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns; the judgement is computed beside each row, without a join."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_kymo_row"), F.col(f"`{text_col}`").alias("_kymo_text"))
    good = judged(packed, "_kymo_row", "_kymo_text", rules).filter("kept")
    return good.select(*(F.col("_kymo_row").getField(c).alias(c) for c in docs.columns))
