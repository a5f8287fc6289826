"""Quality rules: a threshold table compiled into one projection of built-in functions.

Five-word windows are compared by hash first; only texts in which two hashes agree (so every text
with a repeated window) go on to the exact comparison of the words themselves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACES, free_name

_BREAK = rf"[{SPACES}]+".replace("\t", r"\x09")

# Frequent function words of the languages served.
STOP_WORDS = {
    "en": "the be to of and that have with this for on are was is in it as at by from not or an a".split(),
    "de": "der die das und ist nicht von mit zu den ein eine auf für sich im dem des in es als auch".split(),
    "fr": "le la les de des et un une est dans que pour pas sur en au aux du qui par ne se".split(),
    "es": "el la los las de y que en un una es por con no para se del al lo como su".split(),
}


@dataclass(frozen=True)
class Rule:
    """``feature`` must lie in [low, high]; a missing bound is open. Texts under ``least`` words pass."""

    feature: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The production table. Ratios are per word unless the name says otherwise.
THRESHOLDS = (
    Rule("mean_word_chars", low=2.0, high=18.0),
    Rule("symbol_ratio", high=0.25),
    Rule("dup_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.5),
    Rule("stop_ratio", low=0.01, least=100),
)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _beside(docs: DataFrame, text: str, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """All columns of ``docs`` as they are, and those that ``make`` adds; of the latter, one whose name
    is taken has an underscore more."""
    own = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    made = make(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in own.items())), own[text])
    new = [c for c in made.columns if c not in own.values()]
    return made.select(*(F.col(n).alias(c) for c, n in own.items()), *(F.col(c).alias(free_name(c, own)) for c in new))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs``, with counts and ratios of every whole text; null texts have no words."""
    return _beside(docs, text, _features)


def _features(docs: DataFrame, text: str) -> DataFrame:
    kept = docs.columns
    rows = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumns({"_words": F.array_remove(F.split("_text", _BREAK), ""), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(rf"[^{SPACES}]"))})
    stop = sorted({v for words in STOP_WORDS.values() for w in words for v in (w, w.capitalize())})
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1)))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(rf"^[{SPACES}]*[-*•]"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.rlike(rf"(\.\.\.|…)[{SPACES}]*$"))).cast("long"),
            "n_stop_words": F.size(F.filter("_words", lambda w: w.isin(stop))).cast("long"),
            "_hashes": F.transform(starts, lambda i: F.xxhash64(F.slice("_words", i, 5))),
        }
    )
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    ordered = F.array_sort(F.transform(starts, lambda i: F.struct(F.slice("_words", i, 5).alias("w"), i.alias("i"))))
    rows = rows.withColumn("_ordered", F.when(repeats, ordered))
    same = lambda a, b: F.coalesce(a["w"] == b["w"], F.lit(False))
    twice = lambda k: same(F.get("_ordered", k), F.get("_ordered", k - 1)) | same(F.get("_ordered", k), F.get("_ordered", k + 1))
    at = F.filter(F.sequence(F.lit(0), F.size("_ordered") - 1), twice)
    rows = rows.withColumn("_at", F.when(F.col("_ordered").isNotNull(), F.array_sort(F.transform(at, lambda k: F.get("_ordered", k)["i"]))))
    covered = F.aggregate("_at", F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])
    per = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    ratios = {"mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "bullet_line_ratio": ("n_bullet_lines", "n_lines"), "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"), "stop_ratio": ("n_stop_words", "n_words")}
    return rows.select(*kept, *MEASURES, *(per(a, b).alias(name) for name, (a, b) in ratios.items()))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def verdict(rules=THRESHOLDS) -> Column:
    """The whole threshold table as one boolean expression."""

    def holds(rule: Rule) -> Column:
        ok = F.lit(True)
        if rule.low is not None:
            ok &= F.col(rule.feature) >= rule.low
        if rule.high is not None:
            ok &= F.col(rule.feature) <= rule.high
        return ok | (F.col("n_words") < rule.least) if rule.least else ok

    return reduce(lambda a, b: a & b, map(holds, rules), F.lit(True))


def with_verdict(docs: DataFrame, rules=THRESHOLDS, text: str = "text") -> DataFrame:
    """All columns of ``docs``, features, ``base_failed`` and ``kept``. A feature whose name ``docs`` has
    already has an underscore more."""

    def judged(rows: DataFrame, source: str) -> DataFrame:
        found = _features(rows, source).withColumn("base_failed", base_failed())
        # The row id keeps a filter on the verdict above this projection. Pushed below it, the filter
        # would take the array expressions with it and evaluate them again for every array element.
        return found.withColumn("kept", ~F.col("base_failed") & verdict(rules) & (F.monotonically_increasing_id() >= 0))

    return _beside(docs, text, judged)


def judge(docs: DataFrame, rules=THRESHOLDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id with features, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. Repeated rows are judged alike, an
    empty table gives an empty result, extra columns are not read.
    """
    return with_verdict(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_source")), rules, "_source").drop("_source")
