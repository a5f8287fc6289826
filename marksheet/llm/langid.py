"""Language identification by rank-order profiles.

A profile is the ranking of a language's most frequent letter n-grams (n = 1 to 3, words padded
with blanks). A document's own ranking is compared with each profile by the sum of out-of-place
distances; an n-gram that a profile lacks counts as being as far out as the profile is long.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import crc_mod, saved, slices

_BLANK = 32
#: Characters of a text that are counted at once.
_PART = 1 << 20


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For every code point the lower-case letter, or a blank where it is no letter (category L)."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter n-grams (21 bits to a character, n = 1 to 3) of the whole text and their counts.

    Words are runs of letters, padded with a blank on either side.
    """
    s = np.concatenate(([_BLANK], letter_table()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")], [_BLANK])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != _BLANK) | (s[:-1] != _BLANK)))]
    parts = []
    for at in range(0, len(s) - 1, _PART):
        one, two, three = s[at : at + _PART], s[at + 1 : at + 1 + _PART], s[at + 2 : at + 2 + _PART]
        pairs = one[: len(two)] << 21 | two
        triples = pairs[: len(three)] << 21 | three
        found = np.concatenate((one[one != _BLANK], pairs, triples[two[: len(three)] != _BLANK]))
        parts.append(np.unique(found, return_counts=True))
    if len(s) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    packed, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return packed, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64)


def ranking(packed: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams, ties by n-gram. ``packed`` is sorted."""
    if len(counts) > 4 * k:  # only what can be among the first k
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        packed, counts = packed[counts >= least], counts[counts >= least]
    return packed[np.argsort(-counts, kind="stable")[:k]]


def training_sample(train: DataFrame, most_rows: int, key: str, text: str, lang: str) -> DataFrame:
    """_lang, _text of at most ``most_rows`` documents of each language, those of least hash.

    A threshold on the hash, from the language's number of documents, leaves nine tenths of
    ``most_rows`` on average, so what is then ranked by language is bounded too.
    """
    rows = train.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(key).cast("string"), text).alias("_h"))
    # Saved, so that its size is known: a table of some languages is broadcast, and no text moves by language.
    sizes = saved(rows.groupBy("_lang").agg(F.count("*").alias("_n")).withColumn("_share", F.when(F.col("_n") <= most_rows, 1.0).otherwise(0.9 * most_rows / F.col("_n"))), "languages")
    below = F.shiftrightunsigned("_h", 11).cast("double") / float(1 << 53) <= F.col("_share")
    first = rows.join(sizes, "_lang").where(below).withColumn("_nth", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_text")))
    return first.where(F.col("_nth") <= most_rows).select("_lang", "_text")


def fit_profiles(train: DataFrame, k: int = 300, most_rows: int = 2000, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Profiles of the languages in ``lang`` from at most ``most_rows`` documents of each.

    The sample is the documents of least hash of id and text, so it does not depend on
    partitioning. Rows without text or language are left out.
    """
    rows = training_sample(train, most_rows, key, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, Counter] = {}
        for b in batches:
            for language, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = total.setdefault(language, Counter())
                mine.update(dict(zip(*(x.tolist() for x in grams(text)), strict=True)))
        out = [(language, g, n) for language, mine in total.items() for g, n in mine.items()]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= k)
    profiles: dict[str, list] = {}
    for r in first.collect():  # k rows for each language
        profiles.setdefault(r["lang"], []).append((r["r"], r["gram"]))
    return {language: np.array([g for _, g in sorted(rows)], np.int64) for language, rows in sorted(profiles.items())}


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], k: int = 300, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every whole text.

    ``und`` with score 0 for null texts, texts without letters, and when there is no profile. The
    score is one minus the best distance as a share of the largest possible. Ties go to the first
    language by name. Repeated rows get repeated predictions; only ``key`` and ``text`` are read.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    names = sorted(profiles)
    every = np.unique(np.concatenate([profiles[n] for n in names])) if names else np.empty(0, np.int64)
    places = np.full((len(every) + 1, len(names)), k, np.int64)  # the last row: in no profile
    for j, n in enumerate(names):
        places[np.searchsorted(every, profiles[n]), j] = np.arange(len(profiles[n]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1)):
            language, score = [], []
            for text in b.column(1).to_pylist():
                top = ranking(*grams(text or ""), k)
                if not len(top) or not names:
                    language.append("und")
                    score.append(0.0)
                    continue
                at = np.searchsorted(every, top)
                at[at == len(every)] = 0
                at = np.where(every[at] == top, at, len(every))
                of = places[at]
                distance = np.where(of == k, k, np.abs(of - np.arange(len(top))[:, None])).sum(axis=0)
                best = int(distance.argmin())
                language.append(names[best])
                score.append(1.0 - float(distance[best]) / (k * len(top)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(language, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5, held_fold: int = 0, k: int = 300, most_rows: int = 2000, key: str = "doc_id") -> DataFrame:
    """Fit on documents whose crc32(key as text) mod ``folds`` is not ``held_fold``; predict all."""
    train = docs.where(crc_mod(key, folds) != held_fold)
    out = predict(docs, fit_profiles(train, k, most_rows, key), k, key)
    return out.select("doc_id", (crc_mod("doc_id", folds) == held_fold).alias("held_out"), "lang_pred", "score")
