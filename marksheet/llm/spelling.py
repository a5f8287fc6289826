"""Spelling variants by one-edit neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced forms at most one edit apart,
so the full neighbourhood of a reduced word (itself, every deletion, insertion and replacement) holds
the reduced form of each word near it, and over a few symbols that neighbourhood is small. Its
members are looked up in the reduced vocabulary, and every pair of words met that way is verified on
the words themselves. Reduced words and neighbours are polynomials in 64 bits, made for all words of
one length at once. A bitmap of fixed size over the reduced vocabulary drops most neighbours that no
word has before anything is shuffled; a full bitmap only lets more of them through to the join.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, saved, slices

_U = np.uint64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BACK = pow(_BASE, -1, 1 << 64)
#: The bitmap has _PARTS parts of _PART_BITS bits (16 MB in all), whatever the vocabulary.
_PARTS, _PART_BITS = 4096, 32768


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_counts(docs: DataFrame, key: str, text: str, shortest: int, delete_one_in: int | None, most_words: int = 400_000) -> DataFrame:
    """(word, n) over all documents; tasks send sums for up to ``most_words`` words at a time."""
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).cast("binary").alias("_text"))
    run_of = re.compile(rf"[a-zÀ-ÿ]{{{shortest},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sums() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, 1):
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = Counter(run_of.findall((t or b"").translate(_LOWER).decode()))
                    if delete_one_in:
                        start = zlib.crc32(f"{name}:".encode())
                        for word, n in found.items():
                            h = zlib.crc32(word.encode(), start)
                            if h % delete_one_in == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < shortest:
                                    continue
                            total[word] += n
                    else:
                        total.update(found)
                if len(total) > most_words:
                    yield sums()
        yield sums()

    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as a matrix of symbols 1 to ``symbols``."""
    points = np.array(words, f"U{len(words[0])}").view(np.uint32).reshape(len(words), -1).astype(_U)
    return _mix(points + _U(1)) % _U(symbols) + _U(1)


def neighbourhoods(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: the reduced code of each, and a row of the codes of its neighbourhood."""
    s = _symbols(words, symbols)
    n, length = s.shape
    with np.errstate(over="ignore"):
        power = np.array([pow(_BASE, i, 1 << 64) for i in range(length + 1)], _U)
        before = np.zeros((n, length + 1), _U)  # before[:, i]: the polynomial of the first i symbols
        np.cumsum(s * power[:length], axis=1, out=before[:, 1:])
        code = before[:, -1:]
        after = code - before  # after[:, i]: that of the symbols from i on
        choices = np.arange(1, symbols + 1, dtype=_U)
        deleted = before[:, :-1] + after[:, 1:] * _U(_BACK)
        inserted = (before + after * _U(_BASE))[:, :, None] + (power[:, None] * choices)[None]
        replaced = (code - s * power[:length])[:, :, None] + (power[:length, None] * choices)[None]
        every = np.concatenate([deleted, inserted.reshape(n, -1), replaced.reshape(n, -1)], axis=1)  # replacing by itself is the word
        return _mix(code[:, 0]), _mix(every)


def _by_length(words: list[str], most_codes: int, symbols: int) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length with their places, so many that their neighbourhoods have ``most_codes`` codes."""
    sizes = np.array([len(w) for w in words])
    for length in np.unique(sizes):
        places = np.flatnonzero(sizes == length)
        step = max(1, most_codes // (2 * (int(length) + 1) * (symbols + 1)))
        for i in range(0, len(places), step):
            some = places[i : i + step]
            yield some, [words[j] for j in some]


def _codes(words: DataFrame, symbols: int) -> DataFrame:
    """The rows with their reduced code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "word", 100_000):
                codes = np.empty(part.num_rows, np.int64)
                for places, some in _by_length(part.column("word").to_pylist(), 1 << 21, symbols):
                    s = _symbols(some, symbols)
                    with np.errstate(over="ignore"):
                        power = np.array([pow(_BASE, i, 1 << 64) for i in range(s.shape[1])], _U)
                        codes[places] = _mix((s * power).sum(axis=1, dtype=_U)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes)], names=[*part.schema.names, "code"])

    return words.mapInArrow(run, "word string, n long, code long")


def _bitmap(coded: DataFrame) -> np.ndarray:
    """Which of the bitmap's places the reduced vocabulary takes; at most _PARTS rows come to the driver."""
    place = F.pmod("code", F.lit(_PARTS * _PART_BITS))
    parts = coded.select((place / _PART_BITS).cast("int").alias("part"), (place % _PART_BITS).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros((_PARTS, _PART_BITS // 8), np.uint8)
    for p, bits in parts:
        out[p] = np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def _met(coded: DataFrame, symbols: int, bitmap: np.ndarray) -> DataFrame:
    """(word, n, code) with code every neighbour of the reduced word that the bitmap lets through, once."""
    sent = coded.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for part in slices(batch, "word", 20_000):
                words, n = part.column("word").to_pylist(), part.column("n")
                for places, some in _by_length(words, 1 << 21, symbols):
                    _, codes = neighbourhoods(some, symbols)
                    place = (codes % _U(_PARTS * _PART_BITS)).astype(np.int64)
                    row, column = np.nonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                    code = codes[row, column].view(np.int64)
                    order = np.lexsort((code, row))
                    row, code = row[order], code[order]
                    new = np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))[: len(row)]
                    at = pa.array(places[row[new]])
                    yield pa.RecordBatch.from_arrays([part.column("word").take(at), n.take(at), pa.array(code[new])], names=["word", "n", "code"])

    return coded.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _one_edit(a: str, b: str) -> bool:
    """Whether two different strings are one insertion, deletion or replacement apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verified(pairs: DataFrame) -> DataFrame:
    """The (word, n, other, m) that are exactly one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in ("word", "other"))
            yield batch.filter(pa.array([x != y and _one_edit(x, y) for x, y in zip(a, b, strict=True)], pa.bool_()))

    return pairs.mapInArrow(run, "word string, n long, other string, m long")


def alphabet_size(words: int, shortest: int) -> int:
    """The fewest symbols (4 to 16) with which reduced words of the shortest length outnumber the vocabulary."""
    return next((s for s in range(4, 16) if s**shortest >= words), 16)


def near_pairs(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, other, m) for every two of the distinct ``words`` (word, n) one edit apart, both ways."""
    coded = saved(_codes(words, symbols), "reduced")
    met = _met(coded, symbols, _bitmap(coded))
    pairs = met.join(coded.select("code", F.col("word").alias("other"), F.col("n").alias("m")), "code").where("word != other")
    return _verified(pairs.select("word", "n", "other", "m"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form) rows without cycles: forms followed to the last by doubling steps."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = saved(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        discard(now)
        now = step
        if not now.where("_moved").limit(1).count():
            return now.select("word", "root")


def group_variants(words: DataFrame, times: int = 10, shortest: int = 7, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct ``words`` (word, n).

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at
    least ``times`` the word's own, else null. As n grows along forms there are no cycles.
    """
    total = words.count()
    pairs = near_pairs(words, symbols or alphabet_size(total, shortest))
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"), F.first("n").alias("_n"))
    likes = F.when(-F.col("_best.m") >= times * F.col("_n"), F.struct(F.col("_best.other").alias("form"), (-F.col("_best.m")).alias("form_n")))
    near = saved(best.select("word", "n_near", likes.alias("_f")).select("word", "n_near", "_f.form", "_f.form_n"), "near-words")
    found = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(found, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, times: int = 10, delete_one_in: int | None = None) -> DataFrame:
    """Variants among the words of all documents: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of at least ``shortest``
    letters that occur ``least`` times over all documents. ``delete_one_in`` first spoils words: where
    it divides the crc32 of ``<id>:<word>`` a letter is deleted. Null and empty texts have no words, a
    null id counts as the empty string, repeated rows count each; an empty table gives an empty
    result; other columns are not read.
    """
    words = saved(word_counts(docs, key, text, shortest, delete_one_in).where(F.col("n") >= least), "words")
    return group_variants(words, times, shortest)
