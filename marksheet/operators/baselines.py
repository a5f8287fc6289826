"""Baseline predictors as distributed jobs: constant prior, and TF-IDF with ridge regression."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as C
from ..sources.io import settled
from .sheets import many_parts


def global_prior(df: DataFrame) -> DataFrame:
    """The snapped mean of training grades for every test row, null elsewhere."""
    mean = df.where("split = 'train'").agg(C.snap_to_grade(F.avg(C.to_numeric(F.col("grade")))).alias("_prior"))
    return df.crossJoin(F.broadcast(mean)).withColumn("prediction", F.when(F.col("split") == "test", F.col("_prior"))).drop("_prior")


def usable(df: DataFrame) -> DataFrame:
    """Training rows: split 'train' with a grade."""
    return df.where("split = 'train' AND grade IS NOT NULL")


#: A vocabulary is sent to the tasks while its terms take at most so many bytes.
SENT = 64 << 20


def vocabulary(counts: DataFrame, min_df: float, size: int, weight: str | None = None) -> DataFrame:
    """(term, number, df) of the ``size`` most frequent terms that ``min_df`` rows or more have.

    counts: (row, term, tf), and a column ``weight`` that says how many rows a row stands for. Terms
    are numbered by falling total, ties in the order of terms.
    """
    times = F.lit(1) if weight is None else F.col(weight)
    seen = counts.groupBy("term").agg(F.sum(times).alias("df"), F.sum(F.col("tf") * times).alias("_total")).where(F.col("df") >= min_df)
    order = [F.desc("_total"), F.col("term")]
    # A window over at most ``size`` rows.
    return seen.orderBy(*order).limit(size).select("term", (F.row_number().over(Window.orderBy(*order)) - 1).alias("number"), "df")


#: Characters whose terms one task counts.
_CHARS = 1_000_000


def _weighted(df: DataFrame, text: str, tokens: Column, out: str, min_df: float, size: int, weight: str | None) -> DataFrame:
    """``out``: size, and sorted indices and values of 1 + ln tf, times ln((1 + n) / (1 + df)) + 1, scaled to length one.

    ``tokens`` are those of a column ``_text``. Equal texts have equal features, so different texts are
    written down once, with how many training rows have them. They are dealt to as many tasks as their
    length asks for before terms are made; a task counts the terms of its own texts and meets them with
    the vocabulary, so no term is moved but for the vocabulary. That has at most ``size`` rows; where
    its terms are long it is joined by a shuffle instead of being sent.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    times = F.lit(1) if weight is None else F.col(weight)
    used = F.sum(F.when((F.col("split") == "train") & F.col("grade").isNotNull(), times).otherwise(0))
    texts = settled(df.groupBy(whole.alias("_text")).agg(used.alias("_uses")).select(F.monotonically_increasing_id().alias("_row"), "_text", "_uses"), "texts")
    n, chars = texts.agg(F.coalesce(F.sum("_uses"), F.lit(0)), F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()
    dealt = texts.repartition(max(many_parts(df), -(-chars // _CHARS)), "_row")
    counts = dealt.select("_row", "_uses", F.explode(tokens).alias("term")).groupBy("_row", "_uses", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = settled(vocabulary(counts.where("_uses > 0"), min_df, size, "_uses"), "vocabulary")
    terms, held = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    share = (1 + F.ln("tf")) * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1)
    met = counts.join(F.broadcast(known) if held <= SENT else known, "term").select("_row", F.struct("number", share.alias("w")).alias("_t"))
    lists = met.groupBy("_row").agg(F.array_sort(F.collect_list("_t")).alias("_t")).withColumn("_length", F.sqrt(F.aggregate("_t", F.lit(0.0), lambda a, t: a + t["w"] * t["w"])))
    made = F.struct(F.lit(terms).alias("size"), F.coalesce(F.col("_t.number"), F.array().cast("array<int>")).alias("indices"), F.coalesce(F.transform("_t", lambda t: t["w"] / F.col("_length")), F.array().cast("array<double>")).alias("values"))
    features = settled(dealt.join(lists, "_row", "left").select("_text", made.alias(out)), "features")
    kept = [c for c in df.columns if c != out]
    return df.withColumn("_whole", whole).join(features, F.col("_whole") == F.col("_text"), "left").select(*kept, features[out])


def tfidf_word_features(df: DataFrame, text: str, out: str = "features", longest: int = 2, min_df: float = 2, size: int = 50_000, weight: str | None = None) -> DataFrame:
    """Word 1-grams, or 1-2-grams, of tokens of two or more word characters; fitted on the training rows.

    ``weight`` names a column of how many rows a row stands for."""
    # Fixed value: the token pattern.
    one = F.regexp_extract_all(F.lower("_text"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    two = F.transform(F.sequence(F.lit(1), F.size(one) - 1), lambda i: F.concat(F.get(one, i - 1), F.lit(" "), F.get(one, i)))
    both = F.concat(one, F.when(F.size(one) > 1, two).otherwise(F.array().cast("array<string>"))) if longest > 1 else one
    return _weighted(df, text, both, out, min_df, size, weight)


def tfidf_char_features(df: DataFrame, text: str, out: str = "features", low: int = 3, high: int = 5, min_df: float = 2, size: int = 80_000, weight: str | None = None) -> DataFrame:
    """Character n-grams inside space-padded words, a shorter word once as a whole; fitted on the training rows."""
    padded = F.transform(F.filter(F.split(C.normalize_text(F.col("_text")), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w, n):
        cut = F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: F.substring(w, i, n))
        none = F.array().cast("array<string>")
        return F.when(F.char_length(w) >= n, cut).otherwise(F.array(w) if n == low else none)

    every = F.flatten(F.transform(padded, lambda w: F.concat(*(grams(w, n) for n in range(low, high + 1)))))
    return _weighted(df, text, F.coalesce(every, F.array().cast("array<string>")), out, min_df, size, weight)


def side_by_side(parts: Sequence[str]) -> Column:
    """Several feature columns as one: their places follow each other."""
    moved = lambda indices, start: F.transform(indices, lambda i: i + start)
    size, places, values = F.lit(0), [], []
    for p in parts:
        places.append(moved(F.col(f"{p}.indices"), size))
        values.append(F.col(f"{p}.values"))
        size = size + F.col(f"{p}.size")
    return F.struct(size.alias("size"), F.concat(*places).alias("indices"), F.concat(*values).alias("values"))


#: Coefficients that travel in one row.
_BLOCK = 8192


def _parts(df: DataFrame, features: str) -> tuple[Column, Column, Column]:
    """Places, values and size of a feature column: one made here, or a vector of the engine's own, sparse or dense."""
    if df.schema[features].dataType.typeName() == "struct":
        return F.col(f"{features}.indices"), F.col(f"{features}.values"), F.col(f"{features}.size")
    v = F.unwrap_udt(features)
    every = F.when(F.size(v["values"]) > 0, F.sequence(F.lit(0), F.size(v["values"]) - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(v["indices"], every), v["values"], F.coalesce(v["size"], F.size(v["values"]))


def _flat(places: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places and values of a batch, and the row of each."""
    sizes = np.diff(places.offsets.to_numpy())
    return places.flatten().to_numpy(zero_copy_only=False), values.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)


def _summed(rows: DataFrame, run) -> np.ndarray:
    """The sum of the vectors that ``run`` makes of the tasks' batches, in blocks that are added over tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = run(batches)
        for i in range(0, len(total), _BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array([i // _BLOCK], pa.int32()), pa.array([total[i : i + _BLOCK].tobytes()], pa.binary())], names=["block", "v"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(v) for b in batches for v in b.column("v").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "v"])

    found = rows.mapInArrow(cut, "block int, v binary").groupBy("block").applyInArrow(add, "block int, v binary").collect()
    return np.concatenate([np.frombuffer(r["v"]) for r in sorted(found, key=lambda r: r["block"])]) if found else np.zeros(0)


def _transposed(rows: DataFrame, size: int, along: np.ndarray, less: float) -> np.ndarray:
    """X'(X along - less), rows counted as often as they stand for: a vector of ``size`` reaches the driver."""
    shared = rows.sparkSession.sparkContext.broadcast(along)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, w = np.zeros(size), shared.value
        for b in batches:
            places, values, row = _flat(b.column(0), b.column(1))
            r = (np.bincount(row, values * w[places], b.num_rows) - less) * b.column(3).to_numpy(zero_copy_only=False)
            total += np.bincount(places, values * r[row], size)
        return total

    found = _summed(rows, run)
    shared.unpersist()
    return found if len(found) else np.zeros(size)


def _first_sums(rows: DataFrame, size: int, less: float) -> tuple[np.ndarray, np.ndarray]:
    """X'1 and X'(y - less)."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(2 * size)
        for b in batches:
            places, values, row = _flat(b.column(0), b.column(1))
            y, times = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            total[:size] += np.bincount(places, values * times[row], size)
            total[size:] += np.bincount(places, values * ((y - less) * times)[row], size)
        return total

    found = _summed(rows, run)
    return found[:size], found[size:]


#: Up to so many features their products with each other (at most 128 MB) are summed in one pass.
PRODUCTS = 4096


def _products(rows: DataFrame, size: int) -> np.ndarray:
    """X'X."""

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total, step = np.zeros((size, size)), max(1, 4_000_000 // size)
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step)):
            places, values, row = _flat(b.column(0), b.column(1))
            x = np.zeros((b.num_rows, size))
            np.add.at(x, (row, places), values)
            total += (x * b.column(3).to_numpy(zero_copy_only=False)[:, None]).T @ x
        return total.reshape(-1)

    # A task's sum is as large however few rows it has.
    return _summed(rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism), run).reshape(size, size)


def ridge(train: DataFrame, features: str, alpha: float = 1.0, tolerance: float = 1e-7, most: int = 300, weight: str | None = None) -> tuple[np.ndarray, float]:
    """Coefficients and intercept that minimise |y - Xw - b|^2 + alpha |w|^2.

    Equal rows are counted first (``weight``: how many rows a row stands for already). Up to
    ``PRODUCTS`` features the normal equations are summed in one pass and solved; more are solved by
    conjugate gradients, where every step is one pass over the rows. Columns are centred without being filled in.
    """
    places, values, wide = _parts(train, features)
    times = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = train.select(places.alias("places"), values.alias("values"), F.col("grade").cast("double").alias("y"), times.alias("times")).groupBy("places", "values", "y").agg(F.sum("times").alias("times")).persist()
    try:
        n, mean_y = rows.agg(F.coalesce(F.sum("times"), F.lit(0.0)), F.coalesce(F.sum(F.col("y") * F.col("times")) / F.sum("times"), F.lit(0.0))).first()
        first = train.select(wide.alias("n")).first()
        size = first["n"] if first else 0
        if not n or not size:
            return np.zeros(size), mean_y
        total, rest = _first_sums(rows, size, mean_y)
        mean, w = total / n, np.zeros(size)
        if size <= PRODUCTS and alpha > 0:
            w = np.linalg.solve(_products(rows, size) - n * np.outer(mean, mean) + alpha * np.eye(size), rest)
            return w, mean_y - float(mean @ w)
        step, left = rest, rest @ rest
        enough = tolerance**2 * left
        for _ in range(most):
            if left <= enough:
                break
            turned = _transposed(rows, size, step, float(mean @ step)) + alpha * step
            far = left / (step @ turned)
            w, rest = w + far * step, rest - far * turned
            before, left = left, rest @ rest
            step = rest + left / before * step
        return w, mean_y - float(mean @ w)
    finally:
        rows.unpersist()


def tfidf_ridge_predict(df: DataFrame, features: str, alpha: float = 1.0, raw: str | None = None, weight: str | None = None) -> DataFrame:
    """Ridge with intercept on training rows, clipped and snapped on test rows; ``raw`` keeps the estimate.

    Any number of features; without training rows every estimate is 0. ``weight`` names a column of
    how many rows a row stands for.
    """
    w, intercept = ridge(usable(df), features, alpha, weight=weight)
    shared = df.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def estimate(places: pd.Series, values: pd.Series) -> pd.Series:
        at, row = np.concatenate([*places, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(places)), places.map(len))
        return pd.Series(np.bincount(row, np.concatenate([*values, np.empty(0)]) * shared.value[at], len(places)) + intercept)

    out = df.withColumn("_raw", estimate(*_parts(df, features)[:2])).withColumn("prediction", F.when(F.col("split") == "test", C.snap_to_grade(F.col("_raw"))))
    return out.withColumnRenamed("_raw", raw) if raw else out.drop("_raw")


# The parts (kind, text, longest word n-gram, least training rows, terms) of each recipe.
RECIPES: Mapping[str, tuple[tuple[str, str, int, int, int], ...]] = {
    "v1_answer_word_unigram": (("word", "answer", 1, 2, 30_000),),
    "v2_answer_word_uni_bigram": (("word", "answer", 2, 2, 50_000),),
    "v3_qa_concat_word_uni_bigram": (("word", "both", 2, 2, 60_000),),
    "v4_question_and_answer_separate": (("word", "question", 2, 1, 20_000), ("word", "answer", 2, 2, 40_000)),
    "v5_answer_char_3_5": (("char", "answer", 0, 2, 80_000),),
    "v6_mixed_word_char_qa": (("word", "question", 2, 1, 15_000), ("word", "answer", 2, 2, 30_000), ("char", "answer", 0, 2, 40_000)),
}


def tfidf_variants(df: DataFrame, names: Sequence[str] = tuple(RECIPES)) -> DataFrame:
    """One prediction column for each feature recipe; test rows only, null elsewhere.

    Rows of equal texts, split and grade are one case, which is worked out once."""
    keys = ["question", "answer", "split", "grade"]
    df = settled(df, "answers")
    cases = settled(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times")), "cases")
    out = cases.withColumns({"_answer": C.normalize_text(F.col("answer")), "_question": C.normalize_text(F.col("question")), "_both": C.qa_concat(F.col("question"), F.col("answer"))})
    for name in names:
        made, parts = out, []
        for kind, text, longest, least, size in RECIPES[name]:
            parts.append(f"_{kind}_{text}")
            made = tfidf_word_features(made, f"_{text}", parts[-1], longest, least, size, "_times") if kind == "word" else tfidf_char_features(made, f"_{text}", parts[-1], min_df=least, size=size, weight="_times")
        made = made.withColumn("_features", side_by_side(parts))
        out = settled(tfidf_ridge_predict(made, "_features", weight="_times").withColumnRenamed("prediction", f"pred_tfidf_{name}").drop("_features", *parts), "predictions")
    found = out.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(f"pred_tfidf_{name}" for name in names))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(found, same, "left").drop(*(f"_k_{k}" for k in keys))
