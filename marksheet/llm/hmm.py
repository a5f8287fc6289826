"""A hidden Markov language model trained by Baum-Welch over partitions.

Symbols are the end of a text, the ``symbols`` most frequent training tokens, and one class of all
rarer tokens. A rarer token's probability is that of the class times its share in the class, so the
model covers every text. Each task runs scaled forward and backward recursions over its documents,
many side by side, and emits expected counts; the counts of all tasks are added up and only the
model (states x symbols, a fixed size) reaches the driver. Scoring is the exact scaled forward
likelihood.

Token counts cover all training texts. The ``lookup`` most frequent tokens travel to the workers as
a table of fixed size; the counts of all others are found by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_mod, saved, slices

END, RARE, FIRST = 0, 1, 2
_BLOCK = 1024
_DOCS = 2000
_BYTES = 4 << 20
#: A text of more tokens than this is gone through in blocks of as many.
_TOKENS = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII whitespace, A-Z lower-cased."""
    return (text or "").encode().lower().split()


def token_counts(train: DataFrame) -> DataFrame:
    """token, c over ``_text``; every task counts its own rows first. The end of a text is token ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["token", "c"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = batch.column(0).slice(at, 500).to_pylist()
                for text in texts:
                    found.update(tokens_of(text))
                found[b""] += len(texts)
                if len(found) > 400_000:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return train.select("_text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """start (K), move (K x K), emit (symbols x K)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that tend to stay, emitting the unigram distribution each with its own fixed noise."""
    noise = np.random.default_rng(seed).normal(0, 1, (len(unigram), states))
    emit = unigram[:, None] * np.exp(noise)
    move = np.full((states, states), 0.2 / max(1, states - 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


class Lanes:
    """Documents laid end to end in parallel lanes, so that one array step moves all lanes by a token."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences])
        total = int(sizes.sum())
        lanes = int(max(1, min(len(sizes), 400, total // max(1, sizes.max()))))
        order = np.argsort(-sizes, kind="stable")
        ends, content = np.zeros(lanes, int), [[] for _ in range(lanes)]
        import heapq

        heap = [(0, k) for k in range(lanes)]
        for i in order:
            used, k = heapq.heappop(heap)
            content[k].append(i)
            ends[k] = used + sizes[i]
            heapq.heappush(heap, (int(ends[k]), k))
        self.steps = int(ends.max())
        self.symbols = np.zeros((lanes, self.steps), np.int32)
        self.first = np.zeros((lanes, self.steps), bool)
        self.real = np.zeros((lanes, self.steps), bool)
        self.at = np.zeros(len(sizes), np.int64)  # where each document starts, lane after lane
        self.sizes = sizes
        for k, mine in enumerate(content):
            at = 0
            for i in mine:
                self.symbols[k, at : at + sizes[i]] = sequences[i]
                self.first[k, at] = True
                self.at[i] = k * self.steps + at
                at += sizes[i]
            self.real[k, :at] = True
            self.first[k, at:] = True  # padding: every step starts anew
        self.first_lanes = [np.flatnonzero(c) for c in self.first.T]

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        emitted = model.emit[self.symbols.T]  # steps x lanes x states
        alpha, scale = np.empty_like(emitted), np.empty(emitted.shape[:2])
        now = None
        for t in range(self.steps):
            ahead = now @ model.move if t else np.empty_like(emitted[0])
            ahead[self.first_lanes[t]] = model.start
            ahead *= emitted[t]
            s = ahead.sum(axis=1)
            ahead /= s[:, None]
            alpha[t], scale[t], now = ahead, s, ahead
        return emitted, alpha, scale

    def log_likelihoods(self, scale: np.ndarray) -> np.ndarray:
        """Natural logarithm for each document, in the order given."""
        running = np.concatenate(([0.0], np.cumsum(np.where(self.real, np.log(scale.T), 0.0).ravel())))
        return running[self.at + self.sizes] - running[self.at]

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions, and the log likelihood."""
        emitted, alpha, scale = self.forward(model)
        emitted /= scale[:, :, None]
        beta = np.empty_like(alpha)
        beta[-1] = 1.0
        back = model.move.T.copy()
        for t in range(self.steps - 1, 0, -1):
            emitted[t] *= beta[t]  # from here on what flows back over the step to t
            beta[t - 1] = emitted[t] @ back
            emitted[t][self.first_lanes[t]] = 0.0
            beta[t - 1][self.first_lanes[t]] = 1.0
        k = len(model.start)
        moves = model.move * (alpha[:-1].reshape(-1, k).T @ emitted[1:].reshape(-1, k)) if self.steps > 1 else np.zeros((k, k))
        gamma = alpha
        gamma *= beta
        gamma[~self.real.T] = 0.0
        flat, where = gamma.reshape(-1, k), self.symbols.T.ravel()
        emissions = np.stack([np.bincount(where, flat[:, j], len(model.emit)) for j in range(k)], axis=1)
        starts = gamma[(self.first & self.real).T].sum(axis=0)
        return starts, moves, emissions, float(np.log(scale[self.real.T]).sum())


def _along(model: Model, symbols: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward over a block of one text, after the state probabilities ``before`` (none: its start)."""
    emitted = model.emit[symbols]
    alpha, scale = np.empty_like(emitted), np.empty(len(symbols))
    for t in range(len(symbols)):
        now = (model.start if before is None else before @ model.move) * emitted[t]
        scale[t] = now.sum()
        before = alpha[t] = now / scale[t]
    return emitted, alpha, scale


def long_log_likelihood(model: Model, symbols: np.ndarray, block: int = _TOKENS) -> float:
    """Natural logarithm for one text of any length, holding one block of it."""
    total, before = 0.0, None
    for at in range(0, len(symbols), block):
        _, alpha, scale = _along(model, symbols[at : at + block], before)
        total, before = total + float(np.log(scale).sum()), alpha[-1]
    return total


def long_expected(model: Model, symbols: np.ndarray, block: int = _TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """As ``Lanes.expected`` for one text of any length: forward once for what each block starts
    from, then backward block by block, each gone forward again."""
    k = len(model.start)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), 0.0
    marks: list[np.ndarray | None] = [None]
    for at in range(0, len(symbols), block):
        marks.append(_along(model, symbols[at : at + block], marks[-1])[1][-1])
    beta = np.ones(k)
    for i, at in reversed(list(enumerate(range(0, len(symbols), block)))):
        part = symbols[at : at + block]
        emitted, alpha, scale = _along(model, part, marks[i])
        total += float(np.log(scale).sum())
        flow, gamma = np.empty_like(alpha), np.empty_like(alpha)
        for t in range(len(part) - 1, -1, -1):
            gamma[t] = alpha[t] * beta
            flow[t] = emitted[t] / scale[t] * beta
            beta = model.move @ flow[t]
        before = alpha[:-1] if marks[i] is None else np.vstack([marks[i], alpha[:-1]])
        moves += model.move * (before.T @ flow[len(flow) - len(before) :])
        for j in range(k):
            emissions[:, j] += np.bincount(part, gamma[:, j], len(emissions))
        if marks[i] is None:
            starts = gamma[0]
    return starts, moves, emissions, total


def _expected(model: Model, sequences: list[np.ndarray]) -> list:
    short, long = [x for x in sequences if len(x) <= _TOKENS], [x for x in sequences if len(x) > _TOKENS]
    made = ([Lanes(short).expected(model)] if short else []) + [long_expected(model, x) for x in long]
    return [sum(parts[1:], parts[0]) for parts in zip(*made, strict=True)]


def _log_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    short = [i for i, x in enumerate(sequences) if len(x) <= _TOKENS]
    out = np.array([0.0 if len(x) <= _TOKENS else long_log_likelihood(model, x) for x in sequences])
    if short:
        lanes = Lanes([sequences[i] for i in short])
        out[short] = lanes.log_likelihoods(lanes.forward(model)[2])
    return out


def _symbols(text: str | None, known: dict[bytes, int], symbols: int) -> np.ndarray:
    words = tokens_of(text)
    found = np.fromiter((known.get(w, symbols) for w in words), np.int64, len(words))
    out = np.empty(len(words) + 1, np.int32)
    out[:-1] = np.where(found < symbols, found + FIRST, RARE)
    out[-1] = END
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in slices(batch, "_text", _DOCS, _BYTES))


def baum_welch(train: DataFrame, words: list[bytes], unigram: np.ndarray, states: int, rounds: int, least_gain: float = 0.0005) -> tuple[Model, list[float]]:
    """Fit on all rows of ``train`` (``_text``). Returns the model and the log likelihood before each round.

    Ends after ``rounds`` rounds, or when one has gained less than ``least_gain`` of the log likelihood.
    """
    sc = train.sparkSession.sparkContext
    vocabulary = sc.broadcast(words)
    model, likelihoods = first_model(unigram, states), []
    size = len(unigram)
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = {w: i for i, w in enumerate(vocabulary.value)}
            current = shared.value
            total = [np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0]
            for part in _groups(batches):
                got = _expected(current, [_symbols(x, known, len(known)) for x in part.column("_text").to_pylist()])
                for i, x in enumerate(got):
                    total[i] = total[i] + x
            flat = np.concatenate([[total[3]], total[0], total[1].ravel(), total[2].ravel()])
            blocks = [flat[i : i + _BLOCK * states] for i in range(0, len(flat), _BLOCK * states)]
            task = TaskContext.get().partitionId() % 32
            yield pa.RecordBatch.from_pydict({"block": list(range(len(blocks))), "salt": [task] * len(blocks), "v": [b.tobytes() for b in blocks]}, schema=pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("v", pa.binary())]))

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for v in batch.column("v").to_pylist():
                    v = np.frombuffer(v)
                    total = v.copy() if total is None else total + v
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "v"])

        counts = train.select("_text").mapInArrow(run, "block int, salt int, v binary")
        once = counts.groupBy("block", "salt").applyInArrow(add, "block int, v binary")
        rows = once.groupBy("block").applyInArrow(add, "block int, v binary").collect()  # the model: a fixed size
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r["v"]) for r in sorted(rows, key=lambda r: r["block"])])
        likelihoods.append(float(flat[0]))
        settled = len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < least_gain * abs(likelihoods[-2])
        starts, rest = flat[1 : 1 + states], flat[1 + states :]
        moves, emissions = rest[: states * states].reshape(states, states), rest[states * states :].reshape(size, states)
        # A little of the unigram distribution in each state, so that no symbol is impossible.
        emissions = emissions + unigram[:, None] * (1.0 + 0.002 * emissions.sum(axis=0))
        model = Model((starts + 1) / (starts + 1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))
        if settled:
            break
    return model, likelihoods


def _most_frequent(counts: DataFrame, most: int) -> list:
    """The ``most`` most frequent tokens, or all, most frequent first; equal counts by hash, then token.

    What is taken is narrowed down by histograms: of counts on a logarithmic scale, of the counts in
    the class that does not fit, of hashes among the tokens of the count that does not. So no task
    or driver sorts or holds more than the tokens returned and a histogram.
    """
    h = F.xxhash64("token")
    rows, left, taken = counts, most, []
    for column in (F.floor(F.log2("c") * 16).cast("long"), F.col("c"), F.shiftrightunsigned(h, 52), F.shiftrightunsigned(h, 40)):
        bins = sorted(rows.groupBy(column.alias("bin")).count().collect(), key=lambda b: -b["bin"])
        least = edge = None
        for b in bins:
            if b["count"] > left:
                edge = b["bin"]
                break
            left, least = left - b["count"], b["bin"]
        if least is not None:
            taken += rows.where(column >= least).collect()
        if edge is None or not left:
            break
        rows = rows.where(column == edge)
    else:
        taken += rows.orderBy("token").limit(left).collect()
    return sorted(taken, key=lambda x: (-x["c"], x["token"]))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1, states: int = 8, symbols: int = 16_000, lookup: int = 200_000, rounds: int = 3) -> DataFrame:
    """Score every whole text by the hidden Markov model and by smoothed token counts.

    Learns from documents whose crc32(key as text) mod ``folds`` is not ``held_fold``. Returns
    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10). Null texts count
    as empty: one end token. Texts of any length are scored whole. Repeated rows are scored alike (and learnt from as often); with no
    training rows every count is 0. An empty table gives an empty result.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"), (crc_mod(key, folds) == held_fold).alias("held_out"))
    train = rows.where("not held_out")
    counts = saved(token_counts(train), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = _most_frequent(counts.where("token != ''"), lookup)
    ends = next((r["c"] for r in counts.where("token = ''").collect()), 0)
    words, head_c = [r["token"].encode() for r in head], np.array([r["c"] for r in head], float)
    symbols = min(symbols, len(words))
    rare_n, rare_v = n - ends - head_c[:symbols].sum(), max(0, v - 1 - symbols)
    unigram = np.concatenate(([ends, rare_n], head_c[:symbols])) + 0.5
    unigram /= unigram.sum()
    model, _ = baum_welch(train, words[:symbols], unigram, states, rounds)

    sc = spark.sparkContext
    shared = sc.broadcast((words, head_c, model))
    base_log, rare_log = np.log10(n + 0.5 * (v + 1)), np.log10(rare_n + 0.5 * (rare_v + 1))
    end_log = np.log10(ends + 0.5)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"_row long, doc_id {kind}, held_out boolean, n_tokens long, _known long, _base double, _score double, _tokens array<string>, _times array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, head_c, model = shared.value
        known = {w: i for i, w in enumerate(words)}
        miss = len(words)
        log_c = np.append(np.log10(head_c + 0.5), 0.0)
        row = TaskContext.get().partitionId() << 33
        for part in _groups(batches):
            out: list[tuple] = []
            sequences = []
            for text in part.column("_text").to_pylist():
                mine = tokens_of(text)
                at = np.fromiter((known.get(w, miss) for w in mine), np.int64, len(mine))
                sequence = np.empty(len(mine) + 1, np.int32)
                sequence[:-1] = np.where(at < symbols, at + FIRST, RARE)
                sequence[-1] = END
                sequences.append(sequence)
                logs = log_c[at]
                found = at < miss
                rare = Counter(mine[i] for i in np.flatnonzero(~found))
                # Rare tokens in the lookup table add their share of the class here, the others after the join.
                inside = at >= symbols
                out.append((len(mine) + 1, int(found.sum()) + (ends > 0), logs.sum() + end_log - (len(mine) + 1) * base_log, logs[inside].sum() - inside.sum() * rare_log, list(rare), list(rare.values())))
            likelihood = _log_likelihoods(model, sequences) / np.log(10)
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(out)), pa.int64()), part.column("doc_id"), part.column("held_out"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()),
                    pa.array(np.array(columns[3]) + likelihood, pa.float64()), pa.array(columns[4], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(columns[5], pa.list_(pa.int32())),
                ],
                names=["_row", "doc_id", "held_out", "n_tokens", "_known", "_base", "_score", "_tokens", "_times"],
            )
            row += len(out)

    scored = saved(rows.mapInArrow(run, schema), "scored")
    seldom = scored.select("_row", F.explode(F.arrays_zip(F.col("_tokens").alias("token"), F.col("_times").alias("times"))).alias("x")).select("_row", "x.token", "x.times")
    seldom = seldom.join(counts, "token", "left").select("_row", "times", F.coalesce("c", F.lit(0)).alias("c"))
    added = seldom.groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("_more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_more_known"))
    more = F.coalesce(F.col("_more"), F.lit(0.0))
    return scored.drop("_tokens", "_times").join(added, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("_known") + F.coalesce("_more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("_base") + more).alias("base_score"), (F.col("_score") + more).alias("score"),
    )
