"""Near-duplicates by BagMinHash: weighted-Jaccard signatures of shingle multisets, banded and verified.

A shingle of weight w (its number of occurrences) owns the weight axis (0, w], cut at the dyadic
points 1, 2, 4, ... Each dyadic interval is a Poisson process with a rate equal to its width; a
process that w cuts through is thinned by the weight level each point falls on, which is the
next step down the same hierarchy. Every point carries a time and one of the m signature
components, and a component keeps its earliest point. Two documents agree on a component with
probability sum(min) / sum(max) of their weights. Times are bounded by what fills all components,
so most shingles of a long text cost a single draw.

Candidates share a band. Inside a band bucket documents are compared with a pivot, the one that
shares the most buckets with others, not with each other; only members that the pivot leaves in
different classes are then compared further, by prefix filtering. Every link is confirmed on the
multisets themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import SPACES, discard, saved, slices

_U = np.uint64
_GOLD, _M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_ROOT = _U(0x100000001B3F4A7D)
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte is a space, and a 64-bit number for each byte, the same for A-Z as for a-z."""
    byte = np.arange(256)
    space = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    lower = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte).astype(_U)
    with np.errstate(over="ignore"):
        return space, _mix((lower + _U(1)) * _GOLD)


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``data`` (split at ASCII whitespace, A-Z lower-cased) and where they start."""
    space_of, number_of = _byte_tables()
    b = np.frombuffer(data, np.uint8)
    space = space_of[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, _U), starts
    place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate(([_U(1)], np.full(int(place.max()), _ROOT, _U))))
        values = number_of[b[starts[0] :]] * powers[place]
        values[space[starts[0] :]] = 0
        return _mix(np.add.reduceat(values, starts - starts[0])), starts


def word_hashes(texts: list[str | None], most_bytes: int = 4 << 20) -> list[np.ndarray]:
    """Hashes of the words of each text, some megabytes of text at a time."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        ends = np.cumsum([len(d) + 1 for _, d in held])
        h, starts = _hash_words(b" ".join(d for _, d in held) + b" ")
        for (i, _), part in zip(held, np.split(h, np.searchsorted(starts, ends)), strict=False):
            out[i].append(part)
        held.clear()

    for i, text in enumerate(texts):
        data, at = (text or "").encode(), 0
        while at < len(data):
            # A long text is cut after a word: at the first space past the size.
            cut = _SPACE.search(data, at + most_bytes)
            to = cut.end() if cut else len(data)
            held.append((i, data[at:to]))
            size, at = size + to - at, to
            if size >= most_bytes:
                flush()
                size = 0
    if held:
        flush()
    return [np.concatenate(parts) if parts else np.empty(0, _U) for parts in out]


def shingles(texts: list[str | None], width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct shingle hashes (sorted) and their counts. A text of fewer than
    ``width`` words is one shingle, one without words has none."""
    return [_shingles(h, width) for h in word_hashes(texts)]


def _shingles(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.empty(0, _U), np.empty(0, np.int64)
    width = min(width, len(h))
    with np.errstate(over="ignore"):
        all_of = np.zeros(len(h) - width + 1, _U)
        for k in range(width):
            all_of = all_of * _ROOT + h[k : len(h) - width + 1 + k]
        all_of = np.sort(_mix(all_of))
    first = np.flatnonzero(np.concatenate(([True], all_of[1:] != all_of[:-1])))
    return all_of[first], np.diff(np.append(first, len(all_of)))


def bag_set(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The multiset as a set: the i-th occurrence of a shingle is an element of its own."""
    if len(n) and n.max() > 1:
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            h = _mix(np.repeat(h, n) + nth.astype(_U) * _GOLD)
        return np.sort(h)
    return np.sort(_mix(h))


def signatures(hashes: list[np.ndarray], counts: list[np.ndarray], m: int) -> np.ndarray:
    """BagMinHash signatures (documents x m) of non-empty multisets."""
    docs = len(hashes)
    best = np.full(docs * m, np.inf)
    weight = np.array([c.sum() for c in counts], float)
    of = np.repeat(np.arange(docs), [len(h) for h in hashes])
    h, w = np.concatenate(hashes), np.concatenate(counts)
    # One process for each dyadic interval (low, high] that starts below the weight.
    seeds, owner, low, width, cap = [h], [of], [np.zeros(len(h))], [np.ones(len(h))], [w]
    j, start = 1, 1
    with np.errstate(over="ignore"):
        while (more := w > start).any():
            seeds.append(_mix(h[more] + _U(j) * _GOLD))
            owner.append(of[more])
            low.append(np.full(more.sum(), float(start)))
            width.append(np.full(more.sum(), float(start)))
            cap.append(w[more])
            j, start = j + 1, 2 * start
        seed, of, low, width, cap = map(np.concatenate, (seeds, owner, low, width, cap))
        every = seed, of, low, width, cap
        limit = m * (np.log(m) + 7) / weight
        t, k = np.zeros(len(seed)), 0
        block = 1
        while len(seed):
            draws = _mix(seed[:, None] + (np.arange(k, k + block, dtype=_U) * _U(2) + _U(1)) * _GOLD)
            gaps = -np.log(((draws >> _U(11)).astype(float) + 0.5) * 2.0**-53) / width[:, None]
            times = t[:, None] + np.cumsum(gaps, axis=1)
            marks = _mix(draws ^ _M2)
            component = ((marks >> _U(32)) * _U(m)) >> _U(32)
            level = low[:, None] + np.floor((marks & _U(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None]) + 1
            hit = (times <= limit[of][:, None]) & (level <= cap[:, None])
            at = (of[:, None] * m + component.astype(np.int64))[hit]
            np.minimum.at(best, at, times[hit])
            t, k = times[:, -1], k + block
            block = min(64, block * 4)
            live = t <= limit[of]
            if not live.any():
                empty = np.isinf(best.reshape(docs, m)).any(axis=1)
                if not empty.any():
                    break
                # Points of these documents past the old limit were not taken: draw them all again.
                limit = np.where(empty, limit * 2, limit)
                back = empty[every[1]]
                seed, of, low, width, cap = (x[back] for x in every)
                t, k, block = np.zeros(len(seed)), 0, 1
                continue
            seed, of, low, width, cap, t = seed[live], of[live], low[live], width[live], cap[live], t[live]
        return (best.view(_U).reshape(docs, m) * _GOLD) >> _U(32)


def sketch(docs: DataFrame, bands: int = 25, rows: int = 5, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, node (hash of the whole multiset, null for texts without words), n, sig, bands."""
    m = bands * rows
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 256):
                found = shingles(part.column(1).to_pylist(), width)
                full = [i for i, (h, _) in enumerate(found) if len(h)]
                node, n, sig, keys = ([None] * len(found) for _ in range(4))
                if full:
                    made = signatures([found[i][0] for i in full], [found[i][1] for i in full], m)
                    with np.errstate(over="ignore"):
                        key_of = np.zeros((len(full), bands), _U) + np.arange(1, bands + 1, dtype=_U)
                        for r in range(rows):
                            key_of = _mix(key_of * _ROOT + made[:, r::rows])
                    for i, s, b in zip(full, made.astype(np.uint32).view(np.int32), key_of.view(np.int64), strict=True):
                        h, c = found[i]
                        node[i] = xxhash.xxh3_64_intdigest(h.tobytes() + c.astype(np.int64).tobytes()) >> 1
                        n[i], sig[i], keys[i] = int(c.sum()), s, b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "sig", "bands"])

    return source.mapInArrow(run, f"doc_id {kind}, node long, n long, sig array<int>, bands array<long>")


def bags(docs: DataFrame, width: int = 5) -> DataFrame:
    """node and its multiset (as a set of longs) for rows of ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 256):
                node, bag = [], []
                for h, c in shingles(part.column(0).to_pylist(), width):
                    if len(h):
                        node.append(xxhash.xxh3_64_intdigest(h.tobytes() + c.astype(np.int64).tobytes()) >> 1)
                        bag.append(bag_set(h, c).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(bag, pa.list_(pa.int64()))], names=["node", "bag"])

    return docs.select("_text").mapInArrow(run, "node long, bag array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node and its class (smallest node) by alternating large-star and small-star steps.

    ``edges``: (a, b). Each step is aggregates and joins over the links alone, saved in the shared folder.
    """
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a != b").distinct()
        last, now = now, saved(small, "links")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            classes = saved(now.select(F.col("a").alias("node"), F.col("b").alias("class")), "classes-of-nodes")
            discard(now)
            return classes
        before = state


def _bags_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, name: str) -> DataFrame:
    """node and bag of the nodes in ``wanted``, made again from the text of one document of each."""
    owners = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.join(owners, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")
    return saved(bags(texts, width).join(wanted, "node", "left_semi").dropDuplicates(["node"]), f"{name}-bags")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that sizes and signatures do not rule out: a signature that agrees on less than
    ``threshold`` - 0.25 of its components is over five standard deviations away."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}"))
    agree = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")) & (agree >= (threshold - 0.25) * F.size("s_a"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b")


def _confirmed(likely: DataFrame, bag: DataFrame, threshold: float, name: str) -> DataFrame:
    """The pairs (a, b) whose multisets have a weighted Jaccard of ``threshold`` or more."""
    both = likely.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    shared = F.size(F.array_intersect("bag_a", "bag_b"))
    return saved(both.where(shared >= threshold * (F.size("bag_a") + F.size("bag_b") - shared)).select("a", "b"), f"{name}-links")


def _prefixes(bag: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The first elements, rarest first, of each bag that has a partner at ``threshold`` by them alone."""
    elements = bag.select("node", F.size("bag").cast("double").alias("n"), F.explode("bag").alias("element"))
    counts = elements.groupBy("element").agg(F.count("*").alias("_df"))
    placed = elements.join(counts, "element").withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("_df", "element")))
    return saved(placed.where((F.col("_df") > 1) & (F.col("pos") <= F.col("n") * (1 - threshold) + 1 + 1e-6)).join(classes, "node").select("element", "node", "class", "n", "pos"), "prefixes")


def _prefix_pairs(early: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes in different classes that may reach ``threshold``, by prefix filtering.

    With all elements in one order, rarest first, two bags that overlap enough share an element
    early in both, and the first one they share leaves enough elements after it. The shorter bag of
    a pair is indexed by its first elements and its size class, the longer one looks up each size
    class with just the elements that sizes of that class leave room for. In a large group of
    copies with edits of their own, those are the edits, not the text they have in common.
    """
    share = threshold / (1 + threshold)
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(1.02))).cast("int")
    short = early.where(F.col("pos") <= F.col("n") * (1 - 2 * share) + 1 + 1e-6).select("element", size_class(F.col("n")).alias("k"), F.struct("node", "class", "n", "pos").alias("x"))
    least = F.greatest(F.exp(F.col("k") * F.log(F.lit(1.02))), threshold * F.col("n"))
    long = early.withColumn("k", F.explode(F.sequence(size_class(F.greatest(threshold * F.col("n") - 1e-6, F.lit(1.0))), size_class(F.col("n")))))
    long = long.where(F.col("pos") <= F.col("n") - share * (least + F.col("n")) + 1 + 1e-6).select("element", "k", F.struct("node", "class", "n", "pos").alias("y"))
    need = share * (F.col("x.n") + F.col("y.n")) - 1e-6
    after = lambda s: F.col(f"{s}.n") - F.col(f"{s}.pos") + 1
    order = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    s, l = short.alias("s"), long.alias("l")
    hit = (F.col("s.element") == F.col("l.element")) & (F.col("s.k") == F.col("l.k")) & order & (F.col("x.class") != F.col("y.class")) & (after("x") >= need) & (after("y") >= need)
    return s.join(l, hit).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.8, bands: int = 25, rows: int = 5, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept.

    Classes are the connected components of links with a weighted Jaccard of ``threshold`` or more
    between five-word shingle multisets; class_id is the class's largest doc_id, the one that is
    kept. Documents with equal multisets form one node from the start, so copies cost one row each.
    Null, empty and blank texts link to nothing. Repeated rows fall in one class; a null id counts
    as the smallest. An empty table gives an empty result; extra columns are not read.
    """
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    sketches = saved(sketch(docs, bands, rows, width, key, text), "sketches")
    nodes = saved(sketches.where("node is not null").groupBy("node").agg(F.max("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "nodes")
    spread = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread.groupBy("key").count().where("count > 1")
    counted = saved(spread.join(shared, "key"), "members")
    weight = counted.groupBy("node").agg(F.sum("count").alias("_weight"))
    members = saved(counted.join(weight, "node").select("key", "node", "_weight"), "weighted")
    discard(counted)

    def against_pivot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(key, node, pivot) without the pivot's own row; distinct pairs."""
        pivots = rows.groupBy("key").agg(F.max(F.struct("_weight", "node")).alias("_p")).select("key", F.col("_p.node").alias("pivot"))
        rest = rows.join(pivots, "key").where("node != pivot")
        return rest, rest.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct()

    rest, pairs = against_pivot(members)
    first_pairs = saved(pairs, "pairs")
    likely = saved(_likely(first_pairs, nodes, threshold), "pivot-likely")
    likely_bags = _bags_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, source, width, "pivot")
    links = _confirmed(likely, likely_bags, threshold, "pivot")
    discard(likely, likely_bags)
    classes = components(links)

    # Buckets that the pivot leaves in more than one class: the pivot is done, the others go on.
    labelled = members.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    split = labelled.groupBy("key").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).where("_lo != _hi").select("key")
    open_rows = rest.select("key", "node").join(split, "key", "left_semi").select("node").distinct()
    open_rows = saved(open_rows.join(classes, "node", "left").select("node", F.coalesce("class", "node").alias("class")), "open")
    open_bags = _bags_of(open_rows.select("node"), nodes, source, width, "open")
    early = _prefixes(open_bags, open_rows, threshold)
    more = saved(_prefix_pairs(early, threshold).join(first_pairs, ["a", "b"], "left_anti"), "more-pairs")
    rest_links = _confirmed(more, open_bags, threshold, "rest")
    discard(classes, members, first_pairs, open_rows, open_bags, early, more)
    classes = components(links.union(rest_links))

    # Texts without words are a class each; they take no part in the joins.
    worded = sketches.where("node is not null").select("doc_id", "node")
    of_doc = saved(worded.join(classes, "node", "left").select("doc_id", F.coalesce("class", "node").alias("class")), "of-doc")
    discard(classes, links, rest_links, nodes)
    # Saved, so that the join below is dealt anew and a large class can be split over tasks.
    sizes = saved(of_doc.groupBy("class").agg(F.max("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    out = of_doc.join(sizes, "class").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
    blank = sketches.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return out.union(blank)


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each class, all columns unchanged.

    A row is found again by id and text, so null ids and ids that repeat over different texts lose
    nothing. Texts without words link to nothing and all stay.
    """
    rows = docs.withColumn("_row", F.struct(F.col(key).alias("id"), F.unhex(F.sha2(F.col(text).cast("binary"), 256)).alias("sha")))
    worded = F.coalesce(F.col(text), F.lit("")).rlike(f"[^{SPACES}]")
    keep = near_duplicates(rows.where(worded), threshold, key="_row", text=text, **options).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    stay = rows.where(worded).join(keep, F.col("_row") == F.col("_keep"), "left_semi").dropDuplicates(["_row"])
    return stay.union(rows.where(~worded)).drop("_row")
