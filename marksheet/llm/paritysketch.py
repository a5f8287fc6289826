"""N-gram Jaccard join by parity sketches: XOR-hashed blocks, pigeonhole join per size band, exact check.

A set of shingles is hashed by XOR: each shingle falls in a block of its size band's layout, and a
block's word is the XOR of what it got. A shingle that two sets share cancels out, so the blocks (or
bits) in which two sketches differ are at most as many as the elements in which the sets differ. Sets
of sizes a and b with a Jaccard of t or more differ in at most d = (a + b) (1 - t) / (1 + t) elements.

- Pigeonhole: of the blocks that either set fills, at most d differ. In any order of block values that
  holds for all sets, fewer than d + 1 come before the first one that both have, so it is enough to
  join by the first d + 1 filled blocks of each set, d being the largest that a partner can have. The
  order is rarest first: a set with more than d blocks that no other set has is joined with nothing. A
  band holds sizes from L to 2L - 1, and sets of up to 1.25 L that may have a smaller partner also go
  by the layout of the band below.
- Bits: a second sketch of 1024 bits (parity of the shingles on each) rules pairs out where the
  Hamming distance is more than d.
- Pairs that are left are confirmed on the sets themselves.

Sets that are equal are one node. Nodes that share a block are all paired with one, the pivot, whose
blocks are the most common; where that leaves several classes, pairs across classes follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bagminhash import components, shingles
from .common import discard, saved, slices

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: Bits of the second sketch, and the size from which blocks hold several shingles.
BITS, _SINGLE = 1024, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def most_apart(a: int, b: int, percent: int) -> int:
    """In how many elements sets of these sizes can differ at a Jaccard of ``percent`` or more."""
    return (a + b) * (100 - percent) // (100 + percent)


def bands_of(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, d + 1) for the bands by whose layout a set of this size is joined."""
    band = size.bit_length() - 1
    out = [(band, most_apart(size, size * 100 // percent, percent) + 1)]
    below = (1 << band) - 1
    if 100 * below >= percent * size:
        out.append((band - 1, most_apart(size, below, percent) + 1))
    return out


def blocks(h: np.ndarray, band: int, percent: int) -> np.ndarray:
    """Values of the filled blocks of sorted hashes; the lowest six bits of a value name the band.

    Up to 64 elements (and for thresholds under 75) each element is a block. Beyond, 0.8 L blocks hold
    one to three elements each, far more of them filled than d + 1.
    """
    with np.errstate(over="ignore"):
        salt = _mix(np.array([band + 1], _U) * _A)
        if (1 << band) < _SINGLE or percent < 75:
            words = _mix(h ^ salt)
        else:
            place = ((h >> _U(32)) * _U((1 << band) * 4 // 5)) >> _U(32)
            starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            words = _mix(np.bitwise_xor.reduceat(_mix(h ^ salt), starts) + _mix(place[starts] * _B + salt))
        return (words & ~_U(63)) | _U(band)


def parity_bits(h: np.ndarray) -> np.ndarray:
    """BITS parities as longs."""
    odd = (np.bincount((h & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def node_of(h: np.ndarray) -> int:
    """The number of a set: equal sets have equal numbers."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) >> 1


def sketch(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """doc_id, node (null without words), n, bits."""
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 256):
                sets = [h for h, _ in shingles(part.column(1).to_pylist(), width)]
                node = [node_of(h) if len(h) else None for h in sets]
                bits = [parity_bits(h) if len(h) else None for h in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node, pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "node", "n", "bits"])

    return source.mapInArrow(run, f"doc_id {kind}, node long, n long, bits array<long>")


def _runs(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows sorted by (value, node), and where each value begins."""
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (node[1:] != node[:-1])))[: len(value)]
    value, node = value[new], node[new]
    return value, node, np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))[: len(value)])


def shared_blocks(docs: DataFrame, width: int, percent: int, buckets: int, seed: int, text: str, most_bytes: int = 32 << 20) -> DataFrame:
    """(kind, value, df, node): the blocks that several nodes have, and the filled ones per node and band.

    kind 1: ``node`` has the block ``value``, as have about ``df`` nodes (copies of a node in other
    batches count again; all rows of a value have the same df). kind 2: ``value`` is a band, ``df``
    the node's filled blocks in it times 2^31, and its d + 1.

    Blocks travel packed, by ranges of values. A batch of documents sends one row entry of each value
    with its number of nodes, and its other nodes apart, so what is held for a value is one entry for
    each batch, however many nodes share it.
    """
    names = ["bucket", "kind", "value", "node", "number"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        filled: list[tuple[int, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]

            def put(*row) -> None:
                for column, x in zip(out, row, strict=True):
                    column.append(x)

            nodes = np.repeat(np.array(list(held), np.int64), [sum(map(len, v)) for v in held.values()])
            value, node, first = _runs(np.concatenate([x for v in held.values() for x in v] or [np.empty(0, _U)]), nodes)
            rest = np.ones(len(value), bool)
            rest[first] = False
            number = np.diff(np.append(first, len(value))).astype(np.int32)
            for kind, v, n, k in ((0, value[first], node[first], number), (1, value[rest], node[rest], None)):
                of = ((v >> _U(32)) * _U(buckets)) >> _U(32)  # sorted, as values are
                starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))[: len(of)])
                for i, j in zip(starts, np.append(starts[1:], len(of))[: len(starts)], strict=True):
                    put(int(of[i]), kind, v[i:j].tobytes(), n[i:j].tobytes(), None if k is None else k[i:j].tobytes())
            if filled:
                n, band, both = (np.array(x, np.int64) for x in zip(*filled, strict=True))
                put(int(n[0] % buckets), 2, band.tobytes(), n.tobytes(), both.tobytes())
            held.clear()
            filled.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.binary()) for x in out[2:])], names=names)

        for batch in batches:
            for part in slices(batch, 0, 256):
                for h, _ in shingles(part.column(0).to_pylist(), width):
                    if not len(h) or (node := node_of(h)) in held:
                        continue
                    if seed:
                        with np.errstate(over="ignore"):
                            h = np.sort(_mix(h ^ (_U(seed) * _C)))
                    held[node] = []
                    for band, need in bands_of(len(h), percent):
                        held[node].append(blocks(h, band, percent))
                        filled.append((node, band, (len(held[node][-1]) << 31) + need))
                size += part.nbytes
                if size > most_bytes:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def rows(kind: int, value: np.ndarray, df: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(value), 1 << 18):
            v, d, n = (x[i : i + (1 << 18)] for x in (value, df, node))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), kind, np.int32)), pa.array(v.view(np.int64)), pa.array(d.astype(np.int64)), pa.array(n)], names=["kind", "value", "df", "node"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by kind: all first entries of values, then the other nodes, then filled blocks.
        values, nodes, numbers = [np.empty(0, _U)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        known = df = None
        for batch in batches:
            for _, kind, value, node, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, n = np.frombuffer(value, _U), np.frombuffer(node, np.int64)
                if kind == 0:
                    values.append(v)
                    nodes.append(n)
                    numbers.append(np.frombuffer(number, np.int32))
                    continue
                if known is None:
                    known, df = yield from first_entries(values, nodes, numbers)
                if kind == 1:
                    yield from rows(1, v, df[np.searchsorted(known, v)], n)
                else:
                    yield from rows(2, v, np.frombuffer(number, np.int64), n)
        if known is None:
            yield from first_entries(values, nodes, numbers)

    def first_entries(values: list, nodes: list, numbers: list):
        value, node, number = map(np.concatenate, (values, nodes, numbers))
        for x in (values, nodes, numbers):
            x.clear()
        order = np.argsort(value, kind="stable")
        value, node, number = value[order], node[order], number[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))[: len(value)])
        df = np.add.reduceat(number.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
        each = np.repeat(df, np.diff(np.append(first, len(value))))
        several = each > 1
        yield from rows(1, value[several], each[several], node[several])
        return value[first], df

    dealt = docs.select(F.col(text).alias("_text")).mapInArrow(deal, "bucket int, kind int, value binary, node binary, number binary")
    return dealt.repartition(buckets, "bucket").sortWithinPartitions("kind").mapInArrow(meet, "kind int, value long, df long, node long")


def _filled_and_need(df: Column) -> tuple[Column, Column]:
    return F.shiftright(df, 31), df.bitwiseAND(F.lit((1 << 31) - 1))


def prefixes(shared: DataFrame) -> DataFrame:
    """(value, node, place, weight): each node's blocks among its first d + 1, rarest first.

    Blocks of a node alone come first in that order, and only their number counts.
    """
    rows = shared.repartition("node").distinct().withColumn("band", F.when(F.col("kind") == 1, F.col("value").bitwiseAND(F.lit(63).cast("long"))).otherwise(F.col("value")))
    band = Window.partitionBy("node", "band")
    of_node = Window.partitionBy("node")
    block = F.col("kind") == 1
    rank = F.count_if(block).over(band.orderBy("kind", "df", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumns({"_rank": rank, "_shared": F.count_if(block).over(band), "_both": F.max(F.when(~block, F.col("df"))).over(band)})
    filled, need = _filled_and_need(F.col("_both"))
    early = ranked.withColumn("place", filled - F.col("_shared") + F.col("_rank")).where(block & (F.col("place") <= need))
    return early.select("value", "node", "place", F.sum("df").over(of_node).alias("weight"))


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, most_sent: int = 1_000_000) -> DataFrame:
    """node and its set for the nodes in ``wanted``, made again from the text of one document of each.

    Up to ``most_sent`` nodes are sent to the texts (16 bytes each); beyond, texts are shuffled.
    """
    owners = saved(nodes.join(wanted, "node", "left_semi").select("node", F.col("rep").alias("_rep")), "owners")
    many = owners.count()
    sent = F.broadcast if many <= most_sent else (lambda x: x)
    texts = docs.join(sent(owners.select("_rep").distinct()), F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 256):
                full = [h for h, _ in shingles(part.column(0).to_pylist(), width) if len(h)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(h) for h in full], pa.int64()), pa.array([h.view(np.int64) for h in full], pa.list_(pa.int64()))], names=["node", "elements"])

    made = saved(texts.mapInArrow(run, "node long, elements array<long>").join(sent(owners.select("node")), "node", "left_semi"), "sets")
    discard(owners)
    if made.count() == many:
        return made
    # Ids that repeat gave some node more than once.
    once = saved(made.dropDuplicates(["node"]), "sets")
    discard(made)
    return once


def _far(x: Column, y: Column) -> Column:
    """Hamming distance of two sketches of bits."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two rows with n and bits are not ruled out by sizes or bits."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & ((100 + percent) * _far(F.col(f"{x}.bits"), F.col(f"{y}.bits")) <= (100 - percent) * (n + m))


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that neither sizes nor bits rule out."""
    x, y = (nodes.select("node", "n", "bits").alias(s) for s in ("x", "y"))
    return pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_may_link("x", "y", percent)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("e_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("e_b")), "b")
    shared = F.size(F.array_intersect("e_a", "e_b"))
    return saved(both.where(100 * shared >= percent * (F.size("e_a") + F.size("e_b") - shared)).select("a", "b"), "links")


def jaccard_components(docs: DataFrame, percent: int = 80, width: int = 5, key: str = "doc_id", text: str = "text", elements_a_bucket: int = 1 << 20) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when the Jaccard of their sets of ``width``-word shingles is ``percent`` / 100 or
    more (``percent`` from 51 to 100), and component_id is the smallest id that links reach. A text of
    fewer words is one shingle; null, empty and blank texts have none and link to nothing. Repeated
    rows and ids are documents each; a null id is never the smallest unless all are null. An empty
    table gives an empty result; other columns are not read.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be from 51 to 100")
    source = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    sketches = saved(sketch(docs, width, key, text), "sketches")
    nodes = saved(sketches.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes")
    elements = sketches.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seed = 0
    while True:
        shared = saved(shared_blocks(docs, width, percent, max(8, elements // elements_a_bucket), seed, text), "shared-blocks")
        if not shared.where((F.col("kind") == 2) & (_filled_and_need(F.col("df"))[0] < _filled_and_need(F.col("df"))[1])).limit(1).count():
            break
        # A node filled too few blocks: one in 10^15 does. All are drawn again by other hashes.
        discard(shared)
        seed += 1
    early = saved(prefixes(shared), "prefixes")
    discard(shared)
    pivots = early.groupBy("value").agg(F.max(F.struct("weight", "node")).alias("_p"), F.count("*").alias("_n")).where("_n > 1").select("value", F.col("_p.node").alias("pivot"))
    rest = early.select("value", "node", "place").join(pivots, "value").where("node != pivot")
    pairs = saved(rest.select(F.greatest("node", "pivot").alias("a"), F.least("node", "pivot").alias("b")).distinct(), "pairs")
    likely = saved(possible(pairs, nodes, percent), "likely")
    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, source, width)
    links = confirmed(likely, sets, percent)
    classes = components(links)
    discard(likely, sets)

    # Blocks that the pivot leaves in several classes; all pairs with the pivot are done.
    labelled = rest.join(classes, "node", "left").select("value", "node", "place", F.coalesce("class", "node").alias("class"))
    mixed = labelled.groupBy("value").agg(F.min("class").alias("_lo"), F.max("class").alias("_hi")).where("_lo != _hi").select("value")
    open_rows = saved(labelled.join(mixed, "value", "left_semi").join(nodes.select("node", "n", "bits"), "node"), "open")
    x, y = open_rows.alias("x"), open_rows.alias("y")
    # The first block that two sets share comes after d blocks at most, d being that of their own sizes.
    early_enough = (100 + percent) * (F.greatest("x.place", "y.place") - 1) <= (100 - percent) * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.class") < F.col("y.class")) & early_enough & _may_link("x", "y", percent))
    likely = saved(met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "likely")
    sets = sets_of(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, source, width)
    more_links = confirmed(likely, sets, percent)
    discard(early, pairs, open_rows, likely, sets, classes)
    classes = components(links.union(more_links))

    named = saved(nodes.join(classes, "node", "left").select("node", "rep", F.coalesce("class", "node").alias("class")), "named")
    least = saved(named.join(named.groupBy("class").agg(F.min("rep").alias("component_id")), "class").select("node", "component_id"), "smallest")
    worded = saved(sketches.where("node is not null").select("doc_id", "n", "node"), "worded")
    discard(named, classes)
    blank = sketches.where("node is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return worded.join(least, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(blank)
