"""Ranked lexical search by scanning documents with an Aho-Corasick automaton of all item terms.

No index of the documents is built. The terms of the items (the queries) are guarded by a boundary
on both sides and put in one automaton, which every task gets and runs over the whole text of its
documents: an output of the automaton is one occurrence of a term. A first pass writes the counts of
each document, from which document frequencies and lengths are summed; a second pass over those
counts, not over the texts, adds up scores by the items that each term leads to. Tasks keep the best
documents of each item, which are merged in two steps.

The automaton is broadcast, so its size is bounded: items are dealt into blocks whose terms take at
most ``most_bytes``, and each block is a scan of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import saved, slices

#: Fixed values of the contract: ASCII that is no letter or digit ends a term; only A-Z are lower-cased.
_BREAKS = bytes(b for b in range(0x80) if not chr(b).isalnum())
_PLAIN = bytes.maketrans(_BREAKS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_BREAKS) + b"abcdefghijklmnopqrstuvwxyz")
#: Scores are summed as doubles while they stay whole numbers there.
_WHOLE = 2**53


def plain(text: bytes | None) -> bytes:
    """The text with every break a space and A-Z lower-cased, between two spaces."""
    return b" " + (text or b"").translate(_PLAIN) + b" "


def count_terms(guarded: bytes) -> int:
    """How many terms a text from ``plain`` has, with repeats."""
    inside = np.frombuffer(guarded, np.uint8) != 0x20
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term) rows."""
    source = items.select(F.col(key).alias("item"), F.col(text).cast("binary").alias("_text"))
    kind = source.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                found = [sorted(set(plain(t).split(b" ")) - {b""}) for t in part.column(1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), pa.array([t.decode() for f in found for t in f], pa.string())], names=["item", "term"])

    return source.mapInArrow(run, f"item {kind}, term string").distinct()


def scan(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """Per document its id, n terms, and the numbers and counts of the given terms that it holds."""
    source = docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("_text"))
    kind = source.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for number, term in enumerate(sent.value):
            machine.add_word(f" {term} ", number)
        machine.make_automaton()
        for batch in batches:
            for part in slices(batch, 1, 2000):
                n, ids, counts = [], [], []
                for t in part.column(1).to_pylist():
                    guarded = plain(t)
                    found = Counter(map(itemgetter(1), machine.iter(guarded.decode()))) if len(machine) else {}
                    n.append(count_terms(guarded))
                    ids.append(list(found.keys()))
                    counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    return source.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>")


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, unnamed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each item: highest score, then smallest id, null ids last."""
    order = np.lexsort((doc, unnamed, -score, item))
    its = item[order]
    first = np.flatnonzero(np.concatenate(([True], its[1:] != its[:-1])))
    place = np.arange(len(its)) - np.repeat(first, np.diff(np.append(first, len(its))))
    return order[place < k]


def best_of_tasks(hits: DataFrame, leads: tuple[np.ndarray, np.ndarray], weights: np.ndarray, item_ids: list, kind: str, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, id, score): the k best documents of each item among those of a task.

    ``leads``: where the items of each term start, and the items.
    """
    at, items = leads
    degree = np.diff(at)
    n_items = len(item_ids)
    most_terms = int(np.bincount(items, minlength=1).max()) if len(items) else 0
    as_doubles = most_terms * int(weights.max(initial=0)) * 1_000_000 < _WHOLE
    sent = hits.sparkSession.sparkContext.broadcast((at, items, weights, item_ids))
    item_kind = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, items, weights, item_ids = sent.value
        item, score, doc = (np.empty(0, np.int64) for _ in range(3))
        unnamed = np.empty(0, bool)
        least = np.zeros(n_items, np.int64)
        for whole in batches:
            # As many documents at a time as have some million (document, item) sums.
            step = max(1, 2_000_000 // max(1, n_items))
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                lists, counts = batch.column(2), batch.column(3)
                term, tf = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
                if not len(term):
                    continue
                row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
                m = 50 + (50 * batch.column(1).to_numpy() * n_docs) // n_terms
                worth = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                each = degree[term]
                to = np.repeat(at[term] - np.cumsum(each) + each, each) + np.arange(each.sum())
                cell = np.repeat(row, each) * n_items + items[to]
                if as_doubles:
                    sums = np.bincount(cell, np.repeat(worth, each), batch.num_rows * n_items).astype(np.int64)
                else:
                    sums = np.zeros(batch.num_rows * n_items, np.int64)
                    np.add.at(sums, cell, np.repeat(worth, each))
                good = np.flatnonzero((sums > 0) & (sums >= np.tile(least, batch.num_rows)))
                ids = batch.column(0)
                item, score = np.append(item, good % n_items), np.append(score, sums[good])
                doc = np.append(doc, ids.cast(pa.int64()).fill_null(0).to_numpy()[good // n_items])
                unnamed = np.append(unnamed, ids.is_null().to_numpy(zero_copy_only=False)[good // n_items])
                keep = _best(item, score, doc, unnamed, k)
                item, score, doc, unnamed = item[keep], score[keep], doc[keep], unnamed[keep]
                full = np.flatnonzero(np.bincount(item, minlength=n_items) == k)
                lowest = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, item, score)
                least[full] = lowest[full]
        yield pa.RecordBatch.from_arrays([pa.array(item_ids, item_kind).take(pa.array(item)), pa.array(doc, pa.int64(), mask=unnamed), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return hits.mapInArrow(run, f"item {kind}, id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", most_bytes: int = 32 << 20, salts: int = 64) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item.

    Ids are integers. Null and empty texts have no terms: such a document counts for nothing, such an
    item has no rows. Rows that repeat an item's id are one item with the terms of both; documents
    that repeat an id are ranked one by one. Equal scores are ordered by id, null ids last. Empty
    tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    pairs = saved(item_terms(items, item_key, item_text), "item-terms")
    kind = pairs.schema["item"].dataType.simpleString()
    size = pairs.agg(F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // most_bytes) if size > most_bytes else 1)
    found = []
    for block in range(blocks):
        # An item stays whole, so a block is bounded by its share and the longest single item.
        rows = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(terms)}
        item_ids = sorted({r["item"] for r in rows}, key=lambda i: (i is None, i or 0))
        place = {i: n for n, i in enumerate(item_ids)}
        term = np.array([number[r["term"]] for r in rows], np.int64)
        item = np.array([place[r["item"]] for r in rows], np.int64)
        leads = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms))))), item[np.argsort(term, kind="stable")]
        hits = saved(scan(docs, terms, key, text), "hits")
        n_docs, n_terms = hits.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(terms), np.int64)
        for t, df in hits.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the terms of the block
            weights[t] = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))))
        found.append(best_of_tasks(hits, leads, weights, item_ids, kind, n_docs, max(1, n_terms), k).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))))
    if not found:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = (F.desc("score"), F.asc_nulls_last("id"))
    some = every.withColumn("_place", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("_place") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")
