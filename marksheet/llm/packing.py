"""Packing documents into token sequences by shortest-pack-first over the length histogram.

Only the histogram of piece lengths (at most ``size`` rows, whatever the corpus) reaches the
driver. Lengths are placed longest first, each into the emptiest open pack, so that one step places
many pieces at once by adjusting the counts of packing patterns. The placements come back as runs
of ranks within a length, and documents find theirs by their own rank within that length.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from array import array
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import saved, slices

# Fixed value: the split pattern of byte-level vocabulary files.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if printable, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def _encoder(path: str):
    """One per Python worker: a plain byte-level ``tokenizers`` file, run by its merge ranks.

    Where the order of identifiers is the order of merges, merging by identifier gives the
    library's own result. Added tokens are found in the text first, as the library does; files that
    trim spaces around them or look for whole words are not plain. Nothing is kept from one text to
    the next.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file["pre_tokenizer"]
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not file["normalizer"] and not model.get("ignore_merges")
    if not plain or merged != sorted(merged):
        raise ValueError(f"not a plain byte-level BPE file: {path}")
    byte_of, special = _letters(), {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in file["added_tokens"]) or any(a != b and a in b for a in special for b in special):
        raise ValueError(f"added tokens that depend on what is around them: {path}")
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)


def token_ids(path: str, texts: list[str]) -> Iterator[bytes]:
    """Packed little-endian identifiers of each whole text by a byte-level ``tokenizers`` file."""
    encode = _encoder(path).encode_to_numpy
    for text in texts:
        yield encode(text, allowed_special="all").astype("<u4", copy=False).tobytes()


def cut_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenise whole texts and cut them into full pieces of ``size`` and one shorter rest.

    Null texts count as empty (one token: the end id). Rows: ``key``, start, length, ids_crc32,
    doc_tokens, and _nth, the piece's number in its task.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[0], *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "_nth"))])
    end = array("I", [end_id]).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nth = 0
        for batch in batches:
            for part in slices(batch, 1):
                of, out = [], ([], [], [], [], [])
                for i, ids in enumerate(token_ids(path, part.column(1).to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, size):
                        piece = memoryview(ids)[4 * start : 4 * (start + size)]
                        of.append(i)
                        for column, v in zip(out, (start, len(piece) // 4, zlib.crc32(piece), total, nth), strict=True):
                            column.append(v)
                        nth += 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int32())), *(pa.array(c, pa.int64()) for c in out)], names=schema.names)

    return rows.mapInArrow(cut, schema)


def shortest_pack_first(histogram: Mapping[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset), ranks from 0.

    Lengths go longest first, each into the open pack with the most room left. A pattern is a run
    of consecutive sequences filled alike; placing fewer pieces than it has sequences splits it.
    """
    placed, sequences = [], 0
    open_packs: list[tuple[int, int, int]] = []  # (-room, first sequence, how many)
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        grown = []
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, first, many = heapq.heappop(open_packs)
                room = -room
                n = min(many, left)
                if n < many:
                    heapq.heappush(open_packs, (-room, first + n, many - n))
                placed.append((length, rank, n, first, size - room))
                if room > length:
                    heapq.heappush(open_packs, (-(room - length), first, n))
            else:
                n, room = left, size
                placed.append((length, rank, n, sequences, 0))
                grown.append((-(size - length), sequences, n))
                sequences += n
            rank, left = rank + n, left - n
            for g in grown:
                if g[0]:
                    heapq.heappush(open_packs, g)
            grown.clear()
    return placed


def pack(pieces: DataFrame, size: int = 2048, key: str = "doc_id", rows_per_block: int = 50_000) -> DataFrame:
    """Give every piece a sequence and an offset.

    Ranks within a length are exact and total: pieces are dealt into hash blocks (as many as the
    row count asks for), block counts are summed per length, and each block numbers its own rows
    from its first rank. So one length may hold any share of all rows. The ranks of a block and
    length are an interval, so each takes along just the placements that meet its interval. Ties
    (same length) go by block, then ``key`` and start; repeated rows are pieces of their own. An
    empty table packs to an empty table.
    """
    spark = pieces.sparkSession
    blocks = max(16, math.ceil(pieces.count() / rows_per_block))
    # With the number in the task, so that pieces of null or repeated ids are spread, too.
    more = ["_nth"] if "_nth" in pieces.columns else []
    pieces = pieces.withColumn("_block", F.pmod(F.xxhash64(key, "start", "ids_crc32", *more), F.lit(blocks)))
    counts = pieces.groupBy("length", "_block").count()
    first = counts.withColumn("_first", F.sum("count").over(Window.partitionBy("length").orderBy("_block")) - F.col("count"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `size` rows
    runs = spark.createDataFrame(shortest_pack_first(histogram, size), "length long, _from long, _many long, _sequence long, _offset long")
    meets = (F.col("_from") < F.col("_first") + F.col("count")) & (F.col("_from") + F.col("_many") > F.col("_first"))
    here = first.join(runs, "length").where(meets).groupBy("length", "_block").agg(F.first("_first").alias("_first"), F.array_sort(F.collect_list(F.struct("_from", "_many", "_sequence", "_offset"))).alias("_runs"))
    numbered = pieces.withColumn("_place", F.row_number().over(Window.partitionBy("length", "_block").orderBy(key, "start")))
    ranked = numbered.join(here, ["length", "_block"]).withColumn("_rank", F.col("_first") + F.col("_place") - 1)
    run = F.element_at(F.filter("_runs", lambda r: r["_from"] <= F.col("_rank")), -1)
    placed = ranked.withColumn("_run", run)
    return placed.select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("_run._sequence") + F.col("_rank") - F.col("_run._from")).alias("sequence_id"), F.col("_run._offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack a table of documents. See ``cut_pieces`` and ``pack``."""
    return pack(saved(cut_pieces(docs, path, size, end_id), "pieces"), size)
