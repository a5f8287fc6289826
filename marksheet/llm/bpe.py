"""Byte-level BPE as a monoid: encodings of neighbouring byte strings are joined, never redone.

``Bpe.encode_piece`` halves a piece down to short leaves, merges each leaf by rank and joins
neighbours up the tree. A join re-encodes a window of tokens around the seam and doubles it until
the tokens on both edges of the window are *compatible* with the untouched token beside them: a
pair is compatible when encoding its bytes alone gives the pair back. Rank merging acts on disjoint
segments independently, so a sequence whose neighbouring pairs are all compatible is the encoding
of the whole, and everything outside the window is proved stable.

A text is the concatenation of its pattern matches, and matches never depend on what lies beyond a
single space before a visible character. The text is therefore cut there, cuts that a worker meets
again are not encoded again (a cache of bounded bytes), and the identifiers are concatenated up to
the text. Decoding is the same monoid's other half: bytes of halves, concatenated up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import slices

#: A space before a visible character always starts a new match of the split pattern.
_SEAM = re.compile(r" (?=\S)")
_LEAF = 6
#: Tokens that decoding concatenates at a leaf of its tree.
_RUN = 1024
#: Bytes of text in each cache of a worker; a full one is emptied. An entry costs some 200 bytes more.
_CACHE = 4 << 20
_LONGEST = 64
_NONE = 1 << 40

ENCODED = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


class _Kept(dict):
    """Encodings of short strings, up to a number of bytes; longer strings are not kept."""

    size = 0

    def keep(self, key, n: int, value) -> None:
        if n > _LONGEST:
            return
        self.size += n
        if self.size > _CACHE:
            self.clear()
            self.size = n
        self[key] = value


class Bpe:
    """Ranks of one vocabulary file with tree encoding and decoding."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._seams, self._leaves, self._cuts = _Kept(), _Kept(), _Kept()

    def merge(self, piece: bytes) -> list[int]:
        """Rank merging from single bytes, lowest rank first and leftmost among equals."""
        n = len(piece)
        ranks = self.ranks
        if n < 64:
            parts = [piece[i : i + 1] for i in range(n)]
            pairs = [ranks.get(piece[i : i + 2], _NONE) for i in range(n - 1)]
            while pairs and (best := min(pairs)) < _NONE:
                i = pairs.index(best)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
                if i:
                    pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
            return [ranks[p] for p in parts]
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has changed since
            parts[i], parts[j] = parts[i] + parts[j], b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n and (r := ranks.get(both := parts[left] + parts[right])) is not None:
                    heapq.heappush(heap, (r, left, len(both)))
        return [ranks[p] for p in parts if p]

    def _seam(self, a: int, b: int) -> list[int]:
        """The encoding of two tokens' bytes put together."""
        found = self._seams.get((a, b))
        if found is None:
            found = self.merge(both := self.bytes_of[a] + self.bytes_of[b])
            self._seams.keep((a, b), len(both), found)
        return found

    def compatible(self, a: int, b: int) -> bool:
        return self._seam(a, b) == [a, b]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the two byte strings put together."""
        if not a or not b:
            return a or b
        left, right = 1, 1
        while True:
            i, j = max(0, len(a) - left), min(len(b), right)
            window = self._seam(a[i], b[0]) if left == right == 1 else self.merge(b"".join(map(self.bytes_of.__getitem__, a[i:] + b[:j])))
            left_ok = i == 0 or self.compatible(a[i - 1], window[0])
            right_ok = j == len(b) or self.compatible(window[-1], b[j])
            if left_ok and right_ok:
                return a[:i] + window + b[j:]
            left, right = left if left_ok else 2 * left, right if right_ok else 2 * right

    def _tree(self, piece: bytes) -> list[int]:
        if len(piece) <= _LEAF:
            found = self._leaves.get(piece)
            if found is None:
                found = self.merge(piece)
                self._leaves.keep(piece, len(piece), found)
            return found
        half = len(piece) // 2
        return self.join(self._tree(piece[:half]), self._tree(piece[half:]))

    def encode_piece(self, piece: bytes) -> list[int]:
        """One match of the pattern. A match that is itself a token stands for itself."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self._tree(piece)

    def _packed(self, cut: str) -> bytes:
        if cut.isascii() and cut.lstrip(" ").isalpha() and cut.rfind(" ") < 1:
            return array("I", self.encode_piece(cut.encode())).tobytes()  # one match, with or without its space
        return array("I", [i for m in self.pattern.findall(cut) for i in self.encode_piece(m.encode())]).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """All identifiers of a text as little-endian unsigned 32-bit integers."""
        first, *rest = _SEAM.split(text)
        cuts = self._cuts
        try:
            return self._packed(first) + b"".join(map(cuts.__getitem__, rest))
        except KeyError:
            new = {cut: self._packed(" " + cut) for cut in set(rest) if cut not in cuts}
            whole = b"".join([self._packed(first), *(new[cut] if cut in new else cuts[cut] for cut in rest)])
            for cut, ids in new.items():
                cuts.keep(cut, len(cut), ids)
            return whole

    def decode_packed(self, ids: bytes) -> bytes:
        """Concatenation up the tree: the bytes of two halves, joined, down to short runs of tokens."""
        return self._bytes_of(np.frombuffer(ids, "<u4").tolist())

    def _bytes_of(self, ids: list[int]) -> bytes:
        if len(ids) <= _RUN:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self._bytes_of(ids[:half]) + self._bytes_of(ids[half:])


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Bpe:
    """One per Python worker."""
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """Encode every whole text, decode the identifiers again and return digests of both.

    Null and empty texts have no tokens. Very long texts cost time in proportion to their length
    (long matches: length x log length). Repeated rows give repeated rows, an empty table an empty
    one. Only ``keep`` and ``text`` are read, so extra columns cannot clash.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    fields = [f for f in ENCODED.fields if with_ids or f.name != "ids"]
    schema = T.StructType([*rows.select(*keep).schema.fields, *fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for part in slices(batch, "_text"):
                out: dict[str, list] = {f.name: [] for f in fields}
                for text in part.column("_text").to_pylist():
                    ids = bpe.encode_packed(text)
                    decoded = bpe.decode_packed(ids)
                    out["n_tokens"].append(len(ids) // 4)
                    if with_ids:
                        out["ids"].append(ids)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    out["round_trip"].append(decoded == text.encode())
                kept = [part.column(c) for c in keep]
                made = [pa.array(out[f.name], {"n_tokens": pa.int64(), "ids": pa.binary(), "round_trip": pa.bool_()}.get(f.name, pa.string())) for f in fields]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *out])

    return rows.mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The inverse: packed identifiers to bytes (``decoded``). Null identifiers decode to nothing."""
    rows = encoded.select(*keep, F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            made = pa.array([bpe.decode_packed(x) for x in batch.column("_ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), made], names=[*keep, "decoded"])

    return rows.mapInArrow(decode, schema)
