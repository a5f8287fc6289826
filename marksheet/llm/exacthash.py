"""Exact duplicates by an extendible-hash index in shared files, with DataFrame functions only.

The directory maps a prefix of the 64-bit key to a bucket. It starts with one bucket at depth 0. A
bucket with more than ``capacity`` different keys splits by one more bit; when a bucket as deep as
the directory splits, the directory doubles, and buckets that did not split are named by several of
its slots. Owner tasks each take the texts of their keys, compare them byte by byte and write the
index: an entry for each different text, entries of equal keys chained. The directory gives each
entry its bucket, and the index is written in ranges of buckets. Copies find their bucket by the
directory and their entry by key and place in the chain: a chain of one entry holds every text of
its key, in a longer one the bytes of the text decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, discard, saved

KEY_BITS = 64

#: Keys are counted by this many more bits at a time, at most 65,536 rows for each bucket that is too full.
COUNTED_BITS = 16

#: Groups of more than one row in so many are met in a broadcast join; there are fewer of them than this.
HOT_GROUPS = 10_000


def digest() -> Column:
    return F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")


def key_of(text: Column, bits: int) -> Column:
    """The first ``bits`` of the text's 64-bit hash, the rest zero."""
    return F.xxhash64(text) if bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), 64 - bits)


def prefix(key: str, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Buckets (_prefix, local_depth, bucket) over distinct ``_key`` rows, and the directory's depth.

    Only whether a bucket is too full reaches the driver, once for each doubling. Rounds read counts of
    keys by prefix; past every ``COUNTED_BITS`` bits the keys of full buckets are counted once more. Both
    halves of a bucket become buckets, an empty one too, so every slot of the directory has its bucket.
    """
    keys = saved(keys, "exact-keys")
    depth, known, used, buckets = 0, 0, [keys], []
    now = saved(keys.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(0).cast("long").alias("_prefix"), "_n"), "exact-buckets")
    while True:
        used.append(now)
        buckets.append(now.where(F.col("_n") <= capacity).select("_prefix", F.lit(depth).alias("local_depth")))
        full = now.where(F.col("_n") > capacity).select(F.col("_prefix").alias("_parent"))
        if not full.head(1):
            break
        if depth == known:
            known = depth + COUNTED_BITS
            inside = keys.withColumn("_parent", prefix("_key", depth)).join(full, "_parent", "left_semi")
            counts = saved(inside.groupBy(prefix("_key", known).alias("_counted")).agg(F.count(F.lit(1)).alias("_n")), "exact-counts")
            used.append(counts)
        # Every bucket that is too full is as deep as the directory, so the directory doubles.
        depth += 1
        halves = full.select(F.explode(F.array(F.col("_parent") * 2, F.col("_parent") * 2 + 1)).alias("_prefix"))
        within = counts.groupBy(F.shiftrightunsigned("_counted", known - depth).alias("_prefix")).agg(F.sum("_n").alias("_n"))
        now = saved(halves.join(within, "_prefix", "left").select("_prefix", F.coalesce("_n", F.lit(0)).alias("_n")), "exact-buckets")
    first_key = F.when(F.col("local_depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(_prefix, 64 - local_depth)"))
    out = saved(reduce(DataFrame.union, buckets).withColumn("bucket", first_key), "exact-directory")
    discard(*used)
    return out, depth


def slots(buckets: DataFrame, depth: int) -> DataFrame:
    """The directory's entries (_slot, bucket, local_depth): every slot of ``depth`` bits that a bucket covers."""
    run = F.lit(depth) - F.col("local_depth")
    first = F.call_function("shiftleft", F.col("_prefix"), run)
    last = first + F.call_function("shiftleft", F.lit(1).cast("long"), run) - 1
    return buckets.select(F.explode(F.sequence(first, last)).alias("_slot"), "bucket", "local_depth")


def in_bucket(rows: DataFrame, buckets: DataFrame, depth: int) -> DataFrame:
    """Rows with a ``_key``, with the bucket that the directory has for it."""
    return rows.withColumn("_slot", prefix("_key", depth)).join(slots(buckets, depth), "_slot").drop("_slot")


def _rows(docs: DataFrame, key: str, text: str, bits: int) -> DataFrame:
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(key).alias("doc_id"), lower.alias("_text")).withColumn("_key", key_of(F.col("_text"), bits))


def chained(rows: DataFrame) -> DataFrame:
    """Owner tasks insert the texts of their keys: _key, links, chain (from 1, in byte order), _text.

    Tasks insert their own texts first, so any number of copies reaches the owner as one text a task.
    A row holds the chain of one key, that is the different texts with one 64-bit hash.
    """
    owned = rows.groupBy("_key").agg(F.array_sort(F.collect_set("_text")).alias("_texts"))
    return owned.select("_key", F.size("_texts").cast("long").alias("links"), F.posexplode("_texts").alias("_at", "_text")).withColumn("chain", F.col("_at") + 1).drop("_at")


def index_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 20_000, bits: int = KEY_BITS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Write the index. Returns thin rows of all documents, the entries, the buckets and the directory's depth.

    thin: doc_id, _key. entries: bucket, local_depth, _key, chain (from 1), links (length of the chain),
    text_sha256.
    """
    rows = _rows(docs, key, text, bits)
    thin = saved(rows.select("doc_id", "_key"), "exact-thin")
    buckets, depth = directory(thin.select("_key").distinct(), capacity)
    entries = in_bucket(chained(rows).select("_key", "links", "chain", digest()), buckets, depth)
    return thin, saved(entries.repartitionByRange("bucket", "_key"), "exact-index"), buckets, depth


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 20_000, bits: int = KEY_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z; null counts as empty. The largest
    ``doc_id`` of a group stays. Repeated rows are each returned and counted; those with the kept
    id are all marked kept. Null ids never win unless a group has no other. An empty table gives an
    empty result; extra columns are not read. ``bits`` shortens the key, so that texts collide.
    """
    thin, entries, buckets, depth = index_texts(docs, key, text, capacity, bits)
    found = thin.withColumn("chain", F.lit(1))
    shared = entries.where("links > 1").select("_key").distinct()
    if shared.head(1):  # keys that more than one text has: the texts themselves are compared
        rows = _rows(docs, key, text, bits).join(shared, "_key", "left_semi")
        links = chained(rows).select("_key", "chain", F.col("_text").alias("_entry_text"))
        walked = rows.join(links, "_key").where(F.col("_text") == F.col("_entry_text")).select("doc_id", "_key", "chain")
        found = saved(found.join(shared, "_key", "left_anti").select("doc_id", "_key", "chain").union(walked), "exact-found")
        discard(thin)
    copies = found.groupBy("_key", "chain").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entry = ["bucket", "_key", "chain"]
    groups = saved(in_bucket(copies, buckets, depth).join(entries.select(*entry, "text_sha256"), entry).drop("bucket", "local_depth"), "exact-groups")
    # Fewer than HOT_GROUPS groups are larger than this, whatever the data, so they fit a broadcast; no
    # key of the other join has more rows.
    most = (groups.agg(F.sum("group_size")).head()[0] or 0) // HOT_GROUPS
    hot, cold = F.broadcast(groups.where(F.col("group_size") > most)), groups.where(F.col("group_size") <= most)
    names = ["_key", "chain"]
    out = found.join(hot, names).unionByName(found.join(hot.select(*names), names, "left_anti").join(cold, names))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, all columns unchanged.

    A row is found again by id and text, so null ids and ids that repeat over different texts lose
    nothing. Of rows with one id and one text whose other columns differ, any one may stay.
    """
    keep = exact_duplicates(docs, key, text, **options).where("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_keep_text")).distinct()
    rows = docs.withColumn("_row_text", F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256))
    stay = rows.join(keep, rows[key].eqNullSafe(keep["_keep"]) & (rows["_row_text"] == keep["_keep_text"]), "left_semi")
    return stay.dropDuplicates(["_row_text"]).drop("_row_text")
