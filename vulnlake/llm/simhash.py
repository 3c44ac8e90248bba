"""SimHash near-duplicates by a positional byte index with count filtering.

Two fingerprints within two bits differ in at most two of their eight bytes, so they share at least six positional
bytes. Single bytes are too common to pair up what they list, so the posting lists are keyed by the bytes of two of the
four byte pairs: at most two of these pairs are touched, hence linked fingerprints meet in at least one of six lists. A
list with over `LONGEST` fingerprints is split by two further positions; of the four it has left two at least are shared.
What a pair of fingerprints shares is tallied over the lists in which it meets, the positions of which are equal; bytes
of other positions are added. Pairs with six or more are verified bit by bit.

Only distinct fingerprints are indexed. A list by six positions that is still too long isn't paired up, as all its pairs
reach the count: its members get linked through keys that only fingerprints within two bits can share (their own bits,
and these with one bit turned).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import checkpointed, id_and_text, slices
from vulnlake.llm.graph import components

LONGEST = 32
#: Shingles whose hashes are held at once.
HASHED = 65_536
BITS_APART, BYTES_SHARED = 2, 6


def fingerprint(text: str, size: int = 3) -> int:
    words = text.encode().lower().split()  # of bytes: only A-Z change, only ASCII blanks split
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    for at in range(0, n, HASHED):  # so many hashes at a time, however long the text
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(at, min(n, at + HASHED))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            found = np.array([fingerprint(t or "", size) for t in part["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "bits"])

#: Rows of one fingerprint that a task takes at most, as far as `HOT_KEYS` allows, and how many fingerprints may have more.
HOT = 10_000
HOT_KEYS = 10_000


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """`doc_id, bits` (a signed 64-bit fingerprint) of every whole text; 0 for null and for texts without a word."""
    return id_and_text(docs).mapInArrow(lambda batches: fingerprint_rows(batches, size), "doc_id long, bits long")


def byte_at(bits: Column, k: int) -> Column:
    return F.shiftrightunsigned(bits, 8 * k).bitwiseAND(0xFF)


def postings(places: Iterable[tuple[int, ...]], first: Column) -> Column:
    """An array (mask, key): for each set of positions its mask, and one hash of the mask, `first` and the bytes there."""
    masks = [(p, sum(1 << k for k in p)) for p in places]
    return F.array(*[F.struct(F.lit(m).alias("mask"), F.xxhash64(first, F.lit(m), *[byte_at(F.col("bits"), k) for k in p]).alias("key")) for p, m in masks])


def lists_of(posted: DataFrame) -> DataFrame:
    """Posting lists (mask, key, bits) with their `count`, those of one fingerprint left out."""
    return checkpointed(posted.join(posted.groupBy("key").count().filter("count > 1"), "key"))


def paired(lists: DataFrame) -> DataFrame:
    """Rows (a, b, mask) for fingerprints that meet in a list that is not crowded."""
    short = lists.filter(F.col("count") <= LONGEST)
    return short.select("key", F.col("bits").alias("a"), "mask").join(short.select("key", F.col("bits").alias("b")), "key").filter("a < b").select("a", "b", "mask")


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect all distinct fingerprints (`bits`) within two bits, directly or through others."""
    twos = [(2 * i, 2 * i + 1, 2 * j, 2 * j + 1) for i, j in combinations(range(4), 2)]
    four = lists_of(distinct.select("bits", F.inline(postings(twos, F.lit(0)))))
    at_two = lambda p: postings(combinations([k for k in range(8) if k not in p], 2), F.col("key"))
    further = F.coalesce(*[F.when(F.col("mask") == sum(1 << k for k in p), at_two(p)) for p in twos])
    split = four.filter(F.col("count") > LONGEST).select("bits", "mask", F.explode(further).alias("more"))
    six = lists_of(split.select("bits", F.col("mask").bitwiseOR(F.col("more.mask")).alias("mask"), F.col("more.key").alias("key")))

    met = paired(four).union(paired(six)).groupBy("a", "b").agg(F.bit_or("mask").alias("mask"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    listed = F.bit_count("mask")
    others = sum((((F.shiftright("mask", k).bitwiseAND(1) == 0) & (byte_at(differ, k) == 0)).cast("int") for k in range(8)), F.lit(0))
    close = met.filter(listed + others >= BYTES_SHARED).filter(F.bit_count(differ) <= BITS_APART).select("a", "b")

    crowded = six.filter(F.col("count") > LONGEST).select("bits").distinct()
    turned = [F.col("bits").bitwiseXOR(F.lit(v - (1 << 64) if v >= 1 << 63 else v)) for v in (1 << k for k in range(64))]
    balls = crowded.select("bits", F.explode(F.array(F.col("bits"), *turned)).alias("near"))
    # all that share a ball are within two bits of each other
    stars = balls.groupBy("near").agg(F.min("bits").alias("a"), F.max("bits").alias("z"), F.count("*").alias("n")).filter("n > 1")
    twin = stars.filter("n = 2").select("a", F.col("z").alias("b"))
    more = balls.join(stars.filter("n > 2").select("near", "a"), "near").filter("bits <> a").select("a", F.col("bits").alias("b"))
    return close.union(twin).union(more)


def near_duplicates(docs: DataFrame, size: int = 3) -> DataFrame:
    """`doc_id, fingerprint, component_id`: 16 hex digits, and the smallest id that links of two bits or fewer reach.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay repeated and share a
    component; null ids count as larger than all others. An empty table gives no rows. Other columns are left out, whatever
    their names. Of a very long text `HASHED` shingles are hashed at a time.
    """
    marked = checkpointed(fingerprints(docs, size))
    distinct = checkpointed(marked.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(distinct.select("bits")))
    joined = distinct.join(roots, distinct["bits"] == roots["node"], "left").select("bits", "first", "n", F.coalesce("root", "bits").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(smallest, "root").select("bits", "n", "component_id")
    return told(marked, named, distinct).select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def told(marked: DataFrame, named: DataFrame, distinct: DataFrame) -> DataFrame:
    """`marked` with the component of each row's fingerprint. The rows of a frequent one are dealt into parts of about
    `HOT` rows (a 10,000th of the table if that is more, so that at most 10,000 fingerprints are broadcast as frequent)."""
    total = distinct.agg(F.sum("n")).first()[0] or 0
    size = max(HOT, -(-total // HOT_KEYS))
    parts = F.ceil(F.col("n") / size)
    hot = distinct.filter(F.col("n") > size).select("bits", parts.alias("parts"))
    # places of rows in a checkpointed table stay as they are
    dealt = marked.withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(hot), "bits", "left")
    dealt = dealt.select("doc_id", "bits", F.pmod("place", F.coalesce("parts", F.lit(1))).alias("part"))
    copies = named.select("bits", "component_id", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return dealt.join(copies, ["bits", "part"])
