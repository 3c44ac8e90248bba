"""A trie of rebuilt conversations, on fingerprints that are put together without the texts.

The fingerprint of turns t0, t1, .. is the sum of hash(ti) * base^i modulo three primes. Sequences form a monoid under
it: a head's product and a suffix's product, moved by a power of the base, make the product of the whole. So a rebuilt
conversation's prefixes come from the base's head sums and the own turns' running sums; no rebuilt text is made, and a
prefix keeps only a reference to its last turn (conversation, place).

Prefixes of one depth and fingerprint are a node. Equal fingerprints and equal last turns leave equal fingerprints one
turn up, so nodes are right if in each all last turns are equal: their texts are fetched by reference and compared,
and on a clash all is done again with other bases.

Subtrees need no walk down the trie: a node is owned by its smallest member, whose owned nodes are the lower end of its
path; what a conversation owns from a depth on is a running sum along it, and a node's subtree is what its members own
there. A conversation is worked on in cells of its turns, and what a few nodes with very many members tell is broadcast.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vulnlake.llm.common import checkpointed, removed, written
from vulnlake.operators.ordering import cells_of

PRIMES = (2147483647, 2147483629, 2147483587)
KEY = ["depth", "k0", "k1", "k2"]
#: A conversation's head are fewer turns than this, of the first of its block of conversations.
MOST_HEAD, BLOCK = 6, 100
#: A node with more members than this, and than a `MOST_HUBS`th of all prefixes, is told by broadcast: `MOST_HUBS` at most.
HUB_MEMBERS, MOST_HUBS = 1000, 10_000
#: Ids of a node's last members are joined in chunks of this range before they are hashed in order.
CHUNK = 4096


def power(place: Column, base: int, prime: int) -> Column:
    """base ** place modulo the prime, from tables for the digits of `place` in base 64 (places below 2**30)."""
    x = F.lit(1).cast("long")
    for digit in range(5):
        table = ", ".join(f"{pow(base, j << 6 * digit, prime)}L" for j in range(64))
        x = x * F.get(F.expr(f"array({table})"), F.shiftright(place, 6 * digit).bitwiseAND(63).cast("int")) % prime
    return x


def numbered(convs: DataFrame, bases: list[int], seed: int, rows_a_cell: int | None) -> DataFrame:
    """conv_id, cell_, place, the hash products g0..g2 of the turn at its place, chars, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).filter("conv_id IS NOT NULL")
    turns = cells_of(turns, "turn", "cell_", rows_a_cell)
    before = W.partitionBy("conv_id").orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)
    starts = turns.groupBy("conv_id", "cell_").agg(F.count("*").alias("n")).select("conv_id", "cell_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("conv_id", "cell_").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    placed = turns.withColumn("inside", inside).join(starts, ["conv_id", "cell_"]).withColumn("place", F.col("before") + F.col("inside"))
    a, b = (F.xxhash64(F.lit(seed + s), "role", "text") for s in (0, 1))
    hashes = [F.pmod(x, F.lit(p)) for x, p in zip((F.shiftrightunsigned(a, 32), a.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(b, 32)), PRIMES)]
    products = [(h * power(F.col("place"), g, p) % p).alias(f"g{k}") for k, (h, g, p) in enumerate(zip(hashes, bases, PRIMES))]
    return placed.select("conv_id", "cell_", "place", *products, F.length("text").cast("long").alias("chars"), "role", "text")


def prefix_rows(turns: DataFrame, bases: list[int]) -> DataFrame:
    """Every prefix of every rebuilt conversation: conv_id, cell_, length, depth, fingerprint, chars and reference of its
    last turn (turn_conv, turn_place)."""
    cells = turns.groupBy("conv_id", "cell_").agg(F.count("*").alias("n"), *[F.sum(f"g{k}").alias(f"g{k}") for k in range(3)])
    before = W.partitionBy("conv_id").orderBy("cell_").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("conv_id", "cell_", F.sum("n").over(W.partitionBy("conv_id")).alias("n"), *[F.coalesce(F.sum(f"g{k}").over(before), F.lit(0)).alias(f"b{k}") for k in range(3)])
    first = turns.filter(F.col("place") < MOST_HEAD - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "g0", "g1", "g2", "chars"))).alias("first"))
    # the head of a block, for those of its conversations that take it
    own = first.withColumns({"taken": F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD, "base": F.col("conv_id") - F.col("conv_id") % BLOCK})
    heads = own.join(first.select(F.col("conv_id").alias("base"), F.col("first").alias("head")), "base", "left")
    heads = heads.withColumn("head", F.slice(F.coalesce("head", F.array().cast(first.schema["first"].dataType)), F.lit(1), F.col("taken").cast("int")))
    total = lambda a, k: F.aggregate(a, F.lit(0).cast("long"), lambda s, e: s + e[f"g{k}"]) % PRIMES[k]
    sums = [x for k in range(3) for x in (total("head", k).alias(f"head{k}"), total(F.slice("first", F.lit(1), F.col("taken").cast("int")), k).alias(f"skip{k}"))]
    heads = heads.select("conv_id", "base", "taken", "head", F.size("head").cast("long").alias("head_size"), *sums)
    starts = cells.join(heads, "conv_id").withColumn("length", F.col("head_size") + F.greatest(F.col("n") - F.col("taken"), F.lit(0)))
    # own turns after the head
    up_to = W.partitionBy("conv_id", "cell_").orderBy("place")
    narrow = turns.select("conv_id", "cell_", "place", "g0", "g1", "g2", "chars")
    run = narrow.select("conv_id", "cell_", "place", "chars", *[F.sum(f"g{k}").over(up_to).alias(f"s{k}") for k in range(3)])
    rows = run.join(starts.drop("head", "base", "n"), ["conv_id", "cell_"]).filter("place >= taken")
    back = [[pow(g, -j, p) for j in range(MOST_HEAD)] for g, p in zip(bases, PRIMES)]
    moved = [F.get(F.array(*[F.lit(x).cast("long") for x in t]), (F.col("taken") - F.col("head_size")).cast("int")) for t in back]
    keys = [((F.col(f"head{k}") + moved[k] * F.pmod(F.col(f"b{k}") + F.col(f"s{k}") - F.col(f"skip{k}"), F.lit(p)) % p) % p).alias(f"k{k}") for k, p in enumerate(PRIMES)]
    depth = (F.col("head_size") + F.col("place") - F.col("taken") + 1).alias("depth")
    suffix = rows.select("conv_id", "cell_", "length", depth, *keys, "chars", F.col("conv_id").alias("turn_conv"), F.col("place").alias("turn_place"))
    # the head's prefixes, and the root
    lengths = starts.dropDuplicates(["conv_id"])
    upper = lengths.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("head_size"))))
    part = F.slice("head", F.lit(1), F.col("depth").cast("int"))
    last = F.get("head", (F.col("depth") - 1).cast("int"))
    head = upper.select(
        "conv_id", F.lit(-2).alias("cell_"), "length", "depth", *[total(part, k).alias(f"k{k}") for k in range(3)], F.when(F.col("depth") > 0, last["chars"]).otherwise(0).alias("chars"),
        F.when(F.col("depth") > 0, F.col("base")).alias("turn_conv"), F.when(F.col("depth") > 0, last["place"]).alias("turn_place"),
    )
    return suffix.unionByName(head)


def told(rows: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Prefixes with what their node says; crowded nodes tell it by a broadcast of at most `MOST_HUBS` rows."""
    hubs = nodes.filter(F.col("n_convs") > max(HUB_MEMBERS, count // MOST_HUBS))
    if hubs.isEmpty():
        return rows.join(nodes, KEY)
    return rows.join(F.broadcast(hubs), KEY).unionByName(rows.join(F.broadcast(hubs.select(KEY)), KEY, "left_anti").join(nodes, KEY))


def clashes(rows: DataFrame, turns: DataFrame) -> bool:
    """Whether a node's last turns differ, by their texts; `many` marks nodes with more than one turn to compare."""
    refs = rows.filter("many AND depth > 0").select(*KEY, F.col("turn_conv").alias("conv_id"), F.col("turn_place").alias("place")).distinct()
    texts = refs.join(turns.select("conv_id", "place", "role", "text"), ["conv_id", "place"])
    differ = (F.min("role") != F.max("role")) | (F.min("text") != F.max("text"))
    return not texts.groupBy(*KEY).agg(differ.alias("differ")).filter("differ").isEmpty()


def ends_hashes(rows: DataFrame) -> DataFrame:
    """Per node where conversations end: SHA-256 of their ids, ascending and comma-joined. Ids are joined in ranges of
    `CHUNK` first; a node's chunks then stream through one hash in order, so none is held whole."""
    ends = rows.filter("depth = length").withColumn("chunk", F.floor(F.col("conv_id") / CHUNK))
    chunks = ends.groupBy(*KEY, "chunk").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    kinds = pa.schema([(k, pa.int64()) for k in KEY] + [("ends_sha256", pa.string())])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch[c].to_pylist() for c in (*KEY, "ids")]):
                if key == at:
                    state.update(b",")
                else:
                    if at:
                        done.append((*at, state.hexdigest()))
                    at, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), kinds)], schema=kinds)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, state.hexdigest()), kinds)], schema=kinds)

    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(streamed, ", ".join(f"{k} long" for k in KEY) + ", ends_sha256 string")


def prefix_trie(convs: DataFrame, rows_a_cell: int | None = None, seed: int = 13) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the reference of its last turn (turn_conv, turn_place: the place counts from 0 in that conversation).

    Turns are ordered by turn (null first), ties by role and then text. Null roles and texts are empty ones; rows without
    a conv_id belong to no conversation and are left out. Repeated rows are turns of their own. An empty table gives no
    nodes, not even a root. Other columns are left aside, whatever their names.
    """
    spark = convs.sparkSession
    for attempt in range(8):
        draw = random.Random(seed + 1000 * attempt)
        bases = [draw.randrange(1 << 20, p - 1) for p in PRIMES]
        turns, place = written(numbered(convs, bases, seed + 1000 * attempt, rows_a_cell))
        rows = checkpointed(prefix_rows(turns, bases))
        turn = F.struct("turn_conv", "turn_place")
        nodes = checkpointed(rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), F.max("length").alias("deepest"), (F.min(turn) != F.max(turn)).alias("many")))
        known = checkpointed(told(rows, nodes, rows.count()))
        wrong = clashes(known, turns)
        removed(spark, place)
        if not wrong:
            break
    else:
        raise RuntimeError("fingerprints of different turns clash under all bases tried")
    mine = F.col("owner") == F.col("conv_id")
    known = known.withColumns({"saving": F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0), "leaf": (mine & (F.col("deepest") == F.col("depth"))).cast("long")})
    # along a conversation: what it owns from a depth on, and where that begins, cell by cell
    cells = known.groupBy("conv_id", "cell_").agg(F.sum("saving").alias("saving"), F.sum("leaf").alias("leaf"), F.max(F.when(~mine, F.struct("depth", "owner"))).alias("above"))
    later = W.partitionBy("conv_id").orderBy("cell_").rowsBetween(1, W.unboundedFollowing)
    after = lambda c: F.coalesce(F.sum(c).over(later), F.lit(0))
    starts = cells.select("conv_id", "cell_", after("saving").alias("saving_after"), after("leaf").alias("leaf_after"), F.max("above").over(W.partitionBy("conv_id")).alias("above"))
    on = W.partitionBy("conv_id", "cell_").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    paths = known.withColumns({"saving": F.sum("saving").over(on), "leaf": F.sum("leaf").over(on)}).join(starts, ["conv_id", "cell_"])
    begins = F.coalesce(F.col("above.depth") + 1, F.lit(0))  # a conversation's first node of its own
    below = (F.col("depth") + 1 >= begins) & (F.col("depth") < F.col("length"))
    parent = F.when(F.col("depth") > begins, F.col("conv_id")).otherwise(F.col("above.owner"))
    reference = F.struct("turn_conv", "turn_place")
    made = paths.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("owner") == F.col("conv_id"), parent)).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.sum(below.cast("long")).alias("n_children"),
        F.sum(F.col("leaf") + F.col("leaf_after")).alias("n_leaves"), F.sum(F.col("saving") + F.col("saving_after")).alias("saved_tokens"), F.max(F.when(F.col("owner") == F.col("conv_id"), reference)).alias("turn"),
    )
    none = hashlib.sha256(b"").hexdigest()
    return made.join(ends_hashes(rows), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "turn.turn_conv", "turn.turn_place"
    )
