"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Each source is one stream of words: its documents in a hashed order, cut into blocks of `BLOCK_WORDS` words. Its target
says how often the stream is gone through and how many words of a last, partial round follow; that is its exact quota of
block draws. A tree halves the range of output shards: at each node the left half's share of every source's quota is
drawn from the multivariate hypergeometric distribution, source after source, so that leaves hold whole numbers that add
up to the quotas. A leaf's share of a source is a range of positions in the source's permuted blocks; ranges are
disjoint, and blocks of a shard are then shuffled within it.

Nothing is ordered as a whole: documents and blocks are ranked in hashed cells of about `per_task` rows, whose totals are
added up. Only the table of distinct sources (one row each) is ordered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vulnlake.llm.common import checkpointed

#: Words of a block, and blocks of an output shard.
BLOCK_WORDS, SHARD_BLOCKS = 512, 512
#: Weights of the sources in code-point order, over and over; a source is taken at most `MOST_ROUNDS` times.
WEIGHTS, MOST_ROUNDS = (5, 2, 1), 3
#: The tree's nodes are dealt anew after so many levels.
LEVELS_A_TASK = 6
WORD = r"[^\x20\x09-\x0D]+"


def hashed(*parts: Column | str) -> Column:
    """16 hex digits that order rows as if at random, the same in every run."""
    return F.substring(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), 1, 16)


def cell_of(order: str, cells: Column) -> Column:
    """The cell of a hashed order; cells follow the order and are equally likely."""
    return F.floor(F.conv(F.substring(order, 1, 8), 16, 10).cast("long") * cells / F.lit(float(1 << 32))).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, its non-null `key`, size in words, hashed order, and a hash of the text that tells equal ids apart."""
    words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col(source).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), name.alias("source"), F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("key"), words.alias("size"), F.xxhash64(F.col(text).cast("string")).alias("text_hash"))
    return rows.withColumn("order", hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def planned(rows: DataFrame, block_words: int) -> DataFrame:
    """One row per source: number `i`, source_size, weight, target and its draws: `rounds` whole ones, `rest` words more.

    Targets share all words by weight; one of over `MOST_ROUNDS` times its source's size stops there and the others share
    what it leaves. In the order of size by weight the stopped ones come first, so running sums tell them.
    """
    sources = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    number = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    numbered = sources.withColumn("i", number).withColumn("weight", F.get(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), F.col("i") % len(WEIGHTS)))
    most = F.col("source_size") * MOST_ROUNDS
    everything, before = W.partitionBy(), W.orderBy(most / F.col("weight"), "key").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    stopped = numbered.withColumn("stopped", F.col("weight") * left >= most * weight_left)
    shared = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.when(F.col("stopped"), most)).over(everything), F.lit(0))
    among = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything)
    target = F.when(F.col("stopped"), most.cast("double")).otherwise((F.col("weight") * shared).cast("double") / among)
    words, size = F.floor(F.col("target") + 0.5).cast("long"), F.greatest("source_size", F.lit(1))
    out = stopped.withColumn("target", target).withColumns({"blocks": F.ceil(F.col("source_size") / block_words).cast("long"), "rounds": F.floor(words / size).cast("long"), "rest": words % size})
    return out.withColumn("rest_blocks", F.ceil(F.col("rest") / block_words).cast("long")).withColumn("quota", F.col("rounds") * F.col("blocks") + F.col("rest_blocks")).drop("stopped")


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total`, `good` of which count, do count: the inverse of the distribution at `u`.

    Weights follow from one value to the next, within ten deviations and ten of the mean (outside less than 1e-20).
    """
    low, high = F.greatest(F.lit(0), drawn - total + good), F.least(drawn, good)
    mean = drawn * good / total
    deviation = F.sqrt(mean * (1 - good / total) * (total - drawn) / F.greatest(total - 1, F.lit(1)))
    first = F.greatest(low, F.floor(mean - 10 * deviation - 10).cast("long"))
    last = F.least(high, F.ceil(mean + 10 * deviation + 10).cast("long"))
    grow = lambda s, k: s["w"] * (good - k) * (drawn - k) / ((k + 1).cast("double") * (total - good - drawn + k + 1))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    mass = F.aggregate(F.sequence(first, last), start, lambda s, k: F.struct(grow(s, k).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    begin = F.struct(F.lit(1.0).alias("w"), (-u * mass).alias("sum"), first.alias("x"))
    step = lambda s, k: F.struct(grow(s, k).alias("w"), (s["sum"] + s["w"]).alias("sum"), (s["x"] + F.when(s["sum"] + s["w"] <= 0, 1).otherwise(0)).cast("long").alias("x"))
    return F.least(last, F.aggregate(F.sequence(first, last), begin, step, lambda s: s["x"])).cast("long")


def uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def leaves(plan: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """Rows (shard, i, start, n): the range of source i's draws that a shard gets. Shards hold `shard_blocks` draws each,
    the last one what is left; the ranges of a source are disjoint and cover its quota."""
    long = lambda n: F.lit(n).cast("long")
    root = plan.filter("quota > 0").agg(F.sum("quota").alias("all"), F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("quota").alias("q"), long(0).alias("start")))).alias("quotas"))
    draws = root.first()["all"] or 0  # one number
    shards = -(-draws // shard_blocks)
    nodes = root.select(long(0).alias("lo"), long(shards).alias("hi"), "quotas")
    up_to = lambda shard: F.least(shard * shard_blocks, long(draws))
    depth = max(shards - 1, 0).bit_length()
    for level in range(depth):
        middle = F.col("lo") + (1 << (depth - 1 - level))

        def split(s: Column, e: Column) -> Column:
            x = hypergeometric(s["n"], e["q"], s["left"], uniform(F.lit(seed), F.col("lo"), F.col("hi"), e["i"]))
            return F.struct((s["n"] - e["q"]).alias("n"), (s["left"] - x).alias("left"), F.concat(s["x"], F.array(x)).alias("x"))

        begin = F.struct((up_to(F.col("hi")) - up_to(F.col("lo"))).alias("n"), (up_to(middle) - up_to(F.col("lo"))).alias("left"), F.array().cast("array<bigint>").alias("x"))
        cut = nodes.withColumn("x", F.when(F.col("hi") > middle, F.aggregate("quotas", begin, split, lambda s: s["x"])))
        both = F.arrays_zip("quotas", "x")
        part = lambda q, start: F.filter(F.transform(both, lambda e: F.struct(e["quotas"]["i"].alias("i"), q(e).alias("q"), start(e).alias("start"))), lambda e: e["q"] > 0)
        left = F.struct("lo", middle.alias("hi"), part(lambda e: e["x"], lambda e: e["quotas"]["start"]).alias("quotas"))
        right = F.struct(middle.alias("lo"), "hi", part(lambda e: e["quotas"]["q"] - e["x"], lambda e: e["quotas"]["start"] + e["x"]).alias("quotas"))
        kept = F.struct("lo", "hi", "quotas")
        nodes = cut.select(F.explode(F.when(F.col("x").isNull(), F.array(kept)).otherwise(F.array(left, right))).alias("node")).select("node.*")
        if level % LEVELS_A_TASK == LEVELS_A_TASK - 1 and level < depth - 1:
            nodes = checkpointed(nodes.repartition("lo"))
    return nodes.select(F.col("lo").alias("shard"), F.explode("quotas").alias("e")).select("shard", "e.i", "e.start", F.col("e.q").alias("n"))


def draws(plan: DataFrame, block_words: int, per_task: int) -> DataFrame:
    """Rows (i, block, round, position, words): every block that is drawn. A round is a permutation of the source's blocks
    by hash, its short last block at the end; the last draw of a partial round may be cut short."""
    rounds = plan.select("i", "key", "source_size", "blocks", "rounds", "rest", "rest_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds"))).alias("round")).filter((F.col("round") < F.col("rounds")) | (F.col("rest_blocks") > 0))
    rounds = rounds.filter("blocks > 0")
    pieces = rounds.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.lit(per_task).cast("long")))).repartition("i", "round", "first")
    rows = pieces.withColumn("block", F.explode(F.sequence("first", F.least(F.col("first") + per_task, "blocks") - 1)))
    short = F.col("source_size") < (F.col("block") + 1) * block_words
    rows = rows.withColumns({"order": hashed("key", "round", "block"), "short": short})
    cells = F.ceil(F.col("blocks") / per_task)
    rows = rows.withColumn("cell", F.when(F.col("short"), cells).otherwise(cell_of("order", cells)))
    inside = F.row_number().over(W.partitionBy("i", "round", "cell").orderBy("order", "block")) - 1
    before = W.partitionBy("i", "round").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("i", "round", "cell").agg(F.count("*").alias("n")).select("i", "round", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("inside", inside).join(counts, ["i", "round", "cell"]).withColumn("rank", F.col("before") + F.col("inside"))
    partial = F.col("round") == F.col("rounds")
    last = partial & (F.col("rank") == F.col("rest_blocks") - 1)
    words = F.when(last, F.col("rest") - F.col("rank") * block_words).otherwise(F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words))
    taken = ranked.filter(~partial | (F.col("rank") < F.col("rest_blocks")))
    return taken.select("i", "block", "round", (F.col("round") * F.col("blocks") + F.col("rank")).alias("position"), words.cast("long").alias("words"))


@dataclass
class Mix:
    """`drawn`: a row per document, block of it and draw of that block (`shard` null where none); `empty`: documents without words."""

    drawn: DataFrame
    empty: DataFrame
    seed: int

    def pieces(self) -> DataFrame:
        """The mix: shard, place in it, doc_id, text_hash, round, from_word, n_words. Blocks of a shard are shuffled in it."""
        rows = self.drawn.filter("n_words > 0")
        place = F.row_number().over(W.partitionBy("shard").orderBy(hashed(F.lit(self.seed), "i", "position"), "i", "position", "start")) - 1
        return rows.select("shard", place.alias("place"), "doc_id", "text_hash", "round", "from_word", "n_words")

    def taken(self) -> DataFrame:
        """A row per document: doc_id, source, size, source_size, target, taken."""
        names = ["doc_id", "source", "size", "source_size", "target"]
        with_words = self.drawn.groupBy("i", "start", *names).agg(F.sum("n_words").cast("long").alias("taken"))
        return with_words.select(*names, "taken").unionByName(self.empty.select(*names, F.lit(0).cast("long").alias("taken")))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, per_task: int = 50_000, seed: int = 11, **columns: str) -> Mix:
    """Mixes all documents to their sources' targets.

    A null text has no words and takes no part; a null source is one of its own, the last; null ids are ids like any
    other. Repeated rows are each a document. A very long text is many blocks. An empty table, or one without words,
    gives no pieces. Other columns are left aside, whatever their names.
    """
    rows = checkpointed(sized(docs, **columns))
    plan = checkpointed(planned(rows, block_words))
    cells = F.lit(max(1, -(-rows.count() // per_task)))
    rows = rows.withColumn("cell", cell_of("order", cells))
    before = W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("key", "cell").agg(F.sum("size").alias("n")).select("key", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = totals.join(plan.select("key", "i", "source_size", "target"), "key")
    inside = W.partitionBy("key", "cell").orderBy("order", "doc_id", "size", "text_hash").rowsBetween(W.unboundedPreceding, -1)
    streams = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, ["key", "cell"])
    streams = streams.select("i", "doc_id", "source", "text_hash", "size", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))
    end = F.col("start") + F.col("size")
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))
    parts = streams.filter("size > 0").withColumn("block", F.explode(blocks))
    dealt = leaves(plan, shard_blocks, seed).select("shard", "i", F.explode(F.expr("sequence(start, start + n - 1)")).alias("position"))
    placed = draws(plan, block_words, per_task).join(dealt, ["i", "position"])
    begin = F.greatest("start", F.col("block") * block_words)
    stop = F.least(end, F.col("block") * block_words + F.coalesce("words", F.lit(0)))
    drawn = parts.join(placed, ["i", "block"], "left").withColumns({"from_word": begin - F.col("start"), "n_words": F.greatest(stop - begin, F.lit(0))})
    return Mix(drawn, streams.filter("size = 0"), seed)


def texts(docs: DataFrame, pieces: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their `text`, each word with the white space after it."""
    whole = docs.select(F.col(doc_id).cast("long").alias("id_"), F.col(text).cast("string").alias("text_")).withColumn("hash_", F.xxhash64("text_")).dropDuplicates(["id_", "hash_"])
    found = pieces.join(whole, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_hash") == F.col("hash_")))
    words = F.regexp_extract_all("text_", F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    return found.withColumn("text", F.array_join(F.slice(words, (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")), "")).drop("id_", "hash_", "text_")
