"""Near copies among texts: candidates by SimHash and by banded min-hashes, verified by the Jaccard similarity of their word shingles.

At a similarity of 0.8 fingerprints are about ten bits apart, more than posting lists of bytes can promise to find; of
16 bands of 5 min-hashes one agrees with a probability of 0.998. Only pairs that pass the exact check are linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import checkpointed, packed_texts, slices, unpacked
from vulnlake.llm.graph import components
from vulnlake.llm.simhash import LONGEST, fingerprint, links

BANDS, PER_BAND = 16, 5
#: Bits of a text's parities, which tell most unlike pairs apart before their runs are compared.
PARITY_BITS = 4096
#: Members of a crowded list that one task compares with the others.
PART = 256
_DRAW = np.random.default_rng(42)
TURNS = _DRAW.integers(1, 1 << 63, (BANDS * PER_BAND, 1), np.uint64) | np.uint64(1)
SHIFTS = _DRAW.integers(1, 1 << 63, (BANDS * PER_BAND, 1), np.uint64)


def shingles(text: str, size: int) -> np.ndarray:
    """Hashes of the distinct runs of `size` words; of all words where there are fewer, and none without a word."""
    words = text.encode().lower().split()
    runs = {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs)))


def parity(hashes: np.ndarray) -> np.ndarray:
    """`PARITY_BITS` bits, each the parity of the runs that fall on it: two texts' bits differ in at most as many places as
    their runs do."""
    bits = np.bincount((hashes >> np.uint64(17)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def bands(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of min-hashes."""
    if not len(hashes):
        return []
    least = np.full(BANDS * PER_BAND, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[i : i + 2048] * TURNS + SHIFTS) >> np.uint64(20)).min(axis=1))
    return [xxhash.xxh64_intdigest(b.tobytes(), k) - (1 << 63) for k, b in enumerate(least.reshape(BANDS, PER_BAND))]


def mixed(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists (`key, text_hash` and more) whose members are in several components (`node, root`), with each member's `root`,
    the largest one `main`, the number of `members`, and `parts`: how many parts of about `PART` those outside it make."""
    member = lists.join(roots, F.col("text_hash") == F.col("node"), "left")
    member = checkpointed(member.select(*lists.columns, F.coalesce("root", "text_hash").alias("root")))
    sizes = member.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.sum("m").alias("n"))
    several = sizes.filter(F.col("n") > F.col("main.m"))
    parts = F.ceil((F.col("n") - F.col("main.m")) / PART).cast("long")
    return member.join(several.select("key", F.col("main.root").alias("main"), F.col("n").alias("members"), parts.alias("parts")), "key")


def prefixes(sets: DataFrame) -> DataFrame:
    """Lists (`key, text_hash, excess, later`) of the rarest elements of each text's set, within its family.

    Sets are rows `text_hash, family, elements, excess, least`; a text that is to be found shares `least` elements or more,
    so all but `least` and one more are listed, in one order for all texts of the family; `later` elements follow the one listed.
    """
    each = sets.select("text_hash", "family", F.explode("elements").alias("key"))
    counts = each.groupBy("family", "key").agg(F.count("*").alias("n"))
    order = each.join(counts, ["family", "key"]).groupBy("text_hash").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("order"))
    n = F.size("order")
    first = F.slice("order", F.lit(1), F.greatest(F.lit(0), n - F.col("least") + 1).cast("int"))
    ranked = sets.select("text_hash", "family", "excess", "least").join(order, "text_hash")
    placed = ranked.select("text_hash", "family", "excess", n.alias("all"), F.posexplode(first).alias("place", "r")).filter("r.n > 1")
    return placed.select(F.xxhash64("family", "r.key").alias("key"), "text_hash", "excess", (F.col("all") - F.col("place") - 1).alias("later"))


def whole(runs: DataFrame, similarity: float) -> DataFrame:
    """Sets, for `prefixes`, of all runs of each text: of n runs a similar text shares `similarity` times n at least."""
    n = F.size("runs")
    excess = 2 * similarity / (1 + similarity) * n
    return runs.select("text_hash", F.lit(0).cast("long").alias("family"), F.col("runs").alias("elements"), excess.alias("excess"), F.ceil(similarity * n - 1e-9).alias("least"))


def families(lists: DataFrame) -> DataFrame:
    """`text_hash, family`: texts that meet in a list (`key, text_hash`), directly or through others, are a family."""
    roots = components(lists.select("key", "text_hash"), "key", "text_hash")
    return lists.select("text_hash").distinct().join(roots, F.col("text_hash") == F.col("node")).select("text_hash", F.col("root").alias("family"))


def differences(runs: DataFrame, named: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Sets, for `prefixes`, of the runs in which texts differ from what most of their family (`text_hash, family`) has, and
    links (a, b) between each family's core.

    Texts of n and m runs are similar if they differ in c * (n + m) runs or fewer, c being (1 - s) / (1 + s). What two
    texts differ in is the symmetric difference of their sets here, whatever these are taken from. So with a text's
    `excess`, the size of its set less c * n, they are similar if they share half the sum of their excesses. Where that sum
    is 0 or less they need share nothing, and both are linked to the family's text of the least excess, which forms the
    core. All others share elements, and these are rare: what most of a family has is no element of any set. A text of the
    core looks for those outside it, whose excess is larger than the least one's negative.
    """
    own = checkpointed(runs.select("text_hash", "runs").join(named, "text_hash"))
    sizes = checkpointed(own.groupBy("family").agg(F.count("*").alias("size")))
    parts = F.ceil(F.col("size") / PART).cast("long")
    some = own.select("family", F.explode("runs").alias("key")).groupBy("family", "key").agg(F.count("*").alias("n"))
    most = some.join(sizes, "family").filter(2 * F.col("n") > F.col("size")).groupBy("family").agg(F.collect_list("key").alias("common"))
    common = F.coalesce("common", F.array().cast("array<long>"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    told = sizes.select("family", parts.alias("parts")).join(most, "family", "left").select("family", "parts", common.alias("common"), every)
    large = F.broadcast(sizes.filter(F.col("size") > PART).select("family", parts.alias("parts")))
    dealt = own.join(large, "family", "left").select("text_hash", "family", "runs", F.pmod(F.xxhash64("text_hash"), F.coalesce("parts", F.lit(1))).alias("part"))
    n = F.size("runs")
    apart = F.concat(F.array_except("runs", "common"), F.array_except("common", "runs"))
    sets = dealt.join(told, ["family", "part"]).select("text_hash", "family", "part", "parts", n.alias("n"), apart.alias("elements"))
    sets = checkpointed(sets.withColumn("excess", F.size("elements") - (1 - similarity) / (1 + similarity) * F.col("n")))
    least = sets.groupBy("family").agg(F.min(F.struct("excess", "text_hash")).alias("core"), F.max("parts").alias("parts")).select("family", "core", every)
    both = sets.join(least, ["family", "part"]).withColumn("inside", F.col("excess") + F.col("core.excess") <= 1e-9)
    other = F.when(F.col("inside"), -F.col("core.excess")).otherwise(F.col("core.excess"))
    # a similar text differs in (1 - s) / s * n runs or fewer, so it shares all but these
    shared = F.greatest(F.lit(1).cast("long"), F.size("elements") - F.floor((1 - similarity) / similarity * F.col("n") + 1e-9), F.ceil((F.col("excess") + other) / 2 - 1e-9))
    links = both.filter(F.col("inside") & (F.col("text_hash") != F.col("core.text_hash"))).select(F.col("core.text_hash").alias("a"), F.col("text_hash").alias("b"))
    return both.select("text_hash", "family", "elements", "excess", shared.alias("least")), links


def apart(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of lists (`key, text_hash, excess, later`) that may still join two components (`node, root`).

    Two texts of different components are not both in the list's largest one, so the members outside it meet all members
    of other components. A pair stays if the elements from the shared one on are enough for the similarity, as they are at
    the first that a similar pair shares. A list that is one component has no pairs. The members outside are dealt into parts, so
    no list is one task.
    """
    of = mixed(lists, roots)
    few = of.filter("root <> main").select("key", F.pmod(F.xxhash64("text_hash"), "parts").alias("part"), F.col("text_hash").alias("a"), F.col("excess").alias("a_excess"), F.col("later").alias("a_later"), F.col("root").alias("a_root"))
    every = of.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("text_hash").alias("b"), F.col("excess").alias("b_excess"), F.col("later").alias("b_later"), F.col("root").alias("b_root"), "main")
    met = few.join(every, ["key", "part"]).filter((F.col("a_root") != F.col("b_root")) & ((F.col("b_root") == F.col("main")) | (F.col("a") < F.col("b"))))
    met = met.filter(2 * (1 + F.least("a_later", "b_later")) >= F.col("a_excess") + F.col("b_excess") - 1e-9)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows `doc_id, text_hash` of all documents, and `text_hash, component` of the distinct texts.

    Texts of a similarity of `similarity` or more share a component, directly or through others. A list of over
    `LONGEST` texts isn't paired up at once: its members are compared with one of them, another in each band, and if
    this leaves several components, the members meet once more in lists of their rarest runs (`prefixes`, `apart`), so that
    no pair is lost. Null texts are empty, all
    texts without a word are alike, and repeated rows stay repeated. An empty table gives empty ones. A very long text's
    shingles are held at once in its task, about five times the text.
    """

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part["text"].to_pylist()]
                bits = np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)
                found = [shingles(t, size) for t in texts]
                columns = [pa.array(bits), pa.array([len(f) for f in found], pa.int64()), pa.array([bands(f) for f in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_hash"], *columns], names=["doc_id", "text_hash", "bits", "n_runs", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed"):
                found = [shingles(unpacked(t).decode(), size) for t in part["packed"].to_pylist()]
                columns = [pa.array([f(x) for x in found], pa.list_(pa.int64())) for f in (lambda x: x.view(np.int64), parity)]
                yield pa.RecordBatch.from_arrays([part["text_hash"], *columns], names=["text_hash", "runs", "parity"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = checkpointed(rows.mapInArrow(marks, "doc_id long, text_hash long, bits long, n_runs long, bands array<long>"))
    distinct = checkpointed(marked.groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("bits", "n_runs", "bands")]))

    posted = distinct.select("text_hash", "n_runs", F.explode("bands").alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("text_hash", "key"), "text_hash"))["text_hash"].alias("centre")).filter("n > 1")
    lists = checkpointed(posted.join(sizes, "key"))
    short = lists.filter(F.col("n") <= LONGEST)
    met = short.select("key", F.col("text_hash").alias("a")).join(short.select("key", F.col("text_hash").alias("b")), "key").select("a", "b")
    stars = lists.filter(F.col("n") > LONGEST).select(F.col("centre").alias("a"), F.col("text_hash").alias("b"))
    firsts = checkpointed(distinct.groupBy("bits").agg(F.min("text_hash").alias("first")))
    same = distinct.join(firsts, "bits").select(F.col("first").alias("a"), F.col("text_hash").alias("b"))
    first = lambda c: firsts.select(F.col("bits").alias(c), F.col("first").alias(f"{c}_first"))
    close = links(firsts.select("bits")).join(first("a"), "a").join(first("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    every = met.union(stars).union(same).union(close).filter("a <> b")
    pairs = checkpointed(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def runs_of(asked: DataFrame) -> DataFrame:
        return checkpointed(packed_texts(rows.select("text_hash", "text")).join(asked, "text_hash", "left_semi").mapInArrow(sets, "text_hash long, runs array<long>, parity array<long>").groupBy("text_hash").agg(F.first("runs").alias("runs"), F.first("parity").alias("parity")))

    def alike(pairs: DataFrame, runs: DataFrame) -> DataFrame:
        """Pairs of the similarity; those whose parities differ in too many places for it go before runs are moved."""
        few = lambda c: runs.select(F.col("text_hash").alias(c), F.size("runs").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))
        differ = F.aggregate(F.zip_with("a_parity", "b_parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
        near = pairs.join(few("a"), "a").join(few("b"), "b").filter((1 + similarity) * differ <= (1 - similarity) * (F.col("a_n") + F.col("b_n")) + 1e-9)
        pairs = checkpointed(near.select("a", "b"))
        own = lambda c: runs.select(F.col("text_hash").alias(c), F.col("runs").alias(f"{c}_runs"))
        both = F.size(F.array_intersect("a_runs", "b_runs"))
        return pairs.join(own("a"), "a").join(own("b"), "b").filter(both >= similarity * (F.size("a_runs") + F.size("b_runs") - both)).select("a", "b")

    runs = runs_of(pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b")).distinct())  # the crowded lists' too, by their stars
    linked = checkpointed(alike(pairs, runs))
    roots = components(linked)
    crowded = checkpointed(mixed(lists.filter(F.col("n") > LONGEST), roots).select("text_hash").distinct())
    if not crowded.isEmpty():
        rare = checkpointed(mixed(prefixes(whole(runs.join(crowded, "text_hash", "left_semi"), similarity)), roots))
        listed = lambda of: of.select("key", "text_hash", "excess", "later")
        met, long = listed(rare.filter(F.col("members") <= LONGEST)), rare.filter(F.col("members") > LONGEST)
        if not long.isEmpty():
            differing, cores = differences(runs, families(long), similarity)
            linked = checkpointed(linked.union(cores))
            roots = components(linked)
            met = met.union(listed(prefixes(differing)))
        left = checkpointed(apart(met, roots).join(pairs, ["a", "b"], "left_anti"))
        if not left.isEmpty():
            roots = components(linked.union(alike(left, runs)))
    named = distinct.join(roots, distinct["text_hash"] == roots["node"], "left").select("text_hash", F.coalesce("root", "text_hash").alias("component"))
    return marked.select("doc_id", "text_hash"), named
