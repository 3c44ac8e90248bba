"""Cross-entropy difference of two bigram models over one vocabulary, counted exactly at every size.

Every word and every pair of neighbours of every text is counted, for the target (chosen documents) and for the
background (all documents). Each has a key of `KEY_BITS` bits of its own (a hash, and one bit that tells pairs from
words), so nothing is shared but by a collision of hashes; of 10^11 different keys about one in 100,000 has one. Documents
are dealt into blocks of about `BLOCK_BYTES` of text and keys into as many buckets, both as many as the corpus asks for. A
block sends its distinct keys with its own counts to their buckets, once a key, so that a common word is one entry per
block; a bucket adds them up and answers each block with the sums of just those keys, in their order. What is sent grows
with the distinct keys of the blocks, and so does the number of messages, as none is empty. No model is broadcast, and
nothing but a size comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import slices

#: One is added to each word of a vocabulary of at least 2^`WORD_BITS`; it is larger where the corpus has more words.
WORD_BITS = 18
#: Weight of the word model behind a pair's counts, as a number of occurrences.
BACKING = 4.0
#: Bits of a key; fewer are less to shuffle.
KEY_BITS = 52
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20


class Keys(dict):
    """Key of a word, an even number; worked out once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word) >> 64 - KEY_BITS & ~1
        return key


KEYS = Keys()


def word_keys(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().split()
    return np.fromiter(map(KEYS.__getitem__, words), np.uint64, len(words))


def pair_keys(words: np.ndarray) -> np.ndarray:
    """Keys of neighbours, odd numbers."""
    mixed = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(31))) >> np.uint64(64 - KEY_BITS) | np.uint64(1)


def block_keys(texts: Sequence[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; distinct keys in order; place among them of all words, then of all pairs; the buckets' borders."""
    words = [word_keys(t) for t in texts]
    keys, place = np.unique(np.concatenate([*words, *[pair_keys(w) for w in words if len(w)]]), return_inverse=True)
    bucket = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
    return np.array([len(w) for w in words], np.int64), keys, place, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte: the high ones are alike."""
    planes = np.ascontiguousarray(numbers.ravel().astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()


def pair_of_counts(data: bytes, n: int) -> np.ndarray:
    """Two rows of n counts, target and all."""
    return unpacked(data, 2 * n).astype(np.int64).reshape(2, n)


def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, which is less to shuffle."""
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [(t or "").encode() for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()), part["target"]], names=["doc_id", "text", "n_bytes", "target"])


def texts(part: pa.Table) -> list[str]:
    return [pa.decompress(t, n, "zstd", asbytes=True).decode() if n else "" for t, n in zip(part["text"].to_pylist(), part["n_bytes"].to_pylist())]


def sums(place: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(place, c, n) for c in counts]).astype(np.int64)


ASKED = "block long, bucket long, n_keys long, keys binary, counts binary"
ANSWERED = "block long, bucket long, counts binary"
TOTALS = "vocabulary long, n_target long, n_all long"
#: The bucket of the row that tells a block the totals.
TOLD = -1
SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def asked(part: pa.Table, buckets: int) -> pa.Table:
    """A row for each bucket that has one of a block's distinct keys: these keys and the block's counts of them."""
    n, keys, place, cuts = block_keys(texts(part), buckets)
    chosen = np.array(part["target"].to_pylist(), bool)
    weights = np.concatenate([np.repeat(chosen, n), np.repeat(chosen, np.maximum(n - 1, 0))])
    counts = np.stack([np.bincount(place[weights], minlength=len(keys)), np.bincount(place, minlength=len(keys))])
    full = np.flatnonzero(np.diff(cuts))
    spans = [(cuts[k], cuts[k + 1]) for k in full]
    return pa.table({
        "block": pa.array([part["block"][0].as_py()] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "n_keys": pa.array(np.diff(cuts)[full], pa.int64()),
        "keys": pa.array([packed(np.diff(keys[i:j], prepend=np.uint64(0))) for i, j in spans], pa.binary()), "counts": pa.array([packed(counts[:, i:j]) for i, j in spans], pa.binary()),
    })


def added(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """A bucket's distinct keys, their sums, the place among them of each key sent, and how many each block sent."""
    parts = [np.cumsum(unpacked(k, n), dtype=np.uint64) for k, n in zip(part["keys"].to_pylist(), part["n_keys"].to_pylist())]
    keys, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([pair_of_counts(c, len(k)) for c, k in zip(part["counts"].to_pylist(), parts)], axis=1)
    return keys, sums(place, counts, len(keys)), place, [len(k) for k in parts]


def answered(part: pa.Table) -> pa.Table:
    """The sums of a bucket's keys for each block that has them."""
    _, counts, place, sent = added(part)
    return pa.table({"block": part["block"], "bucket": part["bucket"], "counts": pa.array([packed(counts[:, place[e - n : e]]) for e, n in zip(np.cumsum(sent), sent)], pa.binary())})


def totals(part: pa.Table) -> pa.Table:
    """A bucket's number of distinct words, and of words in the target and in all."""
    keys, counts, _, _ = added(part)
    words = (keys & np.uint64(1)) == 0
    return pa.table({name: pa.array([int(n)], pa.int64()) for name, n in zip(("vocabulary", "n_target", "n_all"), (words.sum(), *counts[:, words].sum(1)))})


def own_counts(n: np.ndarray, place: np.ndarray, keys: int) -> np.ndarray:
    """For each word and pair, how often its text holds it."""
    text = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), np.maximum(n - 1, 0))])
    _, which, counts = np.unique(text * keys + place, return_inverse=True, return_counts=True)
    return counts[which]


def losses(n: np.ndarray, counts: np.ndarray, total: np.ndarray, vocabulary: int) -> np.ndarray:
    """Negative log probability of each word, of the first of a text without a word before it.

    A Dirichlet-smoothed pair model over a word model with one added to each word. `counts` are those of all words, then
    of all pairs, `total` that of the model's words for each text.
    """
    words, pairs = counts[: n.sum()].astype(np.float64), counts[n.sum() :]
    p = (words + 1) / (np.repeat(total, n) + vocabulary)
    later = np.ones(len(p), bool)
    later[(np.cumsum(n) - n)[n > 0]] = False
    at = np.flatnonzero(later)
    p[at] = (pairs + BACKING * p[at]) / (words[at - 1] + BACKING)
    return -np.log(p)


def scored(part: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    if not part.num_rows:
        return SCORED.empty_table()
    n, keys, place, cuts = block_keys(texts(part), buckets)
    answers = answers.sort_by("bucket")  # the totals first
    told, answers = {name: answers[name][0].as_py() or 0 for name in ("vocabulary", "n_target", "n_all")}, answers.slice(1)
    full = np.diff(cuts)[np.diff(cuts) > 0]
    counts = np.concatenate([np.zeros((2, 0), np.int64), *[pair_of_counts(c, n) for c, n in zip(answers["counts"].to_pylist(), full)]], axis=1)
    vocabulary = max(1 << WORD_BITS, told["vocabulary"])
    means = np.zeros((2, len(n)))
    if n.any():
        own, chosen = own_counts(n, place, len(keys)), np.array(part["target"].to_pylist(), bool)
        for k, (name, held) in enumerate((("n_target", chosen), ("n_all", np.ones(len(n), bool)))):
            # a text is scored by the counts of all others
            mine = own * np.concatenate([np.repeat(held, n), np.repeat(held, np.maximum(n - 1, 0))])
            loss = losses(n, counts[k][place] - mine, told[name] - n * held, vocabulary)
            means[k, n > 0] = np.add.reduceat(loss, (np.cumsum(n) - n)[n > 0]) / n[n > 0]
    return pa.table([part["doc_id"], pa.array(n), pa.array(means[0]), pa.array(means[1]), pa.array(means[1] - means[0])], schema=SCORED)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def cross_entropy_difference(docs: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """`doc_id, n_tokens, target_loss, background_loss, score` for `docs(doc_id, text, target)`.

    Losses are means per word in nats; the score is the mean of their differences, background less target, so that
    higher is closer to the target. A document is scored by the counts of all others, its copies included: what it adds
    itself is taken off. Null and empty texts have no words, losses and score 0. A null target is no target. Repeated
    rows count, and are scored, as often as they occur; an empty table gives no rows; other columns are left out. A very
    long text makes its block larger. `n_bytes` of text, if known, save a pass.
    """
    buckets = -(-(text_bytes(docs) if n_bytes is None else n_bytes) // BLOCK_BYTES) or 1
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("target"), F.lit(False)).alias("target"))
    # both uses have the same plan, so that the texts are shuffled once
    small = chosen.mapInArrow(squeezed, "doc_id long, text binary, n_bytes long, target boolean")
    dealt = small.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets))).groupBy("block")
    asks = dealt.applyInArrow(lambda part: asked(part, buckets), ASKED)
    # asked and totalled from one shuffle
    answers = asks.groupBy("bucket").applyInArrow(answered, ANSWERED)
    told = asks.groupBy("bucket").applyInArrow(totals, TOTALS).agg(*[F.sum(c).alias(c) for c in ("vocabulary", "n_target", "n_all")])
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("block"), F.lit(TOLD).cast("long").alias("bucket"))
    answers = answers.unionByName(every.crossJoin(F.broadcast(told)), allowMissingColumns=True)  # one row
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(lambda part, got: scored(part, got, buckets), "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
