"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of all training texts are summed per language and bucket; the matrix of log probabilities (languages x
`BUCKETS`, so bounded by the number of languages) is broadcast, and texts are scored in batches in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import slices

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: Log-likelihoods are scaled down to this many n-grams, so that long texts keep graded scores.
EVIDENCE = 60


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, one text after the other, and how many each text has.

    Letters are lower-cased, whatever stands between two words counts as one blank.
    """
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[code]
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    symbol = np.where(letter, code, 32)[kept].astype(np.uint64)
    end = np.cumsum(kept)[np.cumsum([len(t) + 1 for t in low]) - 1]  # of each text, among the symbols kept
    length = np.diff(end, prepend=0)
    found = np.empty((len(symbol), len(ORDERS)), np.int32)
    value = np.zeros(len(symbol), np.uint64)
    for k, n in enumerate(ORDERS):
        reach = len(symbol) - n + 1
        value = value[: max(reach, 0)] * np.uint64(0x100000001B3) + symbol[n - 1 :] + np.uint64(n)
        mixed = value * np.uint64(0x9E3779B97F4A7C15)
        found[:, k] = BUCKETS  # past the end of its text
        found[: max(reach, 0), k] = mixed >> np.uint64(48)
        for back in range(1, n):
            found[(end - back)[length >= back], k] = BUCKETS
    return found, length


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            langs = np.array(part["lang"].to_pylist(), object)
            for lang in set(langs):
                own = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                texts = part["text"].filter(pa.array(langs == lang)).to_pylist()
                own[:BUCKETS] += np.bincount(grams(texts)[0].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
                own[BUCKETS] += len(texts)
    for lang, own in totals.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bucket", "n"])


class Model:
    """Language names and the matrix of log probabilities; its last row, for no n-gram, is zero."""

    def __init__(self, langs: list[str], counts: np.ndarray, texts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.matrix = np.zeros((BUCKETS + 1, len(langs)), np.float32)
        self.matrix[:BUCKETS] = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T
        self.prior = np.log((texts + 1) / (texts.sum() + len(langs)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, length = grams(texts)
        have = np.flatnonzero(length)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not len(have) or not self.langs:
            return langs, scores
        start = np.concatenate([[0], np.cumsum(length)[:-1]])[have]
        sums = np.zeros((len(have), len(self.langs)))
        for k in range(len(ORDERS)):
            sums += np.add.reduceat(self.matrix[found[:, k]], start, axis=0, dtype=np.float64)
        total = sums * np.minimum(1, EVIDENCE / (length[have] * len(ORDERS)))[:, None] + self.prior
        best = total.argmax(axis=1)
        odds = np.exp(total - total.max(axis=1, keepdims=True))
        scores[have] = odds.max(axis=1) / odds.sum(axis=1)
        for i, b in zip(have.tolist(), best.tolist()):
            langs[i] = self.langs[b]
        return langs, scores


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept out of the fit: crc32 of its id as text has remainder 1 by three."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(labelled: DataFrame) -> Model:
    """Counts over all rows (`text`, non-null `lang`); the sum per language and bucket is all that reaches the driver."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null")
    table = rows.mapInArrow(count_rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(langs), BUCKETS + 1), np.int64)
    counts[[place[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts[:, :BUCKETS], counts[:, BUCKETS])


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, lang_pred, score` of every whole text; `und` and 0 for null or letterless texts.

    Without a learned language every text is `und`. Repeated rows stay repeated; ties go to the first name; an empty
    table gives no rows. Other columns are left out, whatever their names; a very long text is a slice of its own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                langs, scores = shared.value.predict(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def prediction(model: Model, spark: SparkSession) -> Callable[[str], Column]:
    """A function from a text column's name to a struct (lang_pred, score), for tables whose columns stay as they are."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores = [], [np.zeros(0)]
        for part in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text"):
            some = shared.value.predict(part["text"].to_pylist())
            langs += some[0]
            scores.append(some[1])
        return pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores)})

    once = predict.asNondeterministic()  # else a filter on its result has it worked out again
    return lambda name: once(F.col(name).cast("string"))
