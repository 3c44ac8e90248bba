"""Concordance of a risk score with censored times, without building pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.sources.tables import checkpointed

#: Rows of a group that a task counts one by one; borders of its cells; groups that are told by a broadcast.
GROUP_ROWS, CELLS, FEW_GROUPS = 100_000, 64, 20_000


def summed_after(cell: np.ndarray, value: np.ndarray, weight: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For each query (a place in `value`), the weight of the entries of its cell whose value is below its own."""
    order = np.lexsort((value, cell))
    key, total = np.stack([cell[order], value[order]]), np.concatenate([[0.0], np.cumsum(weight[order])])
    width = int(value.max()) + 2 if len(value) else 1
    flat = key[0] * width + key[1]
    low, high = np.searchsorted(flat, queries[0] * width), np.searchsorted(flat, queries[0] * width + queries[1])
    return total[high] - total[low]


def below_and_later(t: np.ndarray, s: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each entry the weight of those with a greater t and a smaller s; entries (t, s) are distinct.

    In order of t, and of s for one t, blocks of one, two, four and more entries meet their right neighbours.
    """
    order = np.lexsort((s, t))
    value, w = s[order], weight[order]
    place, out, width = np.arange(len(s)), np.zeros(len(s)), 1
    while width < len(s):
        block = place // width
        right = block % 2 == 1
        out[~right] += summed_after(block[right] // 2, value[right], w[right], np.stack([block[~right] // 2, value[~right]]))
        width *= 2
    found = np.empty(len(s))
    found[order] = out
    return found


def later(t: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each entry the weight of those of its group with a greater t."""
    top = int(t.max()) if len(t) else 0
    return summed_after(group, top - t, weight, np.stack([group, top - t]))


def judged(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the events of a group (t, late, s, events, weight): better scored, tied, and, if it is `whole`, all later rows."""
    t = np.unique(frame["t"], return_inverse=True)[1].astype(np.int64) * 2 + frame["late"].to_numpy(np.int64)
    s = np.unique(frame["s"], return_inverse=True)[1].astype(np.int64)
    d, w = frame["events"].to_numpy(float), frame["weight"].to_numpy(float)
    pairs = d @ later(t, np.zeros_like(t), w) if frame["whole"].iloc[0] else 0.0
    return pd.DataFrame({"good": [d @ below_and_later(t, s, w)], "ties": [d @ later(t, s, w)], "pairs": [pairs]})


def of_cells(frame: pd.DataFrame) -> pd.DataFrame:
    """The same of a group's cells (tc, sc, events, weight): pairs whose times and scores are both in different cells."""
    t, s = (np.unique(frame[c], return_inverse=True)[1] for c in ("tc", "sc"))
    d, w = (np.zeros((t.max() + 1, s.max() + 1)) for _ in range(2))
    d[t, s], w[t, s] = frame["events"], frame["weight"]
    after = np.cumsum(w[::-1], axis=0)[::-1] - w  # of later time cells, by score cell
    less = np.cumsum(after, axis=1) - after
    pairs = (d * after.sum(axis=1, keepdims=True)).sum() if frame["whole"].iloc[0] else 0.0
    return pd.DataFrame({"good": [float((d * less).sum())], "ties": [0.0], "pairs": [float(pairs)]})


def cell(value: Column, borders: str) -> Column:
    """Cells between borders, and one for each border, so that a value of very many rows has a cell of its own."""
    return (2 * F.size(F.filter(borders, lambda b: b < value)) + F.exists(borders, lambda b: b == value).cast("int")).cast("double")


def concordance_index(df: DataFrame, time: str, score: str, event: str, rows: int = GROUP_ROWS) -> DataFrame:
    """One row: share of comparable pairs in which the earlier event has the higher score; score ties count half.

    A pair is comparable when the earlier of two different times is an event, or when times tie and one is an event. Rows
    are reduced to counts. A group of more than `rows` rows is cut into cells by time and by score: pairs that differ in
    both cells are counted from the cells alone; those of one time cell, and those of one score cell with times told by
    their cell, are groups of the next level. Smaller groups are counted row by row, so no task holds more than that.
    """
    spark = df.sparkSession
    base = df.select(F.col(time).cast("double").alias("t"), F.col(score).cast("double").alias("s"), F.col(event).cast("int").alias("e")).dropna()
    # an event comes before a censored row of its time, so that only what is later by (time, kind) is compared with it
    kinds = base.groupBy("t", "s", "e").agg(F.count("*").cast("double").alias("weight"))
    groups = checkpointed(kinds.select(F.lit("").alias("g"), "t", (1 - F.col("e")).alias("late"), "s", (F.col("weight") * F.col("e")).alias("events"), "weight", F.lit(True).alias("whole")))
    found = {"good": 0.0, "ties": 0.0, "pairs": 0.0}
    sums, probs = "good double, ties double, pairs double", F.expr(f"array({', '.join(f'{i / CELLS}D' for i in range(1, CELLS))})")

    def add(parts: DataFrame) -> None:
        for name, value in parts.agg(*[F.sum(c).alias(c) for c in found]).first().asDict().items():
            found[name] += value or 0.0

    while True:
        # a group of one time and kind has no pairs
        sizes = groups.groupBy("g").agg(F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("late").alias("l0"), F.max("late").alias("l1"), F.max("whole").alias("whole_"))
        sizes = checkpointed(sizes.filter("t0 < t1 OR l0 < l1"))
        large, few = sizes.filter(F.col("n") > rows), sizes.count() <= FEW_GROUPS
        told = lambda names: F.broadcast(names) if few else names  # noqa: B023, E731
        add(groups.join(told(sizes.filter(F.col("n") <= rows).select("g")), "g").groupBy("g").applyInPandas(judged, sums))
        if large.isEmpty():
            break
        here = groups.join(told(large.select("g", (F.col("t0") == F.col("t1")).alias("one"))), "g").withColumn("by", F.when(F.col("one"), F.col("late")).otherwise(F.col("t")))
        borders = here.groupBy("g").agg(*[F.array_distinct(F.percentile_approx(c, probs, F.lit(20 * CELLS))).alias(f"{c}_borders") for c in ("by", "s")])
        cut = checkpointed(here.join(told(borders), "g").withColumns({"tc": cell(F.col("by"), "by_borders"), "sc": cell(F.col("s"), "s_borders")}).drop("by_borders", "s_borders", "by", "one"))
        both = [F.sum(c).alias(c) for c in ("events", "weight")]
        add(cut.groupBy("g", "whole", "tc", "sc").agg(*both).groupBy("g").applyInPandas(of_cells, sums))
        name = lambda kind, c: F.concat("g", F.lit(kind), F.col(c).cast("int").cast("string"))
        own_time = cut.select(name("t", "tc").alias("g"), "t", "late", "s", "events", "weight", "whole")
        own_score = cut.groupBy(name("s", "sc").alias("g"), F.col("tc").alias("t"), "s").agg(*both).select("g", "t", F.lit(0).alias("late"), "s", "events", "weight", F.lit(False).alias("whole"))
        groups = checkpointed(own_time.unionByName(own_score))
    pairs = found["pairs"]
    share = (found["good"] + found["ties"] / 2) / pairs if pairs else None
    return spark.createDataFrame([(share, pairs or None)], "concordance double, pairs double")
