"""Global order without a global sort in one task: running sums over distinct values, ranks, areas under curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a cell; the number of cells follows the table, up to `MOST_CELLS`.
CELL_ROWS, MOST_CELLS = 250_000, 2000


def cells_of(df: DataFrame, order: str, name: str, rows: int | None = None, most: int = MOST_CELLS) -> DataFrame:
    """Adds `name`: a number that grows with `order`, the same for equal values, for about `rows` rows each (null: -1).

    Where the rows, which are counted first, fill more than one cell, as many borders as are wanted come from approximate
    quantiles of one more pass; they only decide how even the cells are. A row finds its cell by binary search.
    """
    wanted = min(most, -(-df.agg(F.count(order)).first()[0] // (rows or CELL_ROWS)))
    edges: list[float] = []
    if wanted > 1:
        probs = ", ".join(f"{i / wanted}D" for i in range(1, wanted))
        edges_of = F.expr(f"percentile_approx(CAST(`{order}` AS DOUBLE), array({probs}), {max(1000, 4 * wanted)})")
        edges = sorted(set(df.agg(edges_of.alias("edges")).first()["edges"]))
    if not edges:
        return df.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(0))
    value = df.withColumn("value_", F.coalesce(F.col(order).cast("double"), F.lit(float("nan"))))
    dealt = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="value_", outputCol="place_", handleInvalid="keep").transform(value)
    return dealt.withColumn(name, F.when(F.col(order).isNull(), -1).otherwise(F.col("place_").cast("int"))).drop("value_", "place_")


def running(df: DataFrame, order: str, names: Sequence[str], within: str | None = None, descending: bool = False, how: str = "sum", rows: int | None = None) -> DataFrame:
    """Adds `run_<name>`: the sum (or, with how="min", the least) of each column over all rows up to and with this one's
    `order`. For sums `order` should be distinct (within `within`); the least takes all rows of equal order in.

    It runs inside cells (a column `cell_`, if there is one) and starts at what the cells before make, of which there are few.
    """
    f = {"sum": F.sum, "min": F.min}[how]
    dealt = df if "cell_" in df.columns else cells_of(df, order, "cell_", rows)
    keys = [within] if within else []
    sort = lambda c: F.desc(c) if descending else F.asc(c)
    before = W.partitionBy(*keys).orderBy(sort("cell_")).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(*keys, "cell_").agg(*[f(s).alias(f"t_{s}") for s in names])
    starts = totals.select(*keys, "cell_", *[f(f"t_{s}").over(before).alias(f"b_{s}") for s in names])
    inside = W.partitionBy(*keys, "cell_").orderBy(sort(order))
    inside = inside.rowsBetween(W.unboundedPreceding, 0) if how == "sum" else inside.rangeBetween(W.unboundedPreceding, 0)
    local = dealt.withColumns({f"l_{s}": f(s).over(inside) for s in names})
    both = (lambda s: F.col(f"l_{s}") + F.coalesce(F.col(f"b_{s}"), F.lit(0))) if how == "sum" else (lambda s: F.least(f"l_{s}", f"b_{s}"))
    return local.join(starts, [*keys, "cell_"]).select(*df.columns, *[both(s).alias(f"run_{s}") for s in names])


def running_sums(df: DataFrame, order: str, sums: Sequence[str], within: str | None = None, descending: bool = False, rows: int | None = None) -> DataFrame:
    return running(df, order, sums, within, descending, "sum", rows)


def quantiles(df: DataFrame, column: str, probs: Sequence[float], within: str | None = None, weight: str | None = None, rows: int | None = None) -> DataFrame:
    """Exact quantiles, interpolated between neighbours: (`within`,) `n` and the array `q`; without any value no row.
    A row counts once, or `weight` times.

    Values are counted and the counts added up in order, cell by cell, so no task holds all values of a group.
    """
    keys = [within] if within else []
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("v_")).agg((F.sum(weight) if weight else F.count("*")).alias("n_")).persist()  # the choice of cells reads it too
    summed = running_sums(counted, "v_", ["n_"], within, rows=rows)
    total = counted.groupBy(*keys).agg(F.sum("n_").alias("n"))
    seen = summed.join(total, within) if within else summed.crossJoin(F.broadcast(total))  # one row
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    at = lambda k: F.min(F.when(F.col("run_n_") > k, F.col("v_")))
    found = seen.groupBy(*keys, "n").agg(F.array(*[F.struct(at(F.floor(place(p))).alias("low"), at(F.ceil(place(p))).alias("high")) for p in probs]).alias("ends"))
    value = lambda i, p: F.when(F.floor(place(p)) == F.ceil(place(p)), F.col("ends")[i]["low"]).otherwise(
        (F.ceil(place(p)) - place(p)) * F.col("ends")[i]["low"] + (place(p) - F.floor(place(p))) * F.col("ends")[i]["high"]
    )
    return found.select(*keys, "n", F.array(*[value(i, p) for i, p in enumerate(probs)]).alias("q"))


def average_rank(df: DataFrame, column: str, name: str = "rank") -> DataFrame:
    """1-based rank over the whole table, ties averaged; null for null."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("ties"))
    ranked = running_sums(counted, column, ["ties"]).select(column, (F.col("run_ties") - (F.col("ties") - 1) / 2.0).alias(name))
    return df.join(ranked, column, "left")


def auroc_auprc(df: DataFrame, label: str, score: str, within: str | None = None) -> DataFrame:
    """One row (for each `within`): ROC area with ties counted half, and average precision as a step sum; null where one
    class is missing."""
    keys = [within] if within else []
    positive = F.when(F.col(label) == 1, 1).otherwise(0)
    by_score = df.filter(F.col(score).isNotNull()).groupBy(*keys, F.col(score).alias("s")).agg(F.sum(positive).alias("tp"), F.sum(1 - positive).alias("fp"))
    run = running_sums(by_score, "s", ["tp", "fp"], within, descending=True)
    pairs = F.sum(F.col("fp") * (F.col("run_tp") - F.col("tp") / 2.0))
    steps = F.sum(F.col("tp") * F.col("run_tp") / (F.col("run_tp") + F.col("run_fp")))
    p, n = F.sum("tp"), F.sum("fp")
    both = (p > 0) & (n > 0)
    return run.groupBy(*keys).agg(F.when(both, pairs / (p * n)).alias("auroc"), F.when(both, steps / p).alias("auprc"), p.alias("positives"), n.alias("negatives"))
