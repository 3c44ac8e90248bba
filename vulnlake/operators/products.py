"""Order statistics of products within groups (hazards by risks), without making the products.

A group's products are a matrix whose rows and columns are sorted; how many of them reach a level is a sum over risks
of the steps from a place on, which one merge of risks and steps in order of hazard tells. Histograms of the logarithms
first narrow the level down, as a convolution bounds the counts; bisection by exact counts goes on until few products
are left between two levels, and only those are made.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordering import running, running_sums
from vulnlake.sources.tables import checkpointed

#: Bins of a histogram over all groups, products that are made at most, and a width beyond all rounding.
BINS, MADE, SLACK = 65_536, 500_000, 1e-12
#: Risks below `LEAST` make products of nothing; those above `MOST` all the same.
LEAST, MOST = 1e-300, 1e300


def indexed(steps: DataFrame) -> DataFrame:
    """Steps (g, t, hazard), hazard growing with t, with `idx` from 0 within g and the group's `size`."""
    numbered = running_sums(steps.withColumn("one_", F.lit(1).cast("long")), "t", ["one_"], within="g").withColumn("idx", F.col("run_one_") - 1).drop("one_", "run_one_")
    return numbered.join(steps.groupBy("g").agg(F.count("*").alias("size")), "g")


def placed(rows: DataFrame, steps: DataFrame, level: str, name: str) -> DataFrame:
    """Rows with `name`: the index of their group's first step whose hazard is at least `level`, null where none is."""
    marks = steps.select("g", F.col("hazard").alias(level), F.col("idx").alias("mark_"), F.lit(True).alias("step_"))
    both = rows.withColumns({"mark_": F.lit(None).cast("long"), "step_": F.lit(False)}).unionByName(marks, allowMissingColumns=True)
    return running(both, level, ["mark_"], within="g", descending=True, how="min").filter("NOT step_").withColumnRenamed("run_mark_", name).drop("mark_", "step_")


def level_for(value: Column) -> Column:
    """The hazard from which on a row's product is at least `value`."""
    endless = F.when(value <= 0, F.lit(-math.inf)).otherwise(F.lit(math.inf))
    return F.when(F.col("risk") > 0, value / F.col("risk")).otherwise(endless)


def binned(df: DataFrame, value: str, weight: Column, low: float, width: float) -> dict[str, dict[int, float]]:
    """Counts by group and bin of the logarithm; at most `BINS` bins."""
    out: dict[str, dict[int, float]] = {}
    for r in df.groupBy("g", F.floor((F.log(value) - low) / width).cast("long").alias("bin")).agg(F.sum(weight).alias("n")).collect():
        out.setdefault(r["g"], {})[r["bin"]] = float(r["n"])
    return out


def bracket(groups: DataFrame, steps: DataFrame, first: int, last: int) -> tuple[float, float]:
    """Levels low and high with the products of rank `first` to `last`, from the greatest down, in between."""
    some = groups.filter(F.col("risk") >= LEAST)
    ends = [d.agg(F.min(F.log(c)).alias("low"), F.max(F.log(c)).alias("high"), F.count_distinct("g").alias("g")).first() for d, c in ((some, "risk"), (steps, "hazard"))]
    if ends[0]["low"] is None:
        return 0.0, LEAST**0.9
    bins = max(16, BINS // max(e["g"] for e in ends))
    width = max(max(e["high"] - e["low"] for e in ends) / (bins - 1), 1e-9)
    risks = binned(some, "risk", F.col("n"), ends[0]["low"], width)
    hazards = binned(steps, "hazard", F.lit(1), ends[1]["low"], width)
    total = np.zeros(2 * bins + 2)  # the first for products of nothing
    total[0] = groups.filter(F.col("risk") < LEAST).join(steps.select("g", "size").distinct(), "g").agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    for g in risks.keys() & hazards.keys():
        a, b = np.zeros(bins + 1), np.zeros(bins + 1)
        for side, counts in ((a, risks[g]), (b, hazards[g])):
            side[list(counts)] = list(counts.values())
        used = [(int(np.flatnonzero(side)[0]), int(np.flatnonzero(side)[-1]) + 1) for side in (a, b)]
        part = np.convolve(a[used[0][0] : used[0][1]], b[used[1][0] : used[1][1]])
        total[1 + used[0][0] + used[1][0] :][: len(part)] += part
    above = np.concatenate([np.cumsum(total[::-1])[::-1], [0.0]])  # products of sums of bins from s on
    high = int(np.flatnonzero(above <= first)[0]) + 2
    low = int(np.flatnonzero(above >= last + 1)[-1]) - 1
    edge = lambda s: math.exp(min(ends[0]["low"] + ends[1]["low"] + width * (s - 1), 709.0))
    return edge(low) if low > 0 else 0.0, edge(high)


def reaching(groups: DataFrame, steps: DataFrame, level: float) -> tuple[int, int]:
    """How many products are at least `level`: weighted, and as distinct pairs of risk and step."""
    found = placed(groups.withColumn("level", level_for(F.lit(level))), steps, "level", "idx")
    sizes = steps.select("g", "size").distinct()
    beyond = F.coalesce(F.col("size") - F.col("idx"), F.lit(0))
    r = found.join(sizes, "g").agg(F.sum(F.col("n") * beyond).alias("n"), F.sum(beyond).alias("pairs")).first()
    return r["n"] or 0, r["pairs"] or 0


def between(groups: DataFrame, steps: DataFrame, low: float, high: float, ranks: list[int]) -> list[float]:
    """exp(-product) for ranks from the greatest product down, all of them between the levels: those products are made."""
    levels = F.explode(F.array(*[F.lit(x) for x in (low * (1 - SLACK), high * (1 + SLACK))])).alias("at_")
    ends = placed(groups.select("*", levels).withColumn("level", level_for(F.col("at_"))).drop("at_"), steps, "level", "idx")
    sizes = steps.select("g", "size").distinct()
    ranges = checkpointed(ends.join(sizes, "g").groupBy("g", "risk", "n", "size").agg(F.min(F.coalesce("idx", "size")).alias("from_"), F.max(F.coalesce("idx", "size")).alias("to_")))
    above = ranges.agg(F.sum(F.col("n") * (F.col("size") - F.col("to_"))).alias("n")).first()["n"]
    inside = ranges.filter("from_ < to_").select("g", "risk", "n", F.explode(F.sequence(F.col("from_"), F.col("to_") - 1)).alias("idx"))
    values = inside.join(steps.select("g", "idx", "hazard"), ["g", "idx"]).groupBy(F.exp(-F.col("hazard") * F.col("risk")).alias("s")).agg(F.sum("n").alias("n"))
    return list(running_sums(values, "s", ["n"]).agg(*[F.min(F.when(F.col("run_n") > k - above, F.col("s"))).alias(f"s{i}") for i, k in enumerate(ranks)]).first())


def ranked(groups: DataFrame, steps: DataFrame, low: float, high: float, ranks: list[int], made: int) -> list[float]:
    """The same by bisection, until at most `made` products are left between the levels (or the levels are neighbours)."""
    most, least = reaching(groups, steps, low)[1], reaching(groups, steps, high)[1]
    while most - least > made:
        middle = math.sqrt(max(low, LEAST)) * math.sqrt(high)
        if not low < middle < high:
            break
        count, pairs = reaching(groups, steps, middle)
        if ranks[0] < count <= ranks[-1]:  # the two ranks part here
            return ranked(groups, steps, middle, high, ranks[:1], made) + ranked(groups, steps, low, middle, ranks[1:], made)
        if count > ranks[-1]:  # all are at or above the middle
            low, most = middle, pairs
        else:
            high, least = middle, pairs
    return between(groups, steps, low, high, ranks)


def survival_quantile(groups: DataFrame, steps: DataFrame, q: float, made: int = MADE) -> float | None:
    """The q-quantile of exp(-hazard * risk) over all pairs of a group's risks (g, risk, n: how often) and steps (as
    `indexed` makes them), interpolated between neighbours as usual; None without any pair."""
    groups = groups.withColumn("risk", F.least("risk", F.lit(MOST)))
    total = groups.join(steps.select("g", "size").distinct(), "g").agg(F.sum(F.col("n") * F.col("size")).alias("n")).first()["n"]
    if not total:
        return None
    at = (total - 1) * q
    ranks = [math.floor(at), math.ceil(at)]
    low, high = bracket(groups, steps, *ranks)
    a, b = ranked(groups, steps, low, high, ranks, made)
    part, gap = at - ranks[0], b - a
    return a + gap * part if part < 0.5 else b - gap * (1 - part)


def first_below(rows: DataFrame, steps: DataFrame, threshold: float) -> DataFrame:
    """Rows (g, risk, ..) with `t`: the first time of their group's steps at which exp(-hazard * risk) is at or below the
    threshold, null if there is none. Steps within rounding of it are compared as they are."""
    need = -math.log(threshold) if threshold > 0 else math.inf
    numbered = rows.withColumn("row_", F.monotonically_increasing_id())
    levels = F.explode(F.array(*[F.lit(need * f) for f in (1 - SLACK, 1 + SLACK)])).alias("at_")
    tried = placed(checkpointed(numbered).select("*", levels).withColumn("level", level_for(F.col("at_"))).drop("at_"), steps, "level", "idx")
    names = [c for c in numbered.columns if c != "row_"]
    sized = tried.join(steps.select("g", "size").distinct(), "g", "left")
    ends = sized.groupBy("row_", *names).agg(F.min(F.coalesce("idx", "size")).alias("from_"), F.max(F.coalesce("idx", "size")).alias("to_"))
    near = ends.withColumn("idx", F.explode_outer(F.sequence("from_", "to_")))
    found = near.join(steps.select("g", "idx", "hazard", F.col("t").alias("time_")), ["g", "idx"], "left")
    crossed = F.when(F.exp(-F.col("hazard") * F.col("risk")) <= F.lit(threshold), F.col("time_"))
    return found.groupBy("row_", *names).agg(F.min(crossed).alias("t")).drop("row_")
