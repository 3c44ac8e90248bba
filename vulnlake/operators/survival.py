"""Survival frames and a stratified proportional-hazards model on reduced sums."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.features import day_lag
from vulnlake.operators import products
from vulnlake.operators.ordering import cells_of, running_sums
from vulnlake.sources.tables import checkpointed


def survival_frame(df: DataFrame, as_of: str, covariates: Sequence[str], event: str = "kev_present", published: str = "published", listed: str = "kev_published", variance: str | None = None) -> DataFrame:
    """`event`, `time_to_event` in days (to the listing, else to `as_of`) and covariates; complete rows with time over 0.

    With `variance`, its square root is added as <variance>_sqrt, null for a negative one.
    """
    happened = F.coalesce(F.col(event), F.lit(False))
    end = F.when(happened, F.col(listed).cast("timestamp")).otherwise(F.lit(as_of).cast("timestamp"))
    out = df.withColumns({"event": happened.cast("int"), "time_to_event": day_lag(end, F.col(published))})
    if variance:
        out = out.withColumn(f"{variance}_sqrt", F.when(F.col(variance) >= 0, F.sqrt(variance)))
    whole = [f"{variance}_sqrt" if c == variance else c for c in covariates]
    return out.dropna(subset=["time_to_event", *whole]).filter("time_to_event > 0")


@dataclass
class CoxModel:
    covariates: list[str]
    beta: list[float]
    mean: list[float]
    deviation: list[float]
    gradient: list[float]


def cox_fit(df: DataFrame, covariates: Sequence[str], strata: str, penalizer: float = 0.1, time: str = "time_to_event", event: str = "event", rounds: int = 25, tolerance: float = 1e-8) -> CoxModel:
    """Stratified Cox model: Efron ties, covariates centred and scaled, penalty penalizer/2 * |beta|^2 per event.

    A Newton round reduces rows to sums per stratum and time, adds them up from the latest time back by running sums in
    cells, and brings one row of gradient and Hessian to the driver.
    """
    names = list(covariates)
    k = len(names)
    s = df.agg(*[x for c in names for x in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"d_{c}"))]).first()
    mean, deviation = [s[f"a_{c}"] or 0.0 for c in names], [s[f"d_{c}"] or 1.0 for c in names]
    z = [((F.col(c) - m) / d).alias(f"z{i}") for i, (c, m, d) in enumerate(zip(names, mean, deviation))]
    rows = df.select(F.col(strata).cast("string").alias("g"), F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"), *z)
    rows = checkpointed(cells_of(checkpointed(rows), "t", "cell_"))  # the order of times is the same in all rounds
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    beta, gradient = np.zeros(k), np.zeros(k)
    for _ in range(rounds):
        w = F.exp(sum((F.col(f"z{i}") * float(b) for i, b in enumerate(beta)), F.lit(0.0)))
        terms = {"s": w, **{f"s{i}": w * F.col(f"z{i}") for i in range(k)}, **{f"s{i}_{j}": w * F.col(f"z{i}") * F.col(f"z{j}") for i, j in pairs}}
        sums = [F.sum(v).alias(n) for n, v in terms.items()]
        tied = [F.sum(F.when(F.col("e") == 1, v).otherwise(0.0)).alias(f"e_{n}") for n, v in terms.items()]
        dead = [F.sum(F.when(F.col("e") == 1, F.col(f"z{i}")).otherwise(0.0)).alias(f"x{i}") for i in range(k)]
        reduced = rows.groupBy("g", "t", "cell_").agg(F.sum("e").alias("d"), *sums, *tied, *dead)
        at_risk = running_sums(reduced, "t", list(terms), within="g", descending=True).filter("d > 0")
        each = at_risk.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1)))
        less = lambda n: F.col(f"run_{n}") - F.col("l") / F.col("d") * F.col(f"e_{n}")
        g = [F.sum(F.col(f"x{i}") / F.col("d") - less(f"s{i}") / less("s")).alias(f"g{i}") for i in range(k)]
        h = [F.sum(less(f"s{i}_{j}") / less("s") - less(f"s{i}") * less(f"s{j}") / (less("s") * less("s"))).alias(f"h{i}_{j}") for i, j in pairs]
        r = each.agg(F.count("*").alias("n"), *g, *h).first()
        if not r["n"]:
            break
        gradient = np.array([r[f"g{i}"] for i in range(k)]) - penalizer * r["n"] * beta
        hessian = np.zeros((k, k))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = r[f"h{i}_{j}"]
        step = np.linalg.solve(hessian + penalizer * r["n"] * np.eye(k), gradient)
        beta = beta + step
        if np.abs(step).max() < tolerance:
            break
    return CoxModel(names, beta.tolist(), mean, deviation, gradient.tolist())


def linear_part(model: CoxModel) -> Column:
    return sum(((F.col(c) - m) / d * b for c, b, m, d in zip(model.covariates, model.beta, model.mean, model.deviation)), F.lit(0.0))


def cox_partial_hazard(df: DataFrame, model: CoxModel, event: str = "event") -> DataFrame:
    """Adds `risk_score` to rows without the event."""
    return df.filter(F.col(event) == 0).withColumn("risk_score", F.exp(linear_part(model)))


def baseline_steps(df: DataFrame, model: CoxModel, strata: str, time: str = "time_to_event", event: str = "event") -> DataFrame:
    """Cumulative baseline hazard per stratum and event time (stratum, t, hazard)."""
    rows = df.select(F.col(strata).cast("string").alias("g"), F.col(time).alias("t"), F.col(event).alias("e"), F.exp(linear_part(model)).alias("w"))
    reduced = rows.groupBy("g", "t").agg(F.sum("e").alias("d"), F.sum("w").alias("w"))
    jumps = running_sums(reduced, "t", ["w"], within="g", descending=True).filter("d > 0").select("g", "t", (F.col("d") / F.col("run_w")).alias("jump"))
    return running_sums(jumps, "t", ["jump"], within="g").select("g", "t", F.col("run_jump").alias("hazard"))


def predicted_day(df: DataFrame, model: CoxModel, strata: str, key: str, q: float = 0.05, horizon: float = 1691.0, time: str = "time_to_event", event: str = "event") -> DataFrame:
    """`predicted_day`: first event time of the stratum at which a row's survival is at or below the pooled q-quantile.

    Survival is exp(-H0(t) * risk). The matrix of rows and times is not built: `products` finds its quantile by counting,
    exactly, and then each row's first time below it by a merge in order of hazard. Rows that never cross have null (those
    with a missing covariate, too), and `predicted_display` Never.
    """
    steps = checkpointed(products.indexed(baseline_steps(df, model, strata, time, event).filter(F.col("t") <= horizon).withColumn("t", F.col("t").cast("double"))))
    scored = cox_partial_hazard(df, model, event).select(F.col(key).alias("key_"), F.col(strata).cast("string").alias("g"), F.col("risk_score").alias("risk"))
    groups = checkpointed(scored.filter("risk IS NOT NULL").groupBy("g", "risk").agg(F.count("*").alias("n")))
    threshold = products.survival_quantile(groups, steps, q)
    found = scored.withColumn("t", F.lit(None).cast("double")) if threshold is None else products.first_below(scored, steps, threshold)
    return found.select(F.col("key_").alias(key), "g", F.col("risk").alias("risk_score"), F.col("t").alias("predicted_day"), F.coalesce(F.col("t").cast("string"), F.lit("Never")).alias("predicted_display"))


def hazard_scope(df: DataFrame, count_bin: str, risk_bin: str, scope: str = "focus", focus: Sequence[str] = ("2/critical", "3/critical", "2/high", "3/high")) -> DataFrame:
    """Stratum label count/risk; keeps critical, four focus or all strata; sorted by risk."""
    label = df.withColumn("stratum", F.concat_ws("/", F.col(count_bin).cast("string"), F.col(risk_bin)))
    kept = {"critical": F.col(risk_bin) == "critical", "focus": F.col("stratum").isin(*focus), "all": F.lit(True)}
    if scope not in kept:
        raise ValueError(f"unknown scope {scope!r}")
    return label.filter(kept[scope]).orderBy(F.desc("risk_score"))
