"""Classifiers, likelihood ratios and survival regressions on Spark's own learners, and score combination."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators import boosting, density, forest, moments, pu, weibull
from vulnlake.operators.ordering import auroc_auprc, quantiles
from vulnlake.operators.splits import impute_and_scale
from vulnlake.sources.tables import checkpointed


def baseline_score(train: DataFrame, test: DataFrame, column: str, key: str) -> DataFrame:
    """The base score as the ranking; gaps get the train median."""
    median = quantiles(train, column, [0.5]).agg(F.first("q")[0].alias("median_"))
    return test.crossJoin(F.broadcast(median)).select(key, F.coalesce(F.col(column), F.col("median_")).alias("risk_score"))  # one row


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds `weight_`: rows / (2 * rows of the class)."""
    c = df.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    p, n = c["p"] or 0.0, c["n"]
    return df.withColumn("weight_", F.when(F.col(label) == 1, F.lit(n / (2 * p) if p else 1.0)).otherwise(F.lit(n / (2 * (n - p)) if n > p else 1.0)))


def vectors(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="x_").transform(df.withColumn("y_", F.col(label).cast("double")))


def prepared(train: DataFrame, test: DataFrame, columns: Sequence[str], label: str) -> tuple[DataFrame, DataFrame, list[str]]:
    a, b, used = impute_and_scale(train, test, columns)
    names = [f"z_{c}" for c in used]
    return balanced(vectors(a, names, label), label).cache(), vectors(b, names, label), used


def scores(model: object, test: DataFrame, key: str, label: str) -> DataFrame:
    return model.transform(test).select(key, label, vector_to_array("probability")[1].alias("risk_score"))  # type: ignore[attr-defined]


def train_logistic(train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Balanced, L2-penalised logistic regression on z-scores: test scores, and coefficients by magnitude."""
    a, b, used = prepared(train, test, columns, label)
    total = a.agg(F.sum("weight_")).first()[0] or 1.0
    model = LogisticRegression(featuresCol="x_", labelCol="y_", weightCol="weight_", regParam=1.0 / total, standardization=False, maxIter=200).fit(a)
    return scores(model, b, key, label), sorted(zip(used, map(float, model.coefficients)), key=lambda x: -abs(x[1]))


def logistic_side_by_side(train: DataFrame, rows: DataFrame, configs: dict[str, list[str]], label: str, key: str, penalty: float = 1.0, rounds: int = 50) -> DataFrame:
    """`train_logistic` for many sets of columns at once: key, label, `ablation` and `risk_score` of the rows.

    The rows are prepared once; a Newton round is one job, which adds up gradient and Hessian of every set that has not
    come to its optimum yet.
    """
    columns = list(dict.fromkeys(c for own in configs.values() for c in own))
    a, b, used = impute_and_scale(train, rows, columns)
    x, width = F.array(*[F.col(f"z_{c}") for c in used]).cast("array<double>"), len(used)
    held = checkpointed(balanced(a, label).select(F.when(F.col(label) == 1, 1.0).otherwise(0.0).alias("y"), F.col("weight_").alias("w"), x.alias("x")))
    masks = {n: [0, *[1 + used.index(c) for c in own if c in used]] for n, own in configs.items()}
    weights = {n: np.zeros(width + 1) for n in configs}
    open_ = list(configs)
    for _ in range(rounds):
        if not open_:
            break
        sizes = [len(masks[n]) * (len(masks[n]) + 1) for n in open_]

        def part(batch: pa.RecordBatch) -> np.ndarray:
            x = np.column_stack([np.ones(batch.num_rows), moments.matrix(batch["x"], width)])
            y, w = (batch[c].to_numpy(zero_copy_only=False) for c in ("y", "w"))
            out = []
            for n in open_:
                own = x[:, masks[n]]
                p = 1 / (1 + np.exp(-np.clip(own @ weights[n][masks[n]], -30, 30)))
                out += [own.T @ (w * (y - p)), ((own * (w * p * (1 - p))[:, None]).T @ own).ravel()]
            return np.concatenate(out)

        sums, left = moments.added(held, part, sum(sizes)), []
        for n, size in zip(open_, sizes):
            k = len(masks[n])
            own, sums = sums[:size], sums[size:]
            ridge = np.diag([1e-9] + [penalty] * (k - 1))
            step = np.linalg.solve(own[k:].reshape(k, k) + ridge, own[:k] - ridge @ weights[n][masks[n]])
            weights[n][masks[n]] += step
            if np.abs(step).max() >= 1e-9:
                left.append(n)
        open_ = left
    chance = lambda n: 1 / (1 + F.exp(-sum((F.col(f"z_{c}") * float(weights[n][1 + i]) for i, c in enumerate(used)), F.lit(float(weights[n][0])))))
    each = F.inline(F.array(*[F.struct(F.lit(n).alias("ablation"), chance(n).alias("risk_score")) for n in configs]))
    return b.select(key, label, each)


def rankers(key: str, label: str, seed: int = 7) -> dict[str, Callable[[DataFrame, DataFrame, list[str]], DataFrame]]:
    """The six rankers by name, each fitted on train rows with given columns and scoring rows."""

    def scaled(fit: Callable[..., DataFrame]) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
        def ranker(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
            a, b, used = impute_and_scale(train, rows, columns)
            return fit(a, b, [f"z_{c}" for c in used], key, label)

        return ranker

    return {
        "xgb": lambda train, rows, columns: train_boosted(train, rows, columns, key, label, seed=seed)[0],
        "logreg": lambda train, rows, columns: train_logistic(train, rows, columns, key, label)[0],
        "rf": lambda train, rows, columns: train_forest(train, rows, columns, key, label, seed=seed)[0],
        "pu": scaled(pu.train_pu_bagging),
        "kde": scaled(density.density_risk),
        "base_only": lambda train, rows, columns: baseline_score(train, rows, "base_score", key).join(rows.select(key, label), key),
    }


def tree_rows(train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Train rows (id, y, x) and test rows (key_, label_, row, x) with gaps filled, and the columns used."""
    a, b, used = impute_and_scale(train, test, columns)
    x = F.array(*[F.col(f"z_{c}") for c in used])
    rows = a.select(F.xxhash64(F.col(key).cast("string"), x).alias("id"), F.when(F.col(label) == 1, 1).otherwise(0).alias("y"), x.alias("x"))
    asked = b.select(F.col(key).alias("key_"), F.col(label).alias("label_"), x.alias("x")).repartition(2 * b.sparkSession.sparkContext.defaultParallelism)  # trees are slow to read
    asked = asked.withColumn("row", F.monotonically_increasing_id())
    return checkpointed(rows), checkpointed(asked), used


def train_forest(train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str, trees: int = 600, seed: int = 7) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Random forest of unbounded trees, classes weighing the same in each bootstrap: test scores, and importances in
    falling order."""
    rows, asked, used = tree_rows(train, test, columns, key, label)
    found, shares = forest.forest(rows, asked, len(used), trees, seed)
    return asked.join(found, "row").select(F.col("key_").alias(key), F.col("label_").alias(label), F.col("p").alias("risk_score")), sorted(zip(used, shares), key=lambda x: -x[1])


#: Depths, steps and rounds of the tuning grid.
GRID = [{"depth": depth, "step": step, "rounds": rounds} for depth in (3, 5) for step in (0.05, 0.1) for rounds in (300, 600)]


def tuned(train: DataFrame, columns: Sequence[str], key: str, label: str, year: str, grid: Sequence[dict], seed: int) -> dict:
    """The grid's setting of greatest average precision on the last train year, fitted on the years before; of equals the
    first, and that too where a class is missing. Settings that differ in rounds only are one fit, all are grown side by side."""
    last = train.agg(F.max(year)).first()[0]
    before, held = train.filter(F.col(year) < last), train.filter(F.col(year) == last)
    if last is None or any(part.filter(F.col(label) == y).isEmpty() for part in (before, held) for y in (0, 1)):
        return dict(grid[0])
    rows, asked, used = tree_rows(before, held, columns, key, label)
    kinds = list(dict.fromkeys((g["depth"], g["step"]) for g in grid))
    trees = boosting.fit(rows, len(used), [{"depth": d, "step": s} for d, s in kinds], max(g["rounds"] for g in grid), seed)
    chances = boosting.scored(asked, len(used), [(g["step"], trees[kinds.index((g["depth"], g["step"]))][: g["rounds"]]) for g in grid])
    each = asked.join(chances, "row").select(F.col("label_").alias("y"), F.posexplode("p").alias("setting", "s"))
    found = {r["setting"]: r["auprc"] for r in auroc_auprc(each, "y", "s", "setting").collect()}  # a row for each setting
    return dict(grid[max(range(len(grid)), key=lambda i: (found[i], -i))])


def train_boosted(train: DataFrame, test: DataFrame, columns: Sequence[str], key: str, label: str, year: str | None = None, grid: Sequence[dict] = (), seed: int = 7) -> tuple[DataFrame, list[tuple[str, float]]]:
    """Boosted trees, positives weighted by negatives / positives; a grid is judged by average precision on the last train year."""
    best = tuned(train, columns, key, label, year, grid, seed) if len(grid) > 1 and year else dict(grid[0] if grid else GRID[0])
    rows, asked, used = tree_rows(train, test, columns, key, label)
    trees = boosting.fit(rows, len(used), [best], best["rounds"], seed)[0]
    found = boosting.scored(asked, len(used), [(best["step"], trees)])
    out = asked.join(found, "row").select(F.col("key_").alias(key), F.col("label_").alias(label), F.col("p")[0].alias("risk_score"))
    return out, sorted(zip(used, boosting.importances(trees, len(used))), key=lambda x: -x[1])


def nb_llr(df: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 3, floor: float = 1e-9, fit_on: DataFrame | None = None) -> DataFrame:
    """Gaussian naive Bayes: log-likelihood ratio per row, and the features that add and take most.

    Class means and population variances, of `fit_on` or else of the rows themselves, are one aggregate of two rows;
    missing features add nothing.
    """
    stats = {r[label]: r for r in (df if fit_on is None else fit_on).groupBy(label).agg(*[x for c in columns for x in (F.avg(c).alias(f"a_{c}"), F.var_pop(c).alias(f"v_{c}"))]).collect()}  # two rows

    def log_density(c: str, y: int) -> Column:
        row = stats.get(y)
        if row is None or row[f"a_{c}"] is None:
            return F.lit(0.0)
        v = max(row[f"v_{c}"] or 0.0, floor)
        return -((F.col(c) - row[f"a_{c}"]) * (F.col(c) - row[f"a_{c}"])) / (2 * v) - 0.5 * math.log(2 * math.pi * v)

    parts = {c: F.coalesce(log_density(c, 1) - log_density(c, 0), F.lit(0.0)) for c in columns}
    ordered = F.array_sort(F.array(*[F.struct((-p).alias("less"), F.lit(c).alias("feature")) for c, p in parts.items()]))
    names = lambda a: F.transform(a, lambda s: s["feature"])
    return df.select(key, label, sum(parts.values(), F.lit(0.0)).alias("llr"), names(F.slice(ordered, 1, k)).alias("top"), names(F.slice(F.reverse(ordered), 1, k)).alias("bottom"))


def components(df: DataFrame, columns: Sequence[str], n: int, prefix: str = "component_") -> tuple[DataFrame, list[str]]:
    """`columns` (null: 0) replaced by `n` components: the rows along the leading eigenvectors of their sums of products, which
    are not centred. Only those sums reach the driver."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    total = moments.products(filled.select(F.array(*columns).alias("x")), len(columns))[:-1, :-1]
    directions = np.linalg.eigh(total)[1][:, ::-1][:, :n]
    names = [f"{prefix}{i}" for i in range(n)]
    along = lambda d: sum((F.col(c) * float(v) for c, v in zip(columns, d)), F.lit(0.0))
    return filled.withColumns({name: along(directions[:, i]) for i, name in enumerate(names)}).drop(*columns), names


def weibull_aft(
    df: DataFrame, columns: Sequence[str], time: str, event: str, key: str, text_columns: Sequence[str] = (), most: int = 30, n: int = 20, penalizer: float = 0.05
) -> DataFrame:
    """Weibull accelerated failure times on days / 100; log density and log survival of each row in closed form.

    More than `most` text columns become `n` components first. Missing covariates are 0, constant ones are left out. The
    penalty is on coefficients of covariates divided by their deviations.
    """
    wanted = [*columns, *text_columns]
    if len(text_columns) > most:
        df, names = components(df, text_columns, n)
        wanted = [*columns, *names]
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in wanted})
    rows = filled.filter(F.col(time) > 0).select(F.col(key).alias("key_"), (F.col(time) / 100.0).alias("t"), F.col(event).cast("double").alias("e"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(wanted)])
    rows = checkpointed(rows)
    spread = rows.agg(*[F.stddev_samp(f"c{i}_").alias(f"d{i}") for i in range(len(wanted))]).first() if wanted else []
    used = [i for i in range(len(wanted)) if (spread[i] or 0.0) > 1e-9]
    x = F.array(*[F.col(f"c{i}_") for i in used]).cast("array<double>").alias("x")
    beta, shape = weibull.fit(checkpointed(rows.select(x, "t", "e")), np.array([spread[i] for i in used]), penalizer)
    linear = sum((F.col(f"c{i}_") * float(b) for i, b in zip(used, beta[1:])), F.lit(float(beta[0])))
    z = (F.log("t") - linear) * shape
    return rows.select(F.col("key_").alias(key), (z - F.log("t") + math.log(shape) - F.exp(z)).alias("log_density"), (-F.exp(z)).alias("log_survival"))


def combined_risk(df: DataFrame, columns: Sequence[str], weights: Sequence[float], key: str) -> DataFrame:
    """Weighted sum of z-scores (sample deviation + 1e-12), through the logistic, times ten."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"a_{c}"), F.stddev_samp(c).alias(f"d_{c}"))])
    z = sum((w * (F.col(c) - F.col(f"a_{c}")) / (F.col(f"d_{c}") + 1e-12) for c, w in zip(columns, weights)), F.lit(0.0))
    return df.crossJoin(F.broadcast(stats)).select(key, (10 / (1 + F.exp(-z))).alias("combined_risk"))  # one row
