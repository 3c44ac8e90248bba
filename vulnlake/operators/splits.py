"""Bins, splits and preprocessing that is fitted on the train part only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.operators.ordering import quantiles


def fixed_bins(column: Column, edges: Sequence[float], labels: Sequence[object]) -> Column:
    """Right-closed bins with the lowest edge in the first one; null outside."""
    value = F.when((column >= edges[0]) & (column <= edges[1]), labels[0])
    for low, high, label in zip(edges[1:], edges[2:], labels[1:]):
        value = value.when((column > low) & (column <= high), label)
    return value


def quantile_bins(df: DataFrame, column: str, labels: Sequence[str], name: str) -> DataFrame:
    """Bins by linear-interpolated quantiles, right-closed, lowest included; equal edges are one, and labels go in order."""
    found = quantiles(df, column, [i / len(labels) for i in range(len(labels) + 1)])
    edges = found.agg(F.array_distinct(F.coalesce(F.first("q"), F.array().cast("array<double>"))).alias("edges_"))
    place = F.greatest(F.lit(1), F.size(F.filter("edges_", lambda e: e < F.col(column))))
    label = F.element_at(F.array(*[F.lit(x) for x in labels]), place)
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.when(F.col(column).isNotNull(), label)).drop("edges_")  # one row


def temporal_split(df: DataFrame, year: str, key: str, min_year: int, max_year: int, seed: int = 13) -> DataFrame:
    """Rows from `min_year` on with `split`: train to `max_year`, test after; with no test row a seeded 80/20 by key."""
    if min_year > max_year:
        raise ValueError(f"years {min_year} to {max_year}")
    pool = df.filter(F.col(year) >= min_year)
    if pool.filter(F.col(year) > max_year).isEmpty():
        is_train = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(100)) < 80
    else:
        is_train = F.col(year) <= max_year
    return pool.withColumn("split", F.when(is_train, "train").otherwise("test"))


def impute_and_scale(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Columns with any value in train, medians for gaps, z-scores by the population deviation; all fitted on train.

    Adds `z_<name>`; a constant column becomes 0.
    """
    each = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    median = {r["name"]: r["q"][0] for r in quantiles(each, "value", [0.5], "name").collect()}  # a row for each column
    used = [c for c in columns if c in median]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(median[c])) for c in used}
    moments = train.agg(*[x for c in used for x in (F.avg(filled[c]).alias(f"a_{c}"), F.stddev_pop(filled[c]).alias(f"d_{c}"))]).first() if used else None
    z = {f"z_{c}": (filled[c] - moments[f"a_{c}"]) / (moments[f"d_{c}"] or 1.0) for c in used}
    return train.withColumns(z), test.withColumns(z), used


def model_projection(df: DataFrame, key: str, columns: Sequence[str], zero_filled: Sequence[str] = (), drop: Sequence[str] = (), leaks: str = r"kev|exploited_since|known_exploit|ransom", label: str | None = None) -> DataFrame:
    """Key, label and numeric features: zeros for missing counts and flags, no dropped or label-telling names."""
    import re

    have = dict(df.dtypes)
    numeric = ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean")
    chosen = [c for c in columns if c in have and c not in drop and not re.search(leaks, c) and (have[c] in numeric or have[c].startswith("decimal"))]
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in zero_filled else F.col(c).cast("double")
    return df.select(key, *([label] if label else []), *[value(c).alias(c) for c in chosen])
