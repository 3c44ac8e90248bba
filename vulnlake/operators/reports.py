"""Aggregates behind reports: overlap, cohorts, rates, lags, quantiles and top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.coerce import number
from vulnlake.functions.features import day_lag
from vulnlake.operators.ordering import quantiles

FLAGS = ("nvd_present", "jvn_present", "eu_present", "kev_present")
#: Names of attack vectors.
VECTOR_NAMES = {"N": "Network", "A": "Adjacent", "L": "Local", "P": "Physical"}


def category_frequency(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("frequency"))


def risk_factor(df: DataFrame, key: str, label: str) -> DataFrame:
    """Share of exploited rows per key."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.avg(F.col(label).cast("double")).alias("risk_factor"))


def source_overlap(df: DataFrame, min_year: int = 2021, min_sources: int = 1, min_count: int = 1) -> DataFrame:
    """Rows per exact combination of sources since a year, with percentages of all rows counted."""
    counted = df.filter((F.col("cve_year") >= min_year) & (F.col("source_count") >= min_sources)).groupBy(*FLAGS).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    return counted.crossJoin(F.broadcast(total)).filter(F.col("n") >= min_count).select(*FLAGS, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def source_totals(df: DataFrame, min_year: int = 2021) -> DataFrame:
    recent = df.filter(F.col("cve_year") >= min_year)
    return recent.agg(*[F.count_if(F.col(f)).alias(f.replace("_present", "_total")) for f in FLAGS], F.count("*").alias("all_total"))


def unlabeled_positive_cohort(df: DataFrame, cutoff: str, published: str = "published", listed: str = "kev_published") -> DataFrame:
    """Of CVEs published up to a cutoff: listed by then, listed later, never; with percentages. One pass."""
    at = F.lit(cutoff).cast("timestamp")
    known = F.col(listed) <= at
    counts = df.filter(F.col(published) <= at).agg(F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_if(F.col(listed) > at).alias("later"), F.count_if(F.col(listed).isNull()).alias("negative"))
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif(F.col("n"), F.lit(0)), 6).alias(f"{c}_percent")
    return counts.select("*", share("known"), share("later"), share("negative"))


def report_filter(df: DataFrame, years: tuple[int, int] | None = None, severities: Sequence[str] = (), kev: str = "all", hazard: str = "all") -> DataFrame:
    """The filter all reports share; a missing label counts as 0, a missing risk as the base score."""
    ready = df.withColumns({"is_kev": F.coalesce(number(F.col("is_kev")), F.lit(0.0)).cast("int"), "risk_score": F.coalesce(number(F.col("risk_score")), F.col("base_score"))})
    tests: list[Column] = []
    if years:
        tests.append(F.col("cve_year").between(*years))
    if severities:
        tests.append(F.col("severity").isin(*severities))
    if kev != "all":
        tests.append(F.col("is_kev") == (1 if kev == "kev" else 0))
    if hazard != "all":
        tests.append(F.col("predicted_day_num").isNotNull() if hazard == "predicted" else F.col("predicted_day_num").isNull())
    for t in tests:
        ready = ready.filter(t)
    return ready


def cross_listed_summary(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy((F.col("source_count") >= 2).alias("cross_listed")).agg(count("cve_id").alias("cves"))


def lag_histogram(df: DataFrame, later: str, earlier: str, bins: int = 40, most: float = 3650.0) -> DataFrame:
    """Equal bins over the span of lags between 0 and `most` days, of cross-listed rows if there are any; right-closed last bin."""
    lags = df.select(day_lag(F.col(later), F.col(earlier)).alias("lag"), (F.col("source_count") >= 2).alias("crossed")).filter(F.col("lag").between(0, most))
    bounds = lags.groupBy("crossed").agg(F.min("lag").alias("low"), F.max("lag").alias("high")).orderBy(F.desc("crossed")).limit(1)
    place = F.when(F.col("lag") >= F.col("high"), bins).otherwise(F.floor((F.col("lag") - F.col("low")) * bins / (F.col("high") - F.col("low"))) + 1)
    chosen = lags.join(F.broadcast(bounds), "crossed")  # one row
    return chosen.select(F.coalesce(place, F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def score_pairs(df: DataFrame, x: str, y: str, severity: Column) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("cve_id", F.col(x).alias("x_score"), F.col(y).alias("y_score"), severity.alias("severity"))


def lead_time_quartiles(df: DataFrame, lead: Column, severity: Column, min_score: float = 7.0) -> DataFrame:
    """Distribution of days to listing of exploited CVEs with a score of `min_score` or more, by severity."""
    rows = df.filter(F.col("kev_present") & (F.col("base_score") >= min_score)).select(severity.alias("severity"), lead.alias("lead")).filter("lead is not null")
    q = quantiles(rows, "lead", (0.0, 0.25, 0.5, 0.75, 1.0), "severity")
    return q.select("severity", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("least", "q1", "median", "q3", "most"))])


def attack_vector(letter: Column) -> Column:
    """Full name of an attack vector given by letter or name; Unknown otherwise."""
    key, value = F.upper(F.substring(F.trim(letter), 1, 1)), F.lit("Unknown")
    for k, v in VECTOR_NAMES.items():
        value = F.when(key == k, v).otherwise(value)
    return value


def attack_vector_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(attack_vector(F.col(column)).alias("attack_vector")).agg(F.count("*").alias("n"))


def kev_rate_by(df: DataFrame, key: str, label: str, min_support: int = 1, top: int | None = None) -> DataFrame:
    """Rows, exploited rows and their share per key; `top` keeps the highest shares (a report, ties by support and key)."""
    rates = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("total"), F.sum(F.col(label).cast("long")).alias("exploited"))
    rates = rates.filter(F.col("total") >= min_support).withColumn("rate", F.round(F.col("exploited") / F.col("total"), 6))
    return rates.orderBy(F.desc("rate"), F.desc("total"), key).limit(top) if top else rates


def hazard_quantile_bands(df: DataFrame, risk: str, probs: Sequence[float] = (0.5, 0.75, 0.9)) -> DataFrame:
    """Rows with the band of their risk: how many of the quantiles it exceeds; thresholds are one broadcast row."""
    q = quantiles(df, risk, (0.0, *probs, 1.0)).agg(F.first("q").alias("q"))
    edges = q.select(F.col("q")[0].alias("low"), F.col("q")[len(probs) + 1].alias("high"), F.slice("q", 2, len(probs)).alias("edges"))
    band = F.size(F.filter("edges", lambda e: F.col(risk) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn("band", band).withColumn("high_risk", F.col("band") == len(probs)).drop("edges")


def top_risk(df: DataFrame, risk: str, search: str | None = None, k: int | None = None) -> DataFrame:
    """The riskiest CVEs: 5, or 20 of those whose id contains the search text in any case."""
    found = df.filter(F.col(risk).isNotNull())
    if search:
        found = found.filter(F.contains(F.lower("cve_id"), F.lit(search.lower())))
    return found.orderBy(F.desc(risk), "cve_id").limit(k or (20 if search else 5))
