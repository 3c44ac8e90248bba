"""Four feeds into one row per CVE, and joins that bring statistics and metadata back to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vulnlake.functions.ids import cve_year, found_id

#: Sources in the order of lists and dates.
SOURCES = {"nvd": "NVD", "jvn": "JVN", "eu": "EUVD", "kev": "KEV"}


def merge_sources(feeds: dict[str, DataFrame], min_year: int = 2002) -> DataFrame:
    """One row per CVE of feeds (cve_id, published, base_score): presence flags, dates, scores, source list, year.

    Rows are tagged, united and grouped once; chained outer joins would shuffle at every step. Rows without a usable id
    are dropped before the shuffle, ids of years before `min_year` too. Of a feed's rows for an id the latest dated
    counts, of equal dates that with the higher score.
    """
    tagged: DataFrame | None = None
    for tag, feed in feeds.items():
        if tag not in SOURCES:
            raise ValueError(f"unknown source {tag!r}")
        score = F.col("base_score").cast("double") if "base_score" in feed.columns else F.lit(None).cast("double")
        part = feed.select(found_id(F.col("cve_id")).alias("cve_id"), F.lit(tag).alias("tag"), F.struct(F.col("published").cast("timestamp").alias("published"), score.alias("base_score")).alias("r"))
        part = part.filter(cve_year(F.col("cve_id")) >= min_year)
        tagged = part if tagged is None else tagged.unionByName(part)
    if tagged is None:
        raise ValueError("no feeds")
    return merge_tagged(tagged)


def merge_tagged(tagged: DataFrame) -> DataFrame:
    """One row per id of rows (cve_id, tag, r), where `r` holds published and base_score; see `merge_sources`."""
    one = tagged.groupBy("cve_id").agg(*[F.max(F.when(F.col("tag") == t, F.col("r"))).alias(t) for t in SOURCES])
    flags = {t: F.col(t).isNotNull() for t in SOURCES}
    return one.select(
        "cve_id", cve_year(F.col("cve_id")).alias("cve_year"),
        *[flags[t].alias(f"{t}_present") for t in SOURCES],
        *[F.col(f"{t}.published").alias(f"{t}_published") for t in SOURCES],
        *[F.col(f"{t}.base_score").alias(f"{t}_base_score") for t in SOURCES if t != "kev"],
        *source_presence(flags),
        coalesce_published([F.col(f"{t}.published") for t in SOURCES]).alias("published"),
        coalesce_score([F.col(f"{t}.base_score") for t in ("nvd", "eu", "jvn")]).alias("base_score"),
    )


def source_presence(flags: dict[str, Column]) -> list[Column]:
    """`source_list` (array in fixed order), `sources` (comma text) and `source_count`."""
    listed = F.array_compact(F.array(*[F.when(F.coalesce(flags[t], F.lit(False)), F.lit(name)) for t, name in SOURCES.items()]))
    return [listed.alias("source_list"), F.concat_ws(", ", listed).alias("sources"), F.size(listed).alias("source_count")]


def coalesce_published(dates: Sequence[Column]) -> Column:
    return F.coalesce(*dates)


def coalesce_score(scores: Sequence[Column]) -> Column:
    """The first score that is a number; the order is the caller's."""
    from vulnlake.functions.coerce import number

    return F.coalesce(*[number(s) for s in scores])


def group_stat_join(df: DataFrame, key: str, stats: dict[str, Column]) -> DataFrame:
    """Statistics per key, mapped back to the rows; rows with a null key get none and are never shuffled together."""
    by_key = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[s.alias(n) for n, s in stats.items()])
    return df.join(by_key, key, "left")


def attach_hazard(scores: DataFrame, hazard: DataFrame) -> DataFrame:
    """Left join of `hazard(cve_id, risk_score, predicted_day)`: display text and numeric day beside the score."""
    found = hazard.select("cve_id", F.col("risk_score").alias("hazard_score"), F.lit(True).alias("known_"), F.col("predicted_day").cast("string").alias("day_text"))
    day = F.col("day_text").try_cast("double")
    shown = F.when(F.col("known_"), F.coalesce("day_text", F.lit("Never"))).otherwise("No Prediction")
    return scores.join(found, "cve_id", "left").withColumns({"predicted_display": shown, "predicted_day_num": day}).drop("known_", "day_text")


def attach_metadata(scored: DataFrame, frame: DataFrame, texts: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join of descriptive columns; `description` is the first text that is not empty."""
    text = F.coalesce(*[F.nullif(F.col(t), F.lit("")) for t in texts]).alias("description")
    return scored.join(frame.select("cve_id", text, *columns), "cve_id", "left")
