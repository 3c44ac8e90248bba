"""Row features as column expressions. Missing values are null, never NaN or text."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000_000.0
#: Phrases that mark an exploitable description, and vector ordinals by metric.
KEYWORDS = ("remote code execution", "buffer overflow", "sql injection", "privilege escalation")
ORDINALS = {
    "AV": {"P": 0, "L": 1, "A": 2, "N": 3}, "AC": {"H": 0, "L": 1}, "PR": {"H": 0, "L": 1, "N": 2}, "UI": {"R": 0, "N": 1},
    "S": {"U": 0, "C": 1}, "C": {"N": 0, "L": 1, "H": 2}, "I": {"N": 0, "L": 1, "H": 2}, "A": {"N": 0, "L": 1, "H": 2},
}


def day_lag(later: Column, earlier: Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(DAY)


def publication_lag(dates: Sequence[Column]) -> Column:
    """Days from the earliest to the latest date there is; null without any."""
    return day_lag(F.greatest(*dates), F.least(*dates))


def cross_listing_count(flags: Iterable[Column]) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))


def spread_days(dates: Sequence[Column], ddof: int) -> Column:
    """Variance of the dates there are, in days squared; null with `ddof` dates or fewer."""
    days = F.array_compact(F.array(*[F.unix_micros(d.cast("timestamp")) / F.lit(DAY) for d in dates]))
    mean = F.aggregate(days, F.lit(0.0), lambda a, x: a + x) / F.size(days)
    squares = F.aggregate(days, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(days) > ddof, squares / (F.size(days) - ddof))


def coverage_vector(flags: dict[str, Column]) -> Column:
    """Map of source name to 0 or 1."""
    return F.create_map(*[x for name, f in flags.items() for x in (F.lit(name), F.coalesce(f, F.lit(False)).cast("int"))])


def severity_label(text: Column | None = None, score: Column | None = None) -> Column:
    """From a severity text (MODERATE counts as MEDIUM), else from the score; null stays null."""
    named = F.lit(None).cast("string") if text is None else F.nullif(F.upper(F.trim(text)), F.lit(""))
    named = F.when(named == "MODERATE", "MEDIUM").otherwise(named)
    if score is None:
        return named
    banded = F.when(score <= 3.9, "LOW").when(score <= 6.9, "MEDIUM").when(score <= 8.9, "HIGH").when(score.isNotNull(), "CRITICAL")
    return F.coalesce(named, banded)


def kev_flag(columns: Sequence[tuple[Column, str]], accept_text: bool = True) -> Column:
    """Whether any column says exploited: true, 1, a timestamp, or (with `accept_text`) a yes or a date as text."""
    tests = []
    for column, kind in columns:
        if kind == "boolean":
            tests.append(column)
        elif kind.startswith("timestamp") or kind == "date":
            tests.append(column.isNotNull())
        elif kind == "string":
            text = F.lower(F.trim(column))
            tests.append(text.isin("true", "1", "yes") | text.rlike(r"^20\d\d-\d\d-\d\d") if accept_text else F.lit(False))
        else:
            tests.append(column == 1)
    return reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(False))


def text_stats(text: Column, keywords: Sequence[str] = KEYWORDS) -> dict[str, Column]:
    """Length, words between blanks, and whether a keyword occurs; 0 for null."""
    safe = F.coalesce(text, F.lit(""))
    hit = reduce(or_, [F.contains(F.lower(safe), F.lit(k)) for k in keywords], F.lit(False))
    return {"desc_len": F.length(safe), "word_count": F.regexp_count(safe, F.lit(r"\S+")), "has_keyword": hit.cast("int")}


def reference_count(text: Column, given: Column | None = None, pattern: str = "https?://") -> Column:
    """A given count, else how often the pattern occurs."""
    counted = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern))
    return counted if given is None else F.coalesce(given.try_cast("int"), counted)


def cwe_category(text: Column) -> Column:
    """The first CWE id; null without."""
    return F.nullif(F.regexp_extract(text, r"CWE-\d+", 0), F.lit(""))


def cwe_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"CWE-\d+"))


def vector_metric(vector: Column, metric: str) -> Column:
    """A metric of a CVSS vector, upper case; of duplicates the last, null without."""
    value = F.regexp_extract(F.upper(vector), rf"^(?:.*/)?{metric}:([^/]*)", 1)
    return F.nullif(value, F.lit(""))


def parse_cvss_vector(vector: Column) -> dict[str, Column]:
    parts = {f"cvss_{m.lower()}": vector_metric(vector, m) for m in ORDINALS}
    return {**parts, "cvss_v3_present": reduce(or_, [p.isNotNull() for p in parts.values()]).cast("int")}


def cvss_ordinals(vector: Column) -> dict[str, Column]:
    """Ordinal of each metric's letter; null for unknown letters."""
    out = {}
    for metric, order in ORDINALS.items():
        letter, value = vector_metric(vector, metric), F.lit(None).cast("int")
        for k, v in order.items():
            value = F.when(letter == k, v).otherwise(value)
        out[f"cvss_{metric.lower()}_ord"] = value
    return out


def epss_features(score: Column, percentile: Column) -> dict[str, Column]:
    from vulnlake.functions.coerce import number

    return {"epss_score": number(score), "epss_percentile": number(percentile), "epss_present": number(score).isNotNull().cast("int")}


def poc_features(references: Column, published: Column, first_poc: Column | None = None) -> dict[str, Column]:
    """Proof-of-concept links by site, and how soon after publication the first was seen."""
    text = F.lower(F.coalesce(references, F.lit("")))
    sites = {"github_poc_count": "github\\.com", "exploitdb_count": "exploit-db\\.com", "metasploit_count": "metasploit"}
    counts = {name: F.regexp_count(text, F.lit(p)) for name, p in sites.items()}
    every = counts["github_poc_count"] + counts["exploitdb_count"] + counts["metasploit_count"]
    lag = F.lit(None).cast("double") if first_poc is None else day_lag(first_poc, published)
    return {
        "github_poc_count": counts["github_poc_count"], "poc_url_count": every,
        "exploitdb_present": (counts["exploitdb_count"] > 0).cast("int"), "metasploit_present": (counts["metasploit_count"] > 0).cast("int"),
        "poc_any_present": (every > 0).cast("int"), "first_poc_lag_days": lag, "poc_within_30d": F.coalesce(lag.between(0, 30), F.lit(False)).cast("int"),
    }
