"""CVE ids in columns, delimited aliases and free text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An id anywhere, and one as feeds list it.
ANY_ID = r"CVE-\d{4}-\d+"
LISTED_ID = r"CVE-\d{4}-\d{4,7}"


def found_id(column: Column, pattern: str = ANY_ID) -> Column:
    """The first id in a text, upper case; null where there is none."""
    return F.nullif(F.regexp_extract(F.upper(column.cast("string")), pattern, 0), F.lit(""))


def canonical_cve_id(df: DataFrame, preferred: Sequence[str], others: Sequence[str] | None = None) -> Column:
    """The id of the first preferred column that has one, else of any other string column."""
    rest = [c for c, kind in df.dtypes if kind == "string" and c not in preferred] if others is None else others
    return F.coalesce(*[found_id(F.col(c)) for c in [*preferred, *rest] if c in df.columns], F.lit(None).cast("string"))


def extract_ids_from_text(df: DataFrame) -> DataFrame:
    """Distinct ids in any column of a table without an id column, flagged as listed."""
    row = F.upper(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns]))
    ids = F.explode(F.regexp_extract_all(row, F.lit(f"({LISTED_ID})"), 1)).alias("cve_id")
    return df.select(ids).distinct().withColumn("kev_listed", F.lit(True))


def explode_aliases(df: DataFrame, column: str) -> DataFrame:
    """One row for each CVE in a delimited field, as `cve_id`, with all other columns."""
    parts = F.filter(F.split(F.upper(F.col(column)), r"[,;|\s]+"), lambda p: p.rlike(rf"^{LISTED_ID}\b"))
    ids = F.transform(parts, lambda p: F.regexp_extract(p, LISTED_ID, 0))
    return df.withColumn("cve_id", F.explode(F.array_distinct(ids))).drop(column)


def cve_year(column: Column) -> Column:
    """The year digits of an id; null without."""
    return F.nullif(F.regexp_extract(column, r"CVE-(\d{4})-", 1), F.lit("")).try_cast("int")
