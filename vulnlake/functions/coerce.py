"""Column names, nested columns and types brought into a known form; no function here looks at data."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Date forms tried in turn.
DATE_FORMS = ("yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mmX", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "MMM d, yyyy, h:mm:ss a", "MMM d, yyyy")


def plain_name(name: str) -> str:
    """Lower case, other characters than letters, digits and _ as one _, none at the ends."""
    return re.sub("_+", "_", re.sub(r"\W", "_", name.strip().lower())).strip("_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Plain names; of columns that get the same one, the first stays."""
    names = [plain_name(c) for c in df.columns]
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    first = {n: i for i, n in reversed(list(enumerate(names)))}
    return numbered.select(*[F.col(f"c{i}").alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])])


def flatten_struct(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """The leaves of a struct column as columns prefix_a_b; arrays and maps as compact JSON text."""

    def leaves(kind: T.StructType, path: str, name: str) -> Iterable[Column]:
        for field in kind.fields:
            at, label = f"{path}.`{field.name}`", f"{name}_{plain_name(field.name)}"
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, at, label)
            elif isinstance(field.dataType, (T.ArrayType, T.MapType)):
                yield F.to_json(F.col(at)).alias(label)
            else:
                yield F.col(at).alias(label)

    return df.select("*", *leaves(df.schema[column].dataType, f"`{column}`", prefix))


def number(column: Column) -> Column:
    """As double; what is no number, and NaN, is null."""
    value = column.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def moment(column: Column, forms: Iterable[str] = DATE_FORMS) -> Column:
    """As UTC timestamp, by ISO 8601 first and then the given forms; null where none fits."""
    text = column.cast("string")
    return F.coalesce(F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in forms])


def coerce_types(df: DataFrame, numbers: Iterable[str] = (), moments: Iterable[str] = ()) -> DataFrame:
    """Named columns as doubles and timestamps; names that the table lacks are left out."""
    have = set(df.columns)
    return df.withColumns({**{c: number(F.col(c)) for c in numbers if c in have}, **{c: moment(F.col(c)) for c in moments if c in have}})


def at(column: Column | str) -> Column:
    """A timestamp without zone as one in UTC."""
    return (F.col(column) if isinstance(column, str) else column).cast("timestamp")
