"""Versions of a master table: folders that are written once, and a log that names those of each version.

A commit writes its rows to a folder of its own and then makes the next entry of the log, which fails where that entry
is there already. So of two writers one comes second, is told so, and goes on from the version that the first one made.
Readers take the newest entry, or the one they ask for, and read the folders it names: nothing is ever moved or
rewritten, and a writer that stops half-way leaves a folder that no entry names.

An entry's `parts` are in order of arrival. Where it has a `key`, the newest row per key counts; a new part is put
together with those before it that are at most twice its size, so a table has few parts and a row is rewritten few
times. Entries are small and stay; folders that no kept version names are dropped by age.

The next entry is made by a hard link on a local disk, elsewhere by a rename that does not overwrite, which has to be
atomic in the store (HDFS and its kin).
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vulnlake.functions.coerce import coerce_types
from vulnlake.operators.upsert import newest

Entry = dict[str, Any]
EMPTY: Entry = {"version": 0, "parts": []}
#: Later parts of at most so many rows tell the first part by a broadcast which keys they hold.
BROADCAST_ROWS = 200_000


class Conflict(RuntimeError):
    """Another writer's version came first."""


def hadoop(spark: SparkSession, place: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, place: str) -> bool:
    files, path = hadoop(spark, place)
    return files.exists(path)


def remove(spark: SparkSession, place: str) -> None:
    files, path = hadoop(spark, place)
    files.delete(path, True)


def listed(spark: SparkSession, place: str) -> list[tuple[str, float]]:
    """Names in a folder, with the seconds since each changed; none for a folder that isn't there."""
    files, path = hadoop(spark, place)
    found = files.listStatus(path) if files.exists(path) else []
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in found]


def entry_name(version: int) -> str:
    return f"{version:020d}.json"


def entry(spark: SparkSession, place: str, version: int | None = None) -> Entry:
    """The newest entry, or that of a version; `EMPTY` where there is no log."""
    if version is None:
        version = max((int(n[:-5]) for n, _ in listed(spark, f"{place}/log") if n.endswith(".json") and n[:-5].isdigit()), default=0)
    if not version:
        return dict(EMPTY)
    files, path = hadoop(spark, f"{place}/log/{entry_name(version)}")
    stream = files.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, place: str, new: Entry) -> bool:
    """Makes the entry of `new`; whether it is this one that did."""
    draft = f"{place}/log/{uuid.uuid4().hex}.draft"
    files, path = hadoop(spark, draft)
    stream = files.create(path, False)
    stream.write(bytearray(json.dumps(new).encode()))
    stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/log/{entry_name(new['version'])}")
    try:
        if files.getUri().getScheme() == "file":
            os.link(path.toUri().getPath(), target.toUri().getPath())
        else:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
            context.rename(path, target, spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        files.delete(path, False)
    return True


def change(spark: SparkSession, place: str, make: Callable[[Entry], Entry | None], tries: int = 50) -> Entry:
    """Commits what `make` makes of the newest entry, from the start again where another writer comes first; None changes
    nothing."""
    for _ in range(tries):
        now = entry(spark, place)
        new = make(now)
        if new is None:
            return now
        new = {**new, "version": now["version"] + 1, "time": time.time()}
        if commit(spark, place, new):
            return new
    raise Conflict(f"{place}: {tries} versions of other writers came first")


def flat(df: DataFrame) -> DataFrame:
    """With arrays, maps and structs as compact JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_part(df: DataFrame, place: str, csv: bool) -> Entry:
    """A new folder with the rows, as Parquet and, if asked for, CSV."""
    spark, name = df.sparkSession, f"data/{uuid.uuid4().hex}"
    df.write.parquet(f"{place}/{name}/parquet")
    back = spark.read.schema(df.schema).parquet(f"{place}/{name}/parquet")
    if csv:
        flat(back).write.option("header", True).option("escape", '"').csv(f"{place}/{name}/csv")
    return {"folder": name, "rows": back.count(), "csv": csv}


def read_part(spark: SparkSession, folder: str, moments: tuple[str, ...]) -> DataFrame:
    """The Parquet form, else the CSV form with its dates parsed."""
    try:
        return spark.read.parquet(f"{folder}/parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return coerce_types(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{folder}/csv"), moments=moments)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def moment(changed: str) -> Column:
    """A time as microseconds; a missing one counts as epoch."""
    return F.coalesce(F.unix_micros(F.col(changed).cast("timestamp")), F.lit(0).cast("long"))


def resolved(frames: list[DataFrame], key: str, changed: str) -> DataFrame:
    """The newest row per key of parts in order of arrival: a missing time counts as epoch, of equal times the later part wins."""
    numbered = union([f.withColumn("arrival_", F.lit(i)) for i, f in enumerate(frames)])
    return newest(numbered, key, [moment(changed), F.col("arrival_")]).drop("arrival_")


def rows_of(spark: SparkSession, place: str, at: Entry, moments: tuple[str, ...] = ()) -> DataFrame:
    """The table of an entry. Rows of the first part whose keys no later part holds are not shuffled to find that out."""
    frames = [read_part(spark, f"{place}/{p['folder']}", moments) for p in at["parts"]]
    if len(frames) == 1 or not at.get("key"):
        return union(frames)
    key, first, later = at["key"], frames[0], frames[1:]
    held = union([f.select(F.col(key).alias("held_")) for f in later]).distinct()
    held = F.broadcast(held) if sum(p["rows"] for p in at["parts"][1:]) <= BROADCAST_ROWS else held
    same = first[key].eqNullSafe(F.col("held_"))
    newer = resolved([first.join(held, same, "left_semi"), *later], key, at["changed"])
    return first.join(held, same, "left_anti").unionByName(newer, allowMissingColumns=True)


def read(spark: SparkSession, place: str, version: int | None = None, moments: tuple[str, ...] = ()) -> DataFrame:
    at = entry(spark, place, version)
    if not at["parts"]:
        raise FileNotFoundError(f"no master at {place}")
    return rows_of(spark, place, at, moments)


def replace(df: DataFrame, place: str, csv: bool = True, based_on: int | None = None) -> int:
    """The rows become the table; its version. With `based_on`, only if that is still the newest version."""
    part = write_part(df, place, csv)

    def make(now: Entry) -> Entry:
        if based_on is not None and now["version"] != based_on:
            raise Conflict(f"{place} is at version {now['version']}, not {based_on}")
        return {"parts": [part], "batches": now.get("batches", {})}

    return change(df.sparkSession, place, make)["version"]


def append(df: DataFrame, place: str, csv: bool = True) -> int:
    """Adds the rows, in the same forms as the table's."""
    part: Entry = {}

    def make(now: Entry) -> Entry:
        if not part:
            part.update(write_part(df, place, csv and all(p["csv"] for p in now["parts"])))
        if now.get("key"):  # appended rows stay, whatever their keys
            now = {**now, "parts": [write_part(rows_of(df.sparkSession, place, now), place, part["csv"])]}
        return {"parts": [*now["parts"], part], "batches": now.get("batches", {})}

    return change(df.sparkSession, place, make)["version"]


def upsert(df: DataFrame, place: str, key: str, changed: str, csv: bool = True, batch: tuple[str, int] | None = None) -> int:
    """The newest row per key of the table and the rows (one per key). With `batch` (a source's name and the number of its
    batch), a batch that the table has already changes nothing."""
    spark, own = df.sparkSession, {}

    def make(now: Entry) -> Entry | None:
        if batch and now.get("batches", {}).get(batch[0], -1) >= batch[1]:
            return None
        if not own:
            own.update(write_part(df, place, csv and all(p["csv"] for p in now["parts"])))
        parts, size = now["parts"], own["rows"]
        if parts and (now.get("key"), now.get("changed")) != (key, changed) and (len(parts) > 1 or now.get("key")):
            parts = [write_part(rows_of(spark, place, now), place, own["csv"])]
        first = len(parts)
        while first and parts[first - 1]["rows"] <= 2 * size:
            first, size = first - 1, size + parts[first - 1]["rows"]
        # a table that came by replacing may hold a key more than once, so its first part is resolved when it is first met
        if parts and first == 1 and not now.get("key"):
            first = 0
        merged = own
        if parts[first:]:
            frames = [spark.read.parquet(f"{place}/{p['folder']}/parquet") for p in (*parts[first:], own)]
            merged = write_part(resolved(frames, key, changed), place, own["csv"])
        return {"parts": [*parts[:first], merged], "key": key, "changed": changed, "batches": {**now.get("batches", {}), **({batch[0]: batch[1]} if batch else {})}}

    return change(spark, place, make)["version"]


def compact(spark: SparkSession, place: str) -> int:
    """All parts in one, so that readers have nothing to put together."""

    def make(now: Entry) -> Entry | None:
        if len(now["parts"]) < 2:
            return None
        return {**now, "parts": [write_part(rows_of(spark, place, now), place, all(p["csv"] for p in now["parts"]))]}

    return change(spark, place, make)["version"]


def drop_old(spark: SparkSession, place: str, seconds: float) -> list[str]:
    """Removes folders older than `seconds` that neither the newest version nor one younger than that names; their names."""
    newest_version = entry(spark, place)["version"]
    ages = {n: age for n, age in listed(spark, f"{place}/log") if n.endswith(".json")}
    kept = [v for v in range(1, newest_version + 1) if v == newest_version or ages.get(entry_name(v), seconds) < seconds or ages.get(entry_name(v + 1), seconds) < seconds]
    named = {p["folder"] for v in kept for p in entry(spark, place, v)["parts"]}
    gone = [f"data/{n}" for n, age in listed(spark, f"{place}/data") if age >= seconds and f"data/{n}" not in named]
    for folder in gone:
        remove(spark, f"{place}/{folder}")
    return gone
