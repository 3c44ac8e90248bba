"""Master tables on shared storage and in databases."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vulnlake.operators.upsert import newest
from vulnlake.sources import snapshots
from vulnlake.sources.snapshots import exists, flat, read_part, remove  # noqa: F401


def scratch(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the cluster shares (`spark.checkpoint.dir`), or a temporary one where that is unset."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        shared = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, kept in the shared folder: later plans, of many rounds, don't carry their lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch(df.sparkSession, "checkpoint"))
    return df.checkpoint(eager=True)


def read_master(spark: SparkSession, place: str, moments: Sequence[str] = ("published", "lastmodified"), version: int | None = None) -> DataFrame:
    """A master's newest version, or the one asked for; a plain folder without versions is read as it is. The Parquet form,
    else the CSV form with its dates parsed."""
    at = snapshots.entry(spark, place, version)
    return snapshots.rows_of(spark, place, at, tuple(moments)) if at["parts"] else read_part(spark, place, tuple(moments))


def write_master(df: DataFrame, place: str, based_on: int | None = None) -> int:
    """Parquet and CSV, as the next version; its number. With `based_on`, only if that is still the newest version."""
    return snapshots.replace(df, place, based_on=based_on)


def publish_table(
    df: DataFrame, target: str, mode: str = "append", key: str | None = None, changed: str | None = None, url: str | None = None, batch: str | None = None, **options: str
) -> None:
    """Append to, replace or upsert a table: over JDBC with `url`, else a master at a path.

    Upserts over JDBC overwrite the rows of known keys and insert the others; a `batch` that was taken before changes nothing.
    """
    if mode not in ("append", "replace", "upsert"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "upsert" and (not key or key not in df.columns):
        raise ValueError("an upsert needs a key column")
    if not url:
        if mode == "upsert":
            order = changed or key
            when = [snapshots.moment(order)]
            snapshots.upsert(newest(df, key, when), target, key, order)
        else:
            (snapshots.append if mode == "append" else snapshots.replace)(df, target)
        return
    if mode == "upsert":
        upsert_jdbc(df, target, key, changed, url, batch or uuid.uuid4().hex, options)
        return
    writer = flat(df).write.format("jdbc").options(url=url, dbtable=target, **options)
    (writer.mode("append") if mode == "append" else writer.mode("overwrite").option("truncate", "true")).save()


def connection(spark: SparkSession, url: str, options: dict[str, str]) -> Any:
    """A connection of the driver's, with the session's own class loader, so that drivers added as jars are found."""
    jvm = spark._jvm
    properties = jvm.java.util.Properties()
    for name, value in options.items():
        properties.setProperty(name, value)
    if "driver" not in options:
        return jvm.java.sql.DriverManager.getConnection(url, properties)
    return jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(options["driver"]).newInstance().connect(url, properties)


def upsert_jdbc(df: DataFrame, target: str, key: str, changed: str | None, url: str, batch: str, options: dict[str, str]) -> bool:
    """Stages the rows in a table of the batch's own, by all executors, and merges that on the server in one transaction
    that also notes the batch in <target>_batches. Whether it did: a batch that is noted already changes nothing, one that
    failed leaves the target as it was and can be sent again.

    Of several rows of a key the newest by `changed` counts. A missing target is made with `key` as its primary key
    (texts as VARCHAR(255), or as `createTableColumnTypes` says); a null key is refused by it, and nothing is changed.
    """
    spark = df.sparkSession
    rows = flat(newest(df, key, [snapshots.moment(changed or key)]))
    if "createTableColumnTypes" not in options and isinstance(rows.schema[key].dataType, T.StringType):
        options = {**options, "createTableColumnTypes": f"`{key}` VARCHAR(255)"}
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    stage, noted, k = f"{target}_stage_{zlib.crc32(batch.encode()):08x}", f"{target}_batches", quoted(key)
    into = lambda frame, table, mode: frame.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
    db = connection(spark, url, options)
    try:
        db.setAutoCommit(True)
        known = lambda table: db.getMetaData().getTables(None, None, table.rpartition(".")[2].upper(), None).next() or db.getMetaData().getTables(None, None, table.rpartition(".")[2], None).next()
        run = lambda text: db.createStatement().executeUpdate(text)
        if not known(noted):
            run(f"CREATE TABLE {noted} (batch VARCHAR(255) NOT NULL PRIMARY KEY)")
        asked = db.prepareStatement(f"SELECT batch FROM {noted} WHERE batch = ?")
        asked.setString(1, batch)
        if asked.executeQuery().next():
            return False
        if not known(target):
            fields = [T.StructField(f.name, f.dataType, f.name != key) for f in rows.schema]
            into(spark.createDataFrame([], T.StructType(fields)), target, "append")
            run(f"ALTER TABLE {target} ADD PRIMARY KEY ({k})")
        into(rows, stage, "overwrite")
        db.setAutoCommit(False)
        note = db.prepareStatement(f"INSERT INTO {noted} VALUES (?)")
        note.setString(1, batch)
        note.executeUpdate()
        names = [quoted(c) for c in rows.columns]
        merge = f"MERGE INTO {target} t USING {stage} s ON t.{k} = s.{k}"
        if len(names) > 1:
            merge += f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{n} = s.{n}' for n in names if n != k)}"
        run(f"{merge} WHEN NOT MATCHED THEN INSERT ({', '.join(names)}) VALUES ({', '.join(f's.{n}' for n in names)})")
        db.commit()
        db.setAutoCommit(True)
        run(f"DROP TABLE {stage}")
        return True
    finally:
        if not db.getAutoCommit():
            db.rollback()
        db.close()
