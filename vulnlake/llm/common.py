"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python-side work on a batch is done in slices of about this many bytes of text.
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only `doc_id` (long) and `text` (string), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is the session's `spark.checkpoint.dir`; a temporary one is set only where that is unset and all runs on one
    machine (tests, benches).
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; `name` may also be a path of its own."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of `column` each (one row at least)."""
    start = used = 0
    for i, n in enumerate(pa.compute.binary_length(batch[column]).to_pylist()):
        used += n or 0
        if used >= limit:
            yield batch.slice(start, i + 1 - start)
            start, used = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def packed_texts(docs: DataFrame) -> DataFrame:
    """With `text` as compressed bytes (`packed`), which halves what a join moves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [press.compress((t or "").encode()) for t in part["text"].to_pylist()]
                rest = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[part[n] for n in rest], pa.array(packed, pa.binary())], names=[*rest, "packed"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return docs.mapInArrow(rows, ", ".join([*kinds, "packed binary"]))


def unpacked(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A table in the shared folder, read again, and its place."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return spark.read.parquet(place), place


def removed(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
