"""Best-fit packing of tokenized documents, planned on the histogram of piece lengths.

The plan is made for counts of pieces, never for documents: a histogram of at most `capacity` lengths comes to the
driver, best-fit-decreasing runs on groups of equal sequences, and the resulting slot ranges (a piece's rank within
its length -> sequence and offset) go back by a join. A sequence holds at most about sqrt(2 * capacity) different
lengths and each length splits few groups, so the plan stays below `PLAN_ROWS` rows whatever the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from vulnlake.llm.bpe import IdPacker
from vulnlake.llm.common import checkpointed, id_and_text, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_ROWS = 200_000


def piece_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    packer, end = IdPacker(vocabulary), end_id.to_bytes(4, "little")
    for batch in batches:
        for part in slices(batch, "text"):
            columns: list[list[int | None]] = [[], [], [], [], []]
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                ids = packer.pack(text) + end
                total, start, piece = len(ids) // 4, 0, 0
                length = (total - 1) % capacity + 1  # the first piece takes what full ones leave
                while start < total:
                    row = (doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                    for column, value in zip(columns, row):
                        column.append(value)
                    start, piece, length = start + length, piece + 1, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit-decreasing over counts: rows (length, first_rank, last_rank, first_sequence, per_sequence, offset).

    A piece of rank r in first_rank..last_rank of its length goes to sequence first_sequence + (r - first_rank) div
    per_sequence, at offset + (r - first_rank) mod per_sequence * length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs (first sequence, how many)
    plan, used = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(first: int, sequences: int, free: int) -> int:
            """Fill a run of equal sequences as far as pieces are left; the sequences that stay as they were."""
            nonlocal left, rank
            each = free // length
            taken = min(left, sequences * each)
            plan.append((length, rank, rank + taken - 1, first, each, capacity - free))
            full, rest = divmod(taken, each)
            for n, size in ((full, each), (1, rest)):
                if size and n:
                    if free - size * length:
                        room.setdefault(free - size * length, []).append((first, n))
                    first += n
            left, rank = left - taken, rank + taken
            return sequences - full - bool(rest)

        for free in sorted(f for f in room if f >= length):
            runs = room.pop(free)
            while runs and left:
                first, sequences = runs.pop()
                if same := place(first, sequences, free):
                    runs.append((first + sequences - same, same))
            if runs:
                room.setdefault(free, []).extend(runs)
            if not left:
                break
        if left:
            new = -(-left // (capacity // length))
            place(used, new, capacity)
            used += new
    return plan


def ranked(pieces: DataFrame, per_task: int) -> DataFrame:
    """Adds `rank`, from 0 within each length, without ever ordering one length in one task.

    Pieces are dealt by a hash of their own columns into cells of about `per_task` rows of a length; cells are numbered
    by running sums of their counts, rows inside their cell. Equal rows may swap ranks, which no column shows.
    """
    most = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    cell = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(max(1, -(-most // per_task))))
    dealt = pieces.withColumn("cell", cell)
    before = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = dealt.groupBy("length", "cell").count().select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32"))
    return dealt.withColumn("inside", inside).join(cells, ["length", "cell"]).withColumn("rank", F.col("before") + F.col("inside") - 1).drop("cell", "inside", "before")


def best_fit_pack(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, per_task: int = 20_000) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32, sequence_id, offset`: each document's ids and an end id, packed.

    A document of over `capacity` ids is cut into full pieces, of which the first may be shorter. A null or empty text
    is its end id alone. Repeated rows are packed as often as they occur; an empty table gives no rows;
    other columns are left out.
    """
    spark: SparkSession = docs.sparkSession
    pieces = checkpointed(id_and_text(docs).mapInArrow(lambda batches: piece_rows(batches, vocabulary, capacity, end_id), PIECES))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = plan_slots(histogram, capacity)
    if len(plan) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(plan)} rows")
    names = ("plan_length", "first_rank", "last_rank", "first_sequence", "per_sequence", "base")
    slots = spark.createDataFrame(plan, T.StructType([T.StructField(n, T.LongType()) for n in names]))
    by = (F.col("length") == F.col("plan_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    beyond = F.col("rank") - F.col("first_rank")
    return (
        ranked(pieces, per_task)
        .join(F.broadcast(slots), by)
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(beyond / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("base") + beyond % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        )
    )
