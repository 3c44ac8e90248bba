"""Records of large JSON pages, read by many tasks: a page is cut into byte ranges wherever they fall.

Spark's text reader splits a file at closing braces, in ranges of `spark.sql.files.maxPartitionBytes`. A first pass scans
each range twice, as if it began inside a text and as if outside, and tells by how much brackets move the depth; from
that the true state at each range's start follows, range by range. A second pass cuts out the records, which are the
objects in arrays of a page's top object; one that goes over a range's end is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{\[\]}]', re.DOTALL)
REST = re.compile(r'(?:[^"\\]|\\.)*("?)', re.DOTALL)
#: Place in its range of a record that goes on in the next one.
OPEN = 2**31 - 1


class Start(NamedTuple):
    """State where a range begins: whether in a text, the depth, the depth of records, and the range in which the record
    that is open there began."""

    inside: bool
    depth: int
    level: int
    opened: int | None


def brackets(text: str, inside: bool) -> Iterator[tuple[int, int]]:
    """Places after brackets outside of texts with +1 or -1; at the end (-1, whether a text is open)."""
    at = 0
    if inside:
        found = REST.match(text)
        at, inside = found.end(), not found.group(1)
    while not inside:
        found = TOKEN.search(text, at)
        if not found:
            break
        at = found.end()
        mark = text[found.start()]
        if mark == '"':
            inside = not found.group(1)
        else:
            yield at, 1 if mark in "{[" else -1
    yield -1, int(inside)


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): texts between closing braces, in order within a range."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Ranges one after the other, each with its fragments' texts, closing braces put back."""
    rows = ((f, b, v) for batch in batches for f, b, v in zip(*[batch[c].to_pylist() for c in ("file", "block", "value")]))
    held = next(rows, None)
    while held:
        at = held[:2]

        def own() -> Iterator[str]:
            nonlocal held
            while held and held[:2] == at:  # noqa: B023
                yield held[2] + "}"
                held = next(rows, None)

        yield at, own()


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range, for a start outside and inside a text: whether it ends inside, by how much the depth moves, its least."""
    for (file, block), texts in by_range(batches):
        state = [[False, 0, 0], [True, 0, 0]]
        first = ""
        for text in texts:
            first = first or text.lstrip()[:1]
            for s in state:
                for place, step in brackets(text, s[0]):
                    if place < 0:
                        s[0] = bool(step)
                    else:
                        s[1] += step
                        s[2] = min(s[2], s[1])
        values = [file, block, first, *[x for s in state for x in s]]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.bool_(), pa.int64(), pa.int64()] * 2]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["file", "block", "first", "in0", "by0", "least0", "in1", "by1", "least1"])


def starts(rows: list) -> dict[tuple[str, int], Start]:
    """The state at the start of each range, from the summaries of all."""
    out, file, now = {}, None, Start(False, 0, 3, None)
    for r in sorted(rows, key=lambda r: (r["file"], r["block"])):
        if r["file"] != file:
            file, now = r["file"], Start(False, 0, 4 if r["first"] == "[" else 3, None)
        out[file, r["block"]] = now
        inside, by, least = (r[f"{k}{int(now.inside)}"] for k in ("in", "by", "least"))
        depth = now.depth + by
        fresh = now.depth < now.level or now.depth + least < now.level  # any record open at the end began here
        now = Start(inside, depth, now.level, None if depth < now.level else r["block"] if fresh else now.opened)
    return out


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, place, record): the JSON text of each record; (block, place) is its order in the file.

    The state of ranges, a row for each, goes through the driver.
    """
    rows = fragments(spark, path)
    told = "file string, block long, first string, in0 boolean, by0 long, least0 long, in1 boolean, by1 long, least1 long"
    state = starts(rows.mapInArrow(summaries, told).collect())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), texts in by_range(batches):
            inside, depth, level, opened = state[file, block]
            held, place = [], 0
            key = (opened, OPEN) if depth >= level else None
            for text in texts:
                done, begin = [], 0 if key else None
                for at, step in brackets(text, inside):
                    if at < 0:
                        inside = bool(step)
                        break
                    depth += step
                    if step > 0 and depth == level and text[at - 1] == "{":
                        key, begin, place = (block, place), at - 1, place + 1
                    elif step < 0 and depth == level - 1 and key:
                        done.append((*key, "".join([*held, text[begin:at]])))
                        key, begin, held = None, None, []
                if key:
                    held.append(text[begin:])
                if done:
                    yield piece(file, block, done)
            if key:  # goes on in the next range
                yield piece(file, block, [(key[0], OPEN, "".join(held))])

    def piece(file: str, block: int, done: list[tuple[int, int, str]]) -> pa.RecordBatch:
        began, place, text = zip(*done)
        n = len(done)
        arrays = [pa.array([file] * n), pa.array(began, pa.int64()), pa.array(place, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "place", "part", "text"])

    pieces = rows.mapInArrow(cut, "file string, block long, place long, part long, text string")
    whole = pieces.filter(F.col("place") != OPEN).select("file", "block", "place", F.col("text").alias("record"))
    open_ = pieces.filter(F.col("place") == OPEN).groupBy("file", "block", "place").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    return whole.unionByName(open_.select("file", "block", "place", F.array_join(F.col("parts.text"), "").alias("record")))


def page_number(file: Column) -> Column:
    """The last number in a file's name, so that page 10 comes after page 9."""
    return F.coalesce(F.regexp_extract(F.regexp_extract(file, r"[^/]*$", 0), r"(\d+)\D*$", 1).try_cast("long"), F.lit(-1).cast("long"))
