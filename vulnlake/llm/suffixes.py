"""Removal of byte strings that occur more than once, by suffix arrays over anchored contexts.

A window is a string of `length` bytes. Its anchor is its least-hashed 64-byte gram (the rightmost of equals), so equal
windows have equal anchors at equal places. Consecutive windows of a text with one anchor form a run; each window is in
exactly one run, and its equals are in runs of the same anchor gram. Runs of grams that occur once are done. Windows of
several lengths share their anchors' rows, as a long window's anchor is also a short one's.

Runs that are equal byte for byte are repeats as a whole. What is left are anchors with several different runs: their
bytes are cut into content-defined phrases, and a suffix array over the phrases of many runs, made by linear grouping,
tells which windows hold the same phrases; windows alike in that are equal if the bytes before and after their phrases
are. A gram with over `CROWD` different runs is first split by longer grams around the anchor, down to single windows if
need be, so that no group grows with the data.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import checkpointed, packed_texts, removed, slices, unpacked, written

GRAM = 64
#: Content-defined phrases: a cut where the hash of the 16 bytes before it has its five lowest bits clear.
CUT_BYTES, CUT_MASK = 16, 31
#: Windows of a text that are looked at together, and runs in one task and group at most.
BLOCK, CROWD, PER_BUCKET = 1 << 20, 4000, 1500
BASE = 0x9E3779B97F4A7C15
PLACE = np.uint64((1 << 22) - 1)

#: A passage, in bytes and words: over 50 words, which have 240 bytes or more where they have four letters or so.
PASSAGE = 240, 51
SPANS = "doc_id long, text_hash long, size int, start long, stop long"
#: Rows of one run that meet in a task: a run that occurs very often is dealt into as many parts as the table asks for.
PART_ROWS, LEAST_PARTS = 500_000, 16


def run_columns(lengths: Sequence[int]) -> str:
    """Schema of runs: where the stretch begins and ends that holds the windows of all lengths around one anchor, and,
    from its beginning, the anchor and for each length the first window and how many follow each other."""
    own = [f"first_{n} int, windows_{n} int" for n in lengths]
    return ", ".join(["key long, run long, doc_id long, text_hash long, start long, reach int, anchor int", *own])


# ---------------------------------------------------------------- suffix array by grouping


def grouped_suffix_array(text: list[int]) -> list[int]:
    """Suffixes of `text` in order; its last symbol must be smaller than all others.

    Suffixes begin in groups by first symbol. From the greatest group down, each member tells the suffix before it that
    is smaller than all between (found in a list of those not yet done) that its Lyndon prefix goes on: such suffixes
    move to groups of their own behind the rest of theirs, those followed by more members further back. In the end a
    group shares its Lyndon prefix; going through the order from the start, each suffix puts those whose prefix ends
    where it begins at the next place of their group.
    """
    n = len(text)
    order = np.argsort(np.array(text), kind="stable")
    sorted_text = np.array(text)[order]
    first = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    starts = np.flatnonzero(first)
    group = np.empty(n, np.int64)
    group[order] = starts[np.cumsum(first) - 1]
    ends = np.zeros(n, np.int64)
    ends[starts] = np.append(starts[1:], n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    by_rank, group, stop, place = order.tolist(), group.tolist(), ends.tolist(), place.tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    smaller_after = [n] * n
    top = n
    while top:
        start = group[by_rank[top - 1]]
        members = by_rank[start:top]
        if len(members) > 1:
            members.sort()
        follows: dict[int, int] = {}
        for i in members:
            before, after = left[i], right[i]
            smaller_after[i] = after
            if after < n:
                left[after] = before
            if before >= 0:
                right[before] = after
                follows[before] = follows.get(before, 0) + 1
        top = start
        by_count: dict[int, list[int]] = {}
        for j, k in follows.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:
                g = group[j]
                last = stop[g] - 1
                at, other = place[j], by_rank[last]
                by_rank[at], by_rank[last] = other, j
                place[other], place[j] = at, last
                stop[g] = last
                moved[g] = moved.get(g, 0) + 1
            for g, size in moved.items():
                new = stop[g]
                for i in by_rank[new : new + size]:
                    group[i] = new
                stop[new] = new + size
    ending: list[int] = [-1] * (n + 1)  # for each place, a suffix whose Lyndon prefix ends there, then the next such
    more = [-1] * n
    for i in range(n - 1):
        s = smaller_after[i]
        more[i], ending[s] = ending[s], i
    free = list(range(n))
    result = [n - 1] + [0] * (n - 1)
    for rank in range(n):
        i = ending[result[rank]]
        while i >= 0:
            g = group[i]
            result[free[g]] = i
            free[g] += 1
            i = more[i]
    return result


def shared_lengths(text: list[int], order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each suffix, and for each rank how many symbols it shares with the suffix before it in order."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    shared, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while text[i + h] == text[j + h]:
                h += 1
            shared[r] = h
            h = max(0, h - 1)
        else:
            h = 0
    return np.array(rank), np.array(shared)


def first_alike(rank: np.ndarray, shared: np.ndarray, place: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes that begin with the same `depth` symbols as the one at each place, the least rank and whether there
    are others: steps of powers of two back through the order, as far as all neighbours share so much."""
    r = rank[place]
    after = np.append(shared, 0)[r + 1] >= depth
    steps, least = [shared], shared
    while len(least) > 1 << len(steps) - 1:
        w = 1 << len(steps) - 1
        least = np.concatenate([least[:w], np.minimum(least[w:], least[:-w])])  # of the 2w ranks that end here
        steps.append(least)
    at = r.copy()
    for k in range(len(steps) - 1, -1, -1):
        back = (at >= 1 << k) & (steps[k][at] >= depth)
        at[back] -= 1 << k
    return at, after | (at < r)


# ---------------------------------------------------------------- hashes


@cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for x in (BASE, pow(BASE, -1, 1 << 64)):
        row = np.full(size, x, np.uint64)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


class Hashed:
    """Prefix sums over bytes, for the hash of any part of them."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(22, int(len(data) + 1).bit_length())
        self.power, inverse = powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[: len(data)], out=self.sums[1:])

    def parts(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.power[start])

    def windows(self, size: int) -> np.ndarray:
        """Of all parts of one size."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:-size]) * self.power[:n])


def keyed(*columns: np.ndarray) -> np.ndarray:
    """One hash of several columns."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mixed(out * np.uint64(BASE) + c.astype(np.uint64))
    return out


# ---------------------------------------------------------------- runs of a batch


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    least, w = values, 1
    while 2 * w <= width:
        least, w = np.minimum(least[:-w], least[w:]), 2 * w
    n = len(values) - width + 1
    return least[:n] if w == width else np.minimum(least[:n], least[width - w :][:n])


def runs_of(pieces: list[bytes], lengths: Sequence[int]) -> dict[str, np.ndarray]:
    """Runs of the windows that start in the first `BLOCK` bytes of each piece, by piece and anchor.

    A window's anchor is also that of some shorter window around it, so that one row holds the windows of all lengths.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    hashed = Hashed(data)
    grams = hashed.windows(GRAM)
    place = np.arange(len(grams), dtype=np.uint64)
    ordered = grams & ~PLACE | PLACE - place
    found = {}
    for length in lengths:
        if len(data) < length:
            found[length] = [np.zeros(0, np.int64)] * 4
            continue
        least = window_minima(ordered, length - GRAM + 1)
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[begin[begin < len(new)]] = True
        past = begin + np.clip(size - length + 1, 0, BLOCK)  # windows from here on are another piece's
        new[past[past < len(new)]] = True
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(new))
        piece = np.searchsorted(begin, start, "right") - 1
        inside = start < past[piece]
        anchor = (PLACE - (least[start[inside]] & PLACE)).astype(np.int64)
        found[length] = [piece[inside], anchor, start[inside], stop[inside] - start[inside]]
    # a place is the anchor in one piece only, so anchors name the rows
    anchors, which = np.unique(np.concatenate([f[1] for f in found.values()]), return_index=True)
    piece = np.concatenate([f[0] for f in found.values()])[which]
    low, high = np.full(len(anchors), len(data)), np.zeros(len(anchors), np.int64)
    own = {}
    for length, (_, anchor, start, windows) in found.items():
        at = np.searchsorted(anchors, anchor)
        first, many = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
        first[at], many[at] = start, windows
        low[at], high[at] = np.minimum(low[at], start), np.maximum(high[at], start + windows + length - 1)
        own[length] = first, many
    columns = {"piece": piece, "start": low - begin[piece], "reach": high - low, "anchor": anchors - low, "key": grams[anchors]}
    for length, (first, many) in own.items():
        columns |= {f"first_{length}": np.where(many > 0, first - low, 0), f"windows_{length}": many}
    return columns | {"run": run_hash(hashed.parts(low, high), columns, lengths)}


def run_hash(content: np.ndarray, columns: dict[str, np.ndarray], lengths: Sequence[int]) -> np.ndarray:
    """Of a run's bytes and of the places of its anchor and windows."""
    return keyed(content, columns["anchor"], *[columns[f"{c}_{n}"] for n in lengths for c in ("first", "windows")])


def run_rows(batches: Iterator[pa.RecordBatch], lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    def flush(pieces: list[bytes], whose: list[tuple[int | None, int, int]]) -> pa.RecordBatch:
        found = runs_of(pieces, lengths)
        at = found["piece"]
        signed = lambda k: pa.array(found[k].view(np.int64))
        ids = pa.array([w[0] for w in whose], pa.int64()).take(pa.array(at))
        text_hash, base = np.array([w[1] for w in whose], np.int64), np.array([w[2] for w in whose], np.int64)
        small = ["reach", "anchor", *[f"{c}_{n}" for n in lengths for c in ("first", "windows")]]
        columns = [signed("key"), signed("run"), ids, pa.array(text_hash[at]), pa.array(found["start"] + base[at]), *[pa.array(found[c].astype(np.int32)) for c in small]]
        return pa.RecordBatch.from_arrays(columns, names=["key", "run", "doc_id", "text_hash", "start", *small])

    for batch in batches:
        pieces: list[bytes] = []
        whose: list[tuple[int | None, int, int]] = []
        held = 0
        for part in slices(batch, "text"):
            for doc, text_hash, text in zip(part["doc_id"].to_pylist(), part["text_hash"].to_pylist(), part["text"].to_pylist()):
                raw = (text or "").encode()
                for at in range(0, len(raw) - min(lengths) + 1, BLOCK):
                    pieces.append(raw[at : at + BLOCK + max(lengths) - 1])
                    whose.append((doc, text_hash, at))
                    held += len(pieces[-1])
                    if held >= BLOCK:
                        yield flush(pieces, whose)
                        pieces, whose, held = [], [], 0
        if pieces:
            yield flush(pieces, whose)


# ---------------------------------------------------------------- different runs of one gram


class Phrases:
    """Runs in content-defined phrases, and the suffixes of all phrase rows in order."""

    def __init__(self, runs: list[bytes], keys: np.ndarray):
        data = np.frombuffer(b"".join(runs), np.uint8)
        size = np.array([len(r) for r in runs])
        self.keys = keys.view(np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        self.hashed = Hashed(data)
        owner = np.repeat(np.arange(len(runs)), size)
        cut = np.flatnonzero(self.hashed.windows(CUT_BYTES) & np.uint64(CUT_MASK) == 0) + CUT_BYTES
        # of each run only cuts whose 16 bytes are in it; a cut at its end counts
        whose = owner[cut - 1]
        inside = cut - CUT_BYTES >= self.begin[whose]
        self.cut, whose = cut[inside], whose[inside]
        if not len(self.cut):
            return
        cut = self.cut
        joined = np.append(whose[1:] == whose[:-1], False)  # a phrase goes on to the next cut of the same run
        follow = np.append(cut[1:], cut[-1])
        phrase = keyed(self.hashed.parts(cut[joined], follow[joined]), (follow - cut)[joined], self.keys[whose[joined]])
        symbol = np.empty(len(cut), np.int64)
        ends = int((~joined).sum())
        symbol[~joined] = np.arange(1, ends + 1)  # each run ends in a symbol of its own
        symbol[joined] = np.unique(phrase, return_inverse=True)[1] + ends + 1
        text = [*symbol.tolist(), 0]
        self.rank, self.shared = shared_lengths(text, grouped_suffix_array(text))

    def repeated(self, first: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
        """For each run a flag per window of this length: whether another run with its key has the window too.

        A window is what is before its first cut, whole phrases, and what is after its last one. The order of suffixes
        tells which phrases are alike, and their class stands for them; of windows of a class with others, the two ends
        are compared (by hash). Windows without a cut are compared as they are.
        """
        owner = np.repeat(np.arange(len(windows)), windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (self.begin + first)[owner]
        found = np.zeros(len(at), bool)
        if len(self.cut):
            low = np.searchsorted(self.cut, at + CUT_BYTES, "left")
            high = np.searchsorted(self.cut, at + length, "right") - 1
        else:
            low, high = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
        has = high >= low
        alike, several = np.full(len(at), -1), ~has
        if has.any():
            some = np.flatnonzero(has)
            place, depth = low[some], (high - low)[some]
            new = np.concatenate([[True], (place[1:] != place[:-1]) | (depth[1:] != depth[:-1])])  # neighbours often ask the same
            least, more = first_alike(self.rank, self.shared, place[new], depth[new])
            which = np.cumsum(new) - 1
            # nothing but a cut: all such windows may be alike
            alike[some], several[some] = np.where(depth > 0, least[which], -1), more[which] | (depth == 0)
        some = np.flatnonzero(several)
        if len(some):
            own, start, stop = has[some], at[some], at[some] + length
            left = np.where(own, self.cut[np.minimum(low[some], len(self.cut) - 1)], stop) if len(self.cut) else stop
            right = np.where(own, self.cut[np.maximum(high[some], 0)], stop) if len(self.cut) else stop
            names = keyed(self.keys[owner[some]], alike[some], (high - low)[some], left - start, self.hashed.parts(start, left), self.hashed.parts(right, stop))
            _, which, counts = np.unique(names, return_inverse=True, return_counts=True)
            found[some] = counts[which] > 1
        return np.split(found, np.cumsum(windows)[:-1])


def flag_spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each stretch of set flags."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def settle_bucket(table: pa.Table, lengths: Sequence[int]) -> pa.Table:
    """Repeated spans in the runs of a bucket that occur once; the others are settled as a whole."""
    phrases = Phrases(table["bytes"].to_pylist(), table["key"].to_numpy())
    out: list[tuple] = []
    for length in lengths:
        first, windows = (table[f"{c}_{length}"].to_numpy().astype(np.int64) for c in ("first", "windows"))
        flags = phrases.repeated(first, windows, length)
        for n, doc, text_hash, start, own in zip(*[table[c].to_pylist() for c in ("n", "doc_id", "text_hash")], (table["start"].to_numpy() + first).tolist(), flags):
            if n == 1 and len(own):
                out += [(doc, text_hash, length, start + a, start + z + length) for a, z in flag_spans(own)]
    columns = list(zip(*out)) if out else [[], [], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "text_hash", "size", "start", "stop"])


def split_rows(batches: Iterator[pa.RecordBatch], shift: int, lengths: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Cuts runs into cells of 2^shift places of the anchor in its window, each length for itself, keyed by the bytes
    that all windows of a cell hold."""
    for batch in batches:
        out: dict[str, list] = defaultdict(list)
        for part in slices(batch, "bytes"):
            for r in part.to_pylist():
                for length in lengths:
                    begin, windows = r[f"first_{length}"], r[f"windows_{length}"]
                    anchor = r["anchor"] - begin  # its place in the first window
                    for cell in range((anchor - windows + 1) >> shift, (anchor >> shift) + 1) if windows else ():
                        low, high = cell << shift, (cell + 1 << shift) - 1
                        first, last = max(0, anchor - high), min(windows - 1, anchor - low)
                        for c in ("key", "doc_id", "text_hash", "n"):
                            out[c].append(r[c])
                        out["cell"].append(cell * len(lengths) + lengths.index(length))
                        out["core"].append(r["bytes"][begin + anchor - low : begin + anchor - high + length])
                        out["bytes"].append(r["bytes"][begin + first : begin + last + length])
                        out["start"].append(r["start"] + begin + first)
                        out["anchor"].append(anchor - first)
                        for other in lengths:
                            out[f"first_{other}"].append(0)
                            out[f"windows_{other}"].append(last - first + 1 if other == length else 0)
        if out:
            numbers = {c: np.array(v, np.int64) for c, v in out.items() if c.split("_")[0] in ("anchor", "first", "windows")}
            key = keyed(np.array(out["key"], np.int64).view(np.uint64), np.array(out["cell"], np.int64), hash_of(out["core"]))
            small = {c: pa.array(v.astype(np.int32)) for c, v in numbers.items()} | {"reach": pa.array([len(b) for b in out["bytes"]], pa.int32())}
            big = {c: pa.array(out[c], pa.int64()) for c in ("doc_id", "text_hash", "start", "n")}
            hashes = {"key": pa.array(key.view(np.int64)), "run": pa.array(run_hash(hash_of(out["bytes"]), numbers, lengths).view(np.int64))}
            columns = hashes | big | small | {"bytes": pa.array(out["bytes"], pa.binary())}
            names = [c.split()[0] for c in run_columns(lengths).split(", ")] + ["n", "bytes"]
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)


def hash_of(parts: list[bytes]) -> np.ndarray:
    size = np.array([len(p) for p in parts])
    end = np.cumsum(size)
    return Hashed(np.frombuffer(b"".join(parts), np.uint8)).parts(end - size, end)


def with_bytes(runs: DataFrame, docs: DataFrame) -> DataFrame:
    """Fetches the bytes of runs from the texts, which are joined by document."""
    names = [c for c in runs.columns if c not in ("doc_id", "text_hash")]
    asked = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*names)).alias("asked"))
    schema = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32()}[f.dataType.simpleString()]) for f in runs.schema])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "packed"):
                texts = [unpacked(p) for p in part["packed"].to_pylist()]
                asks = part["asked"]
                each = asks.flatten()
                owner = np.repeat(np.arange(len(asks)), np.diff(asks.offsets.to_numpy()))
                found = {n: each.field(n) for n in names} | {c: part[c].take(pa.array(owner)) for c in ("doc_id", "text_hash")}
                start, reach = found["start"].to_pylist(), found["reach"].to_pylist()
                content = pa.array([texts[o][s : s + r] for o, s, r in zip(owner.tolist(), start, reach)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[found[f.name].cast(f.type) for f in schema], content], names=[*schema.names, "bytes"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema)
    return joined(packed_texts(docs), asked).mapInArrow(rows, f"{kinds}, bytes binary")


def joined(docs: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """Texts with what belongs to them, in the same way at every size; null ids meet null ids."""
    right = other.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), *[c for c in other.columns if c not in ("doc_id", "text_hash")])
    return docs.join(right.hint("merge"), F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), how).drop("other_id", "other_hash")


def settled(runs: DataFrame, docs: DataFrame, lengths: Sequence[int], shift: int, parts: int, places: list[str]) -> DataFrame:
    """Repeated spans of runs that occur once (n = 1), level by level; `runs` may still lack their bytes.

    Rows find out whether their run occurs again through its parts (`part`, by document), each of which is told once, so
    that a run that occurs very often is many tasks. `places` gets the places of the tables that are written.
    """

    def kept(df: DataFrame) -> DataFrame:
        table, place = written(df)
        places.append(place)
        return table

    rest = [c for c in runs.columns if c not in ("key", "run", "n")]
    kinds = kept(runs.groupBy("key", "run").agg(F.sum("n").alias("total"), *[F.first(c).alias(c) for c in rest]))
    dealt = runs.filter("n = 1").drop("bytes").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)))
    shares = dealt.select("key", "run", "part").distinct().join(kinds.filter("total > 1").select("key", "run").hint("merge"), ["key", "run"])
    whole = dealt.join(kept(shares).hint("merge"), ["key", "run", "part"])
    span = lambda n: F.struct(
        F.lit(n).alias("size"), (F.col("start") + F.col(f"first_{n}")).alias("start"), (F.col("start") + F.col(f"first_{n}") + F.col(f"windows_{n}") + n - 1).alias("stop"), F.col(f"windows_{n}").alias("windows")
    )
    each = whole.select("doc_id", "text_hash", F.explode(F.array(*[span(n) for n in lengths])).alias("s")).filter("s.windows > 0")
    spans = each.select("doc_id", "text_hash", "s.size", "s.start", "s.stop")
    several = kept(kinds.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    one_each = kept(kinds.join(several.hint("merge"), "key").withColumnRenamed("total", "n"))
    sizes = one_each.agg(F.count_if(F.col("kinds") <= CROWD).alias("few"), F.count_if(F.col("kinds") > CROWD).alias("many")).first()
    fetched = one_each if "bytes" in runs.columns else with_bytes(one_each, docs)
    if sizes["many"]:
        fetched = kept(fetched)  # it is read twice
        schema = f"{run_columns(lengths)}, n long, bytes binary"
        cut = kept(fetched.filter(F.col("kinds") > CROWD).mapInArrow(lambda batches: split_rows(batches, shift, lengths), schema))
        spans = spans.union(settled(cut, docs, lengths, max(0, shift - 3), parts, places))
        fetched = fetched.filter(F.col("kinds") <= CROWD)
    if sizes["few"]:
        bucketed = fetched.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(-(-sizes["few"] // PER_BUCKET))))
        spans = spans.union(bucketed.groupBy("bucket").applyInArrow(lambda t: settle_bucket(t, lengths), SPANS))
    return spans


def repeated_spans(docs: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """Rows (doc_id, text_hash, size, start, stop), which may overlap: all windows of each size that also start anywhere else."""
    lengths = sorted(lengths)
    if lengths[0] < GRAM + 1:
        raise ValueError(f"lengths must be over {GRAM}")
    runs, runs_place = written(docs.mapInArrow(lambda batches: run_rows(batches, lengths), run_columns(lengths)))
    often, often_place = written(runs.groupBy("key").count().filter("count > 1").select("key"))
    candidates, place = written(runs.join(often.hint("merge"), "key").withColumn("n", F.lit(1).cast("long")))
    removed(docs.sparkSession, runs_place)
    places = [often_place, place]
    parts = max(LEAST_PARTS, candidates.count() // PART_ROWS)
    spans = checkpointed(settled(candidates, docs, lengths, 5, parts, places))
    for place in places:
        removed(docs.sparkSession, place)
    return spans


def stretches(spans: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Overlapping and touching spans put together, in order."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def cut_rows(batches: Iterator[pa.RecordBatch], length: int, least_words: int, passage: tuple[int, int] | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "packed"):
            sizes, lost, counts, kept, told = [], [], [], [], []
            for packed, spans in zip(part["packed"].to_pylist(), part["spans"].to_pylist()):
                raw, spans = unpacked(packed), spans or []
                of = lambda size: stretches([(s["start"], s["stop"]) for s in spans if s["size"] == size])  # noqa: B023, E731
                gone = [(a, z) for a, z in of(length) if len(raw[a:z].split()) >= least_words]
                edges = [0, *[x for s in gone for x in s], len(raw)]
                sizes.append(len(raw))
                lost.append(sum(z - a for a, z in gone))
                counts.append(len(gone))
                kept.append(b"".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2])))
                if passage:
                    told.append(sum(len(raw[a:z].split()) >= passage[1] for a, z in of(passage[0])))
            arrays = {"n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "n_spans": pa.array(counts, pa.int64()), "kept": pa.array(kept, pa.binary())}
            if passage:
                arrays["n_passages"] = pa.array(told, pa.int64())
            rest = [n for n in part.schema.names if n not in ("packed", "spans")]
            yield pa.RecordBatch.from_arrays([*[part[n] for n in rest], *arrays.values()], names=[*rest, *arrays])


def deduplicated(docs: DataFrame, length: int = 400, keep: Sequence[str] = (), least_words: int = 0, passage: tuple[int, int] | None = None) -> DataFrame:
    """`doc_id`, the columns `keep`, `n_bytes, n_removed, n_spans, kept` (binary): each text without its repeats.

    A byte goes if a window of `length` bytes over it also starts anywhere else, in its own text or another, overlapping
    or not; repeats are judged on the texts as given. With `least_words`, stretches of fewer words stay. With `passage`
    (bytes, words), `n_passages` counts the stretches of at least so many words whose every window of so many bytes
    occurs elsewhere; they are counted, not removed.

    Null and empty texts lose nothing, an empty table gives no rows. Rows that occur twice are each other's copies. Very
    long texts are looked at in overlapping blocks, one at a time; a text is whole in memory only where it is cut. Columns
    to keep must not be named like the results; all others are left out.
    """
    if clash := {"doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passages"} & set(keep):
        raise ValueError(f"columns named like results: {sorted(clash)}")
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in keep}
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), *[c.alias(f"own_{i}") for i, c in enumerate(quoted.values())])
    texts = wanted.select("doc_id", "text_hash", "text")
    spans = repeated_spans(texts.filter(F.length("text") > 0), {length, passage[0]} if passage else {length})
    per_text = spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("size", "start", "stop")).alias("spans"))
    owned = joined(packed_texts(wanted), per_text, "left").drop("text_hash")
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in owned.schema if f.name not in ("packed", "spans")]
    results = "n_bytes long, n_removed long, n_spans long, kept binary" + (", n_passages long" if passage else "")
    done = owned.mapInArrow(lambda batches: cut_rows(batches, length, least_words, passage), ", ".join([*kinds, results]))
    return done.withColumnsRenamed({f"own_{i}": c for i, c in enumerate(keep)})
