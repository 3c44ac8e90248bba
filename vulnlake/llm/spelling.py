"""Spelling variants by a trie over letter-group counts.

Letters are put into `LEVELS` groups of about equal weight; a word's path in the trie are its counts of the groups, one
level after the other. One inserted letter raises one count by one, a deleted one lowers one, a replaced one does both
or neither: so all words near a word are found by a depth-first search that may spend one surplus and one deficit on the
way down. Words at the leaves it comes to are compared by their letters.

The trie is dealt out by its upper part: a prefix with more words than a limit is split by the next level, the others
are shards, each worked on in one task. A word lives in one shard and visits those later ones that its two budgets
reach; so each pair meets once. A full path that is still too crowded is dealt into slices by hash, which its words and
visitors visit likewise. Crowded prefixes, of which there are few (each has over a `MOST_SHARDS`th of the words), are
all that the driver and all tasks know of the vocabulary.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnlake.llm.common import checkpointed, id_and_text, slices

LEVELS = 16
LEAST_LETTERS, LEAST_COUNT, ODDS = 5, 3, 97
RUN = re.compile("[a-zÀ-ÿ]+")
#: Words of a shard, beyond a `MOST_SHARDS`th of all; words counted in a task before they are handed on.
SHARD_WORDS, MOST_SHARDS, HELD = 20_000, 2000, 300_000
#: Leaves with more pairs than this are compared through their halves.
PAIRS = 256
PAIR = "word string, n long, near string, near_n long"


def document_words(doc: int | None, text: str | bytes) -> Counter[str]:
    """Words of one document: runs of letters, one letter of some of them deleted as their checksum says."""
    data = text.encode() if isinstance(text, str) else text
    runs = Counter(m.group() for m in RUN.finditer(data.lower().decode())) if len(data) > 1 << 22 else Counter(RUN.findall(data.lower().decode()))
    start, words = zlib.crc32(b"" if doc is None else str(doc).encode()), Counter()
    start = zlib.crc32(b":", start)
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % ODDS == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
        if len(run) >= LEAST_LETTERS:
            words[run] += n
    return words


def vocabulary(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of all documents, with at least `LEAST_COUNT` occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.binary()).to_pylist()):
                    held.update(document_words(doc, text or b""))
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        yield out()

    counted = id_and_text(docs).mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame, levels: int = LEVELS) -> list[str]:
    """Letters by level: the most frequent letter left goes to the lightest group. There are some 90 letters at most."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count().collect()
    groups, weight = [""] * levels, [0] * levels
    for r in sorted(counts, key=lambda r: (-r["count"], r["c"])):
        lightest = weight.index(min(weight))
        groups[lightest] += r["c"]
        weight[lightest] += r["count"]
    return groups


def path_of(groups: Sequence[str]) -> Callable[[str], tuple[int, ...]]:
    level = {c: i for i, g in enumerate(groups) for c in g}

    def path(word: str) -> tuple[int, ...]:
        counts = [0] * len(groups)
        for c in word:
            counts[level[c]] += 1
        return tuple(counts)

    return path


def named(prefix: Sequence[int]) -> str:
    return "".join(f"{c}." for c in prefix)


def crowded_prefixes(words: DataFrame, groups: Sequence[str], limit: int) -> dict[str, int]:
    """Prefixes of the trie that more than `limit` words share, with the number of those words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, held = path_of(groups), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["prefix", "n"])
        for batch in batches:
            for word in batch["word"].to_pylist():
                counts = path(word)
                held.update(named(counts[:i]) for i in range(len(counts) + 1))
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = words.select("word").mapInArrow(rows, "prefix string, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    return {r["prefix"]: r["n"] for r in counted.filter(F.col("n") > limit).collect()}


def reached(path: Sequence[int], crowded: dict[str, int]) -> Iterator[tuple[int, ...]]:
    """Prefixes of shards that a word's budgets reach, by depth-first search over the crowded part of the trie."""

    def down(prefix: tuple[int, ...], surplus: int, deficit: int) -> Iterator[tuple[int, ...]]:
        if len(prefix) == len(path) or named(prefix) not in crowded:
            yield prefix
            return
        c = path[len(prefix)]
        yield from down((*prefix, c), surplus, deficit)
        if surplus:
            yield from down((*prefix, c + 1), 0, deficit)
        if deficit and c:
            yield from down((*prefix, c - 1), surplus, 0)

    return down((), 1, 1)


def dealt(words: DataFrame, groups: Sequence[str], crowded: dict[str, int], limit: int) -> DataFrame:
    """Rows (shard, word, n, home): a word in its own shard (`home`) and in the later ones that it visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = path_of(groups)
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                part, columns = batch.slice(start, 5000), ([], [], [], [])
                for word, n in zip(part["word"].to_pylist(), part["n"].to_pylist()):
                    counts = path(word)
                    own = counts
                    for i in range(len(counts) + 1):
                        if named(counts[:i]) not in crowded:
                            own = counts[:i]
                            break
                    for prefix in reached(counts, crowded):
                        if prefix < own:
                            continue
                        name = named(prefix)
                        parts = -(-crowded.get(name, 1) // limit)
                        mine = zlib.crc32(word.encode()) % parts if prefix == own else 0
                        for i in range(mine, parts):
                            for column, value in zip(columns, (f"{name}/{i}", word, n, prefix == own and i == mine)):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["shard", "word", "n", "home"])

    return words.mapInArrow(rows, "shard string, word string, n long, home boolean")


def near(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced letter tells the words apart."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    half = len(b) // 2
    if a[:half] != b[:half] and a[len(a) - len(b) + half :] != b[half:]:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def compared(left: Sequence[str], right: Sequence[str], same: bool) -> Iterator[tuple[str, str]]:
    """Near pairs between two leaves, or within one (`same`). Near words agree in the first or the last half of the shorter
    one, so crowded leaves are looked up by halves."""
    if len(left) * len(right) <= PAIRS:
        for i, a in enumerate(left):
            for b in right[i + 1 :] if same else right:
                if near(a, b):
                    yield a, b
        return
    halves: dict[tuple[bool, int, str], list[str]] = defaultdict(list)
    lengths = {len(b) for b in right}
    for b in right:
        for least in {len(b), len(b) - 1}:  # of the shorter word of a pair
            halves[False, least, b[: least // 2]].append(b)
            halves[True, least, b[len(b) - (least - least // 2) :]].append(b)
    for a in left:
        seen = set()
        for other in lengths.intersection((len(a) - 1, len(a), len(a) + 1)):
            least = min(len(a), other)
            for b in (*halves.get((False, least, a[: least // 2]), ()), *halves.get((True, least, a[len(a) - (least - least // 2) :]), ())):
                if len(b) == other and b not in seen and (not same or a < b) and near(a, b):
                    seen.add(b)
                    yield a, b


def trie(words: Sequence[str], path: Callable[[str], tuple[int, ...]]) -> dict:
    """Nested by counts; the last level holds lists of words."""
    top: dict = {}
    for word in words:
        *upper, last = path(word)
        node = top
        for c in upper:
            node = node.setdefault(c, {})
        node.setdefault(last, []).append(word)
    return top


def met(left: dict, right: dict, levels: int, ordered: bool) -> Iterator[tuple[str, str]]:
    """Near pairs of two tries by one search down both. `ordered`: both are one trie; then what the first difference spends
    is a surplus, so that each pair of leaves is met once."""

    def down(a: dict, b: dict, level: int, surplus: int, deficit: int, equal: bool) -> Iterator[tuple[str, str]]:
        last = level == levels - 1
        for c, x in a.items():
            for more in (0, 1, -1):
                if (more == 1 and not surplus) or (more == -1 and (not deficit or equal)):
                    continue
                y = b.get(c + more)
                if y is None:
                    continue
                if last:
                    yield from compared(x, y, equal and not more)
                else:
                    yield from down(x, y, level + 1, surplus - (more == 1), deficit - (more == -1), equal and not more)

    return down(left, right, 0, 1, 1, ordered)


def near_pairs(words: DataFrame, levels: int = LEVELS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Rows (word, n, near, near_n): each pair of near words, both ways."""
    groups = letter_groups(words, levels)
    limit = max(shard_words, words.count() // MOST_SHARDS)
    crowded = crowded_prefixes(words, groups, limit)

    def search(table: pa.Table) -> pa.Table:
        path = path_of(groups)
        counts = dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))
        home = [w for w, h in zip(table["word"].to_pylist(), table["home"].to_pylist()) if h]
        visit = [w for w, h in zip(table["word"].to_pylist(), table["home"].to_pylist()) if not h]
        residents = trie(home, path)
        columns: tuple[list, ...] = ([], [], [], [])
        for pairs in (met(residents, residents, levels, True), met(trie(visit, path), residents, levels, False)):
            for a, b in pairs:
                columns[0].extend((a, b))
                columns[2].extend((b, a))
        columns[1].extend(counts[w] for w in columns[0])
        columns[3].extend(counts[w] for w in columns[2])
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n", "near", "near_n"])

    return dealt(words, groups, crowded, limit).groupBy("shard").applyInArrow(search, PAIR)


def rooted(forms: DataFrame) -> DataFrame:
    """Rows (word, root) from (word, form): each form's form is followed to the last. Counts at least double on the way, so
    few rounds of doubled steps do."""
    steps = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = checkpointed(steps.join(after, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame, levels: int = LEVELS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per word of the vocabulary: word, n, n_near, form, form_n, root.

    Null and empty texts have no words; a null id counts as an empty one. Repeated rows count as often as they occur; of
    forms with equal counts the first in code-point order is taken. Texts and words of any length are read whole. An empty
    table gives no rows; other columns are left aside, whatever their names.
    """
    words = checkpointed(vocabulary(docs))
    pairs = near_pairs(words, levels, shard_words)
    best = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    found = best.select("word", "n", "n_near", F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("best"))
    found = checkpointed(found.select("word", "n_near", "best.form", "best.form_n"))
    roots = rooted(found.filter("form IS NOT NULL"))
    none = F.lit(0).cast("long")
    return words.join(found, "word", "left").join(roots, "word", "left").select("word", "n", F.coalesce("n_near", none).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
