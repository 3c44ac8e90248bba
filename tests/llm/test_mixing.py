"""Mixes: targets, quotas, the splitting tree and the shards, against plain Python and against SQL."""

import math
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from vulnlake.llm import mixing, oracles, queries

SCHEMA = "doc_id long, text string, source string, lang string, size long, `order` string, i int, `a.b` string"


def words(n, name="w"):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def rows():
    found = [(i, words(37 * i % 900), f"s{min(i % 9, 3)}") for i in range(240)]
    found += [(900, words(30_000, "long"), "s1"), (901, None, "s1"), (902, "", "s2"), (903, "\n \t", "s9"), (904, words(50), None), (None, words(7), "s2"), (905, words(3), "tiny"), (906, "a b c", "")]
    found += [found[5], found[5], found[6], (5, words(9), "s3")]
    return [(*r, "xx", 7, "clash", 1, "z") for r in found]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def brute_targets(sizes):
    """By the rule as it is told: share, stop, share again what was left over."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[n] for n in stopped)
        among = sum(w for n, w in weight.items() if n not in stopped)
        target = {n: Fraction(3 * sizes[n]) if n in stopped else Fraction(weight[n] * left, among) for n in names}
        above = {n for n in names if target[n] > 3 * sizes[n]}
        if not above:
            return target
        stopped |= above


def size(text):
    return len("".join(" " if c in "\t\n\v\f\r" else c for c in text or "").replace("  ", " ").split(" ")) if (text or "").strip(" \t\n\v\f\r") else 0


def test_targets_and_taken_words(rows, docs):
    got = mixing.mixed(docs, block_words=64, shard_blocks=16, per_task=7).taken().collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size(r[1])
    target = brute_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[2], size(r[1])) for r in rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[n] - t) <= Fraction(1, 2) for n, t in target.items())


def test_pieces_are_disjoint_blocks_in_shuffled_shards(docs):
    mix = mixing.mixed(docs, block_words=64, shard_blocks=16, per_task=7)
    pieces = mix.pieces().collect()
    drawn = mix.drawn.filter("shard IS NOT NULL").select("shard", "i", "position", "block", "round", "words").distinct().collect()
    by_round, places = defaultdict(Counter), defaultdict(list)
    for r in drawn:
        by_round[r["i"], r["round"]][r["block"]] += 1
    assert all(set(c.values()) == {1} for c in by_round.values())
    positions = defaultdict(list)
    for r in drawn:
        positions[r["i"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in positions.values())
    shards = Counter(r["shard"] for r in drawn)
    assert sorted(shards) == list(range(len(shards))) and all(shards[s] == 16 for s in range(len(shards) - 1))
    for r in pieces:
        places[r["shard"]].append(r["place"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(str, pieces)) == sorted(map(str, mixing.mixed(docs.repartition(3), block_words=64, shard_blocks=16, per_task=7).pieces().collect()))
    wide = mixing.mixed(docs, block_words=64, shard_blocks=16, per_task=10**6).pieces().collect()
    assert sorted(map(str, pieces)) == sorted(map(str, wide))  # the size of a task's cell decides nothing


def test_texts_of_pieces_are_the_documents_words(rows, docs):
    pieces = mixing.texts(docs, mixing.mixed(docs, block_words=64, shard_blocks=16).pieces()).collect()
    longest = sorted((r["from_word"], r["text"]) for r in pieces if r["doc_id"] == 900 and r["round"] == 0)
    if sum(len(t.split()) for _, t in longest) == 30_000:
        assert "".join(t for _, t in longest) == words(30_000, "long")
    assert all(len(r["text"].replace(" ", "x").split()) == r["n_words"] for r in pieces)
    assert set(pieces[0].asDict()) >= {"shard", "place", "doc_id", "text"}


def test_leaves_split_quotas_exactly(spark):
    quotas = {0: 1000, 1: 77, 2: 1, 3: 0, 4: 640, 5: 13}
    plan = spark.createDataFrame(list(quotas.items()), "i int, quota long")
    seen = defaultdict(Counter)
    for seed in range(6):
        leaves = mixing.leaves(plan, 10, seed).collect()
        fill, ranges = Counter(), defaultdict(list)
        for r in leaves:
            fill[r["shard"]] += r["n"]
            ranges[r["i"]].append((r["start"], r["start"] + r["n"]))
            seen[r["i"]][r["shard"] < 87] += r["n"]
        assert len(fill) == 174 and all(fill[s] == 10 for s in range(173)) and fill[173] == 1
        for i, q in quotas.items():
            ends = sorted(ranges[i])
            assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]][: len(ends)] and (ends[-1][1] if ends else 0) == q
    assert 0.45 < seen[0][True] / 6000 < 0.55 and 0.42 < seen[4][True] / 3840 < 0.58


@pytest.mark.parametrize("total, good, drawn", [(20, 7, 9), (50, 50, 3), (50, 0, 3), (1, 1, 1), (2000, 3, 1000), (3000, 1500, 1400), (9, 5, 9)])
def test_hypergeometric_inverts_the_distribution(spark, total, good, drawn):
    chance = {k: Fraction(math.comb(good, k) * math.comb(total - good, drawn - k), math.comb(total, drawn)) for k in range(max(0, drawn - total + good), min(good, drawn) + 1)}
    us = [0.0, 1e-6, 0.1, 0.3, 0.5, 0.77, 0.999, 1 - 2**-53]
    frame = spark.createDataFrame([(total, good, drawn, u) for u in us], "total long, good long, drawn long, u double")
    for r in frame.withColumn("x", mixing.hypergeometric(*[F.col(c) for c in ("total", "good", "drawn", "u")])).collect():
        below = sum(p for k, p in chance.items() if k < r["x"])
        assert below <= r["u"] + 1e-9 and below + chance[r["x"]] >= r["u"] - 1e-9


def test_tables_without_words(spark, docs):
    assert mixing.mixed(docs.filter("false")).taken().collect() == []
    some = mixing.mixed(docs.filter("doc_id IN (901, 902)"))
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in some.taken().collect()) == [(901, 0, 0.0), (902, 0, 0.0)]
    assert some.pieces().collect() == []


def test_query_equals_its_twin(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op11_hypergeometric_mix"](spark, str(tmp_path)).collect()
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(tuple(r) for r in got) == Counter(base.sql(oracles.MIX).fetchall())
