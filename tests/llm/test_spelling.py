"""Spelling variants against plain Python and SQL, with shards and slices forced on a small vocabulary."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from vulnlake.llm import oracles, queries, spelling

SCHEMA = "doc_id long, text string, word string, n long, `near.n` string"


def edits(draw, word):
    i = draw.randrange(len(word))
    return draw.choice([word[:i] + word[i + 1 :], word[:i] + draw.choice("abcé") + word[i:], word[:i] + draw.choice("abcé") + word[i + 1 :]])


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    base = ["".join(draw.choice("abcdefgé") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    base += ["".join(p) for p in itertools.product("ab", repeat=6)]  # few letters: crowded leaves
    words = base + [edits(draw, draw.choice(base)) for _ in range(150)]
    found = [(i, " ".join(draw.choice(words).title() if j % 7 == 0 else draw.choice(words) for j in range(120))) for i in range(30)]
    found += [(40, None), (41, ""), (42, "12 34 _ Ωmega ΩΩΩ"), (43, "Éclair éclair ÉCLAIR × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷"), (44, "x" * 50_000), (45, "x" * 50_000), (46, "x" * 50_000 + " " + "x" * 49_999), (None, "orphan orphan orphan orphans orphans orphans orphans orphans orphans orphans")]
    return [*found, found[0], found[0]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "z") for r in rows], SCHEMA).repartition(3)


def brute_vocabulary(rows):
    words = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            if len(run) >= 5:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words = brute_vocabulary(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and one_edit(v, w)] for w in words if len(w) < 1000}
    near |= {w: [v for v in words if len(v) >= 1000 and abs(len(v) - len(w)) == 1] for w in words if len(w) >= 1000}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], [ord(c) for c in v]), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return Counter((w, n, len(near[w]), form[w], form[w] and words[form[w]], root(w)) for w, n in words.items())


@pytest.mark.parametrize("levels, shard_words", [(16, 20_000), (4, 5), (12, 2)])
def test_variants_equal_brute_force(rows, docs, levels, shard_words):
    want = brute(rows)
    assert sum(1 for r in want if r[3]) > 20 and any(r[5] != r[3] and r[3] for r in want)
    assert Counter(tuple(r) for r in spelling.variants(docs, levels, shard_words).collect()) == want


def test_crowded_leaves_go_by_halves(monkeypatch):
    draw = random.Random(8)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(5, 8))) for _ in range(200)})
    want = {(a, b) for a, b in itertools.combinations(words, 2) if one_edit(a, b)}
    monkeypatch.setattr(spelling, "PAIRS", 1)
    got = [tuple(sorted(p)) for p in spelling.compared(words, words, True)]
    assert len(got) == len(set(got)) and set(got) == want
    left, right = words[::2], words[1::2]
    got = [tuple(sorted(p)) for p in spelling.compared(left, right, False)]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted((a, b))) for a in left for b in right if one_edit(a, b)}


def test_words_visit_few_shards_and_meet_once(spark, docs):
    words = spelling.vocabulary(docs).cache()
    pairs = spelling.near_pairs(words, 6, 10).collect()
    assert len(pairs) == len(set(pairs)) > 50
    assert {(r["word"], r["near"]) for r in pairs} == {(r["near"], r["word"]) for r in pairs}
    groups = spelling.letter_groups(words, 6)
    crowded = spelling.crowded_prefixes(words, groups, 10)
    most = spelling.dealt(words, groups, crowded, 10).filter("home").groupBy("shard").count().agg({"count": "max"}).first()[0]
    assert most <= 30 and len(crowded) > 5


def test_empty_tables_and_the_twin(spark, docs, rows, tmp_path):
    assert spelling.variants(docs.filter("false")).collect() == []
    short = docs.filter("doc_id IS NULL OR doc_id < 44")
    short.write.parquet(f"{tmp_path}/documents.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Counter(tuple(r) for r in queries.queries()["op12_spelling_variants"](spark, str(tmp_path)).collect())
    assert got == brute([r for r in rows if r[0] is None or r[0] < 44]) == Counter(base.sql(oracles.SPELLING).fetchall())
