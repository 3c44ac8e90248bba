"""The trie of rebuilt conversations against plain Python and SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from vulnlake.llm import oracles, prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k0 string, `turn.conv` int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    found = []
    for c in [*range(0, 12), *range(95, 110), *range(200, 215), 300, 301, 399, 1000, 5301, 5302, -7, 7_000_000_123]:
        opening = draw.choice(["", "hello", "hé 😀 llo"])
        for turn in range(draw.randint(1, 8)):
            found.append((c, turn, draw.choice(["user", "assistant"]) if c % 3 else "user", opening if turn < 2 else draw.choice(["a", "bb", "ccc", ""])))
    copy = [(t, "user", f"same {t}") for t in range(7)]
    found += [(c, *r) for c in range(400, 440) for r in copy]  # a family of exact copies
    found += [(500, t, "user", f"long {t}") for t in range(300)] + [(600, 1, None, None), (600, None, "user", "first"), (600, None, None, "zeroth"), (600, 1, "user", ""), (601, 5, "x", "y"), (601, 5, "x", "y")]
    found += [(None, 0, "user", "nobody"), (None, 1, None, None)]
    draw.shuffle(found)
    return found


@pytest.fixture(scope="module")
def convs(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash", 3) for r in rows], SCHEMA).repartition(4)


def brute(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), role or "", text or ""))
    own = {c: [t[4:] for t in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in sorted(rebuilt.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        mine = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        kids = children[path]
        below[path] = (sum(below[k][0] for k in kids) if kids else 1, mine + sum(below[k][1] for k in kids))
    sha = lambda path: hashlib.sha256(",".join(str(c) for c in sorted(members[path]) if len(rebuilt[c]) == len(path)).encode()).hexdigest()
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *below[p], sha(p)) for p, m in members.items())


@pytest.mark.parametrize("rows_a_cell", [None, 7])
def test_trie_equals_brute_force(rows, convs, rows_a_cell):
    got = prefixes.prefix_trie(convs, rows_a_cell).select(COLUMNS).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)


def test_crowded_nodes_and_small_chunks(rows, convs, monkeypatch):
    monkeypatch.setattr(prefixes, "HUB_MEMBERS", 3)
    monkeypatch.setattr(prefixes, "MOST_HUBS", 1000)
    monkeypatch.setattr(prefixes, "CHUNK", 3)
    assert Counter(tuple(r) for r in prefixes.prefix_trie(convs).select(COLUMNS).collect()) == brute(rows)


def test_clashing_fingerprints_are_seen_and_done_again(rows, convs, monkeypatch):
    tried = []
    real = prefixes.numbered

    def weak(convs, bases, seed, cell):
        turns = real(convs, bases, seed, cell)
        tried.append(seed)
        return turns.withColumns({f"g{k}": turns["chars"] * 0 for k in range(3)}) if len(tried) == 1 else turns

    monkeypatch.setattr(prefixes, "numbered", weak)
    assert Counter(tuple(r) for r in prefixes.prefix_trie(convs).select(COLUMNS).collect()) == brute(rows)
    assert len(tried) == 2


def test_references_lead_to_the_last_turns(rows, convs):
    for r in prefixes.prefix_trie(convs).filter("depth > 0").collect():
        assert (r["turn_conv"] == r["conv_id"] or r["turn_conv"] % 100 == 0) and r["turn_place"] >= 0


def test_empty_table_and_the_twin(spark, convs, rows, tmp_path):
    assert prefixes.prefix_trie(convs.filter("false")).collect() == []
    convs.write.parquet(f"{tmp_path}/conversations.parquet")
    base = duckdb.connect()
    base.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = Counter(tuple(r) for r in queries.queries()["op13_conversation_trie"](spark, str(tmp_path)).select(COLUMNS).collect())
    assert got == brute(rows) == Counter(base.sql(oracles.PREFIXES).fetchall())
