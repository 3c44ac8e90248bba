"""Each pipeline stage, and the whole, against plain Python on a small table with awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from vulnlake.llm import near, quality, suffixes
from vulnlake.llm.simhash import fingerprint

DRAW = random.Random(11)
LETTERS = {"aa": "abcdefg", "bb": "mnopqrs"}


def prose(lang, n):
    return " ".join("".join(DRAW.choice(LETTERS[lang]) for _ in range(DRAW.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    passage = prose("aa", 90)
    texts = [("aa" if i % 2 else "bb", prose("aa" if i % 2 else "bb", DRAW.randint(60, 200))) for i in range(60)]
    texts += [("aa", prose("aa", 60) + " " + passage), ("aa", passage + " " + prose("aa", 60)), texts[3], texts[4], texts[4], ("aa", "short"), ("aa", None), (None, ""), ("bb", "1 2 3 " * 100), (None, prose("bb", 80))]
    texts += [("aa", " ".join(w + "###" for w in prose("aa", 80).split())), ("bb", "x y z " * 100)]
    return [(i, t, lang, "s", None if t is None else len(t), "clash", 1) for i, (lang, t) in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, `own.id` long"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def got(df):
    return sorted((r.doc_id, r.text, r.lang) for r in df.collect())


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]


def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = stage("quality rules")(spark, docs, "")
    assert kept.columns == docs.columns
    good = {r[0] for r in rows if (b := quality.base_measures(r[1] or ""))[0] >= 50 and 100 * b[4] <= 50 * b[0] and b[2] == 0}
    assert {r.doc_id for r in kept.collect()} == good

    known = stage("language ID")(spark, kept, "")
    assert known.columns == docs.columns and {r[0] for r in got(known)} == good
    assert {r.lang for r in known.filter("doc_id = 69").collect()} == {"bb"}

    single = stage("SimHash near-dedup")(spark, known, "")
    first = {}
    for i in sorted(good):
        bits = fingerprint(rows[i][1])
        if not any((bits ^ b).bit_count() <= 2 for b in first):
            first[bits] = i
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == set(first.values())

    cut = stage("suffix-array dedup")(spark, single, "")
    texts = {r.doc_id: r.text for r in single.collect()}
    size, least = suffixes.PASSAGE
    windows = Counter(t[p : p + size] for t in texts.values() for p in range(len(t) - size + 1))
    want = {}
    for i, t in texts.items():
        marks = ["."] * len(t)
        for p in range(len(t) - size + 1):
            if windows[t[p : p + size]] > 1:
                marks[p : p + size] = "x" * size
        spans = [m.span() for m in re.finditer("x+", "".join(marks)) if len(t[m.start() : m.end()].split()) >= least]
        edges = [0, *[e for s in spans for e in s], len(t)]
        want[i] = "".join(t[x:y] for x, y in zip(edges[::2], edges[1::2]))
    assert {r.doc_id: r.text for r in cut.collect()} == want and want != texts and all(r.n_chars == len(r.text) for r in cut.collect())

    packed = stage("best-fit packing")(spark, cut, "").collect()
    assert {r.doc_id for r in packed} == set(want) and all(r.offset + r.length <= 1024 for r in packed)


def test_run_equals_its_stages(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


def test_empty_table_and_torn_characters(spark, monkeypatch):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "")
        assert docs.count() == 0
    torn = spark.createDataFrame([(1, b"a\xc3")], "doc_id long, kept binary")
    monkeypatch.setattr(suffixes, "deduplicated", lambda *_, **__: torn)
    out = corpus_pipeline.passage_dedup(spark, spark.createDataFrame([], "doc_id long, text string"), "").first()
    assert out.text == "a�"


def test_one_row_of_an_id_that_comes_twice(spark, rows):
    docs = spark.createDataFrame([rows[1], rows[1], rows[2]], SCHEMA)
    assert got(stage("SimHash near-dedup")(spark, docs, "")) == sorted((r[0], r[1], r[2]) for r in (rows[1], rows[2]))


def test_near_copies_of_five_word_shingles(spark):
    base = [prose("aa", 150).split() for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    changed = [[*w[:50], "other", *w[51:100], "words", *w[101:]] for w in base]  # ten of 146 runs differ: similarity 0.87
    rows += [(100 + i, " ".join(w)) for i, w in enumerate(changed)]
    far = [[("x" + c if k % 15 == 0 else c) for k, c in enumerate(w)] for w in base]  # similarity 0.5
    rows += [(200 + i, " ".join(w)) for i, w in enumerate(far)]
    assert sum((fingerprint(a[1]) ^ fingerprint(b[1])).bit_count() > 2 for a, b in zip(rows, rows[20:40])) > 10
    out = stage("SimHash near-dedup")(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == {*range(20), *range(200, 220)}


def test_lists_that_are_cut_to_stars_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "LONGEST", 2)
    monkeypatch.setattr(near, "PART", 3)
    texts = []
    base = [prose("aa", 150).split() for _ in range(6)]
    for words in base:  # pairs of a family share most of their runs, some of them enough
        for _ in range(14):
            changed = list(words)
            for at in DRAW.sample(range(150), DRAW.randint(2, 5)):
                changed[at] = prose("bb", 1)
            texts.append(" ".join(changed))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    asked = []
    real = near.apart
    monkeypatch.setattr(near, "apart", lambda *args: asked.append(real(*args)) or asked[-1])
    rows, named = near.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert asked[0].count() > 0
    found = {}
    for r in rows.join(named, "text_hash").collect():
        found.setdefault(r.component, set()).add(r.doc_id)
    want = {}
    for i, r in enumerate(root):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_a_family_just_short_of_the_similarity_is_not_paired_up(spark):
    draw, n_base, s = random.Random(5), 146, 0.8
    sets = [set(range(n_base)), set(range(n_base))]
    for i in range(240):  # edits of five runs each; the runs that come in are new or, in some, shared
        runs, own = set(range(n_base)), draw.random() < 0.2
        for e in range(draw.randint(0, 6)):
            place = draw.randrange(n_base - 5)
            runs -= set(range(place, place + 5))
            runs |= {1000 + place * 10 + k if own else 10_000 + 100 * i + 10 * e + k for k in range(draw.choice((0, 5, 5, 8)))}
        sets.append(runs)
    frame = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "text_hash long, runs array<long>").cache()
    alone = spark.createDataFrame([], "node long, root long")
    whole = near.prefixes(near.whole(frame, s)).cache()
    differing, cores = near.differences(frame, near.families(whole), s)
    linked = {(r.a, r.b) for r in cores.collect()}
    roots = near.components(cores).cache()
    left = {(r.a, r.b) for r in near.apart(near.prefixes(differing), roots).collect()}
    similar = {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if len(x & y) >= s * len(x | y)}
    assert linked and all((min(p), max(p)) in similar for p in linked)
    root = {r.node: r.root for r in roots.collect()}
    assert all(p in left or root.get(p[0], p[0]) == root.get(p[1], p[1]) for p in similar)
    every = near.apart(whole, alone)
    assert similar <= {(r.a, r.b) for r in every.collect()}
    assert len(left) < 2 * len(sets) < every.count() / 10


def test_rows_without_an_id_or_with_a_shared_one(spark):
    a, b, c, d = (prose("aa", 80) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (1, d), (None, None)]
    out = stage("SimHash near-dedup")(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(out.collect(), key=str) == sorted([(None, a), (None, b), (5, c), (1, d), (None, None)], key=str)


def test_passages_of_over_50_words_go_and_shorter_ones_stay(spark):
    passages = {n: prose("aa", n) for n in (30, 45, 55, 60, 80, 300)}
    rows = [(100 * n + k, f"{prose('bb', 60)} {p} {prose('bb', 60)}") for n, p in passages.items() for k in range(2)]
    cut = {r.doc_id: r.text for r in stage("suffix-array dedup")(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert len(cut) == len(rows)
    for i, t in rows:
        n = i // 100
        assert (passages[n] in cut[i]) == (n < 51) and (n > 50 or cut[i] == t)


def test_all_ids_null(spark):
    docs = spark.createDataFrame([(None, prose("aa", 80), "aa") for _ in range(6)] + [(None, None, None)] * 2, "doc_id long, text string, lang string").repartition(2)
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, "")
        assert docs.count() == 6


def test_parities_bound_differences():
    draw = np.random.default_rng(2)
    for n, extra in ((0, 0), (1, 1), (50, 10), (3000, 400), (9000, 9000)):
        both, a, b = (draw.integers(0, 2**63, k).astype(np.uint64) for k in (n, extra, extra // 2))
        x, y = (near.parity(np.unique(np.concatenate([both, own]))) for own in (a, b))
        assert len(x) == near.PARITY_BITS // 64
        differ = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert differ <= extra + extra // 2 and (extra != 400 or differ > 400)
