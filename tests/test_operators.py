"""Dedupe, merge, order, learners and survival against hand values and small independent versions."""

import math
import random
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vulnlake.operators import boosting, concordance, density, forest, learners, merge, ordering, products, pu, ranking, reports, splits, survival, text, upsert

D = [datetime(2021, 1, k + 1) for k in range(9)]
DRAW = random.Random(3)


def test_newest_row(spark):
    old = spark.createDataFrame([("a", D[3], 1), ("b", None, 2), ("c", D[1], 3)], "k string, ts timestamp, v int")
    new = spark.createDataFrame([("a", D[3], 4, "x"), ("b", D[0], 5, "y"), ("c", None, 6, "z")], "k string, ts timestamp, v int, w string")
    got = {r.k: (r.v, r.w) for r in upsert.upsert_latest(old, new, "k", "ts").collect()}
    assert got == {"a": (4, "x"), "b": (5, "y"), "c": (3, None)}
    assert {r.k: r.v for r in upsert.keep_last_arrival(old, new, "k").collect()} == {"a": 4, "b": 5, "c": 6}


def test_latest_by_date(spark):
    df = spark.createDataFrame([("a", D[3], 0), ("a", None, 1), ("b", D[1], 2), ("b", D[1], 3)], "k string, d timestamp, n int")
    assert {r.k: r.n for r in upsert.latest_by_date(df, "k", "d", "n").collect()} == {"a": 1, "b": 3}
    assert {r.k: r.n for r in upsert.latest_by_date(df, "k", "d", "n", nulls="lose").collect()} == {"a": 0, "b": 3}
    assert {r.k: r.n for r in upsert.keep_first(df, "k", "n").collect()} == {"a": 0, "b": 2}


def test_high_water_of_nothing(spark):
    assert upsert.high_water(spark.createDataFrame([], "d timestamp"), ["d"], "2030-01-01").select(F.year("high_water")).first()[0] == 2030


def test_merge_of_all_combinations(spark):
    tags = ["nvd", "jvn", "eu", "kev"]
    rows = {t: [(None, D[0], 1.0), ("CVE-2001-1", D[0], 1.0)] for t in tags}
    for m in range(1, 16):
        for i, t in enumerate(tags):
            if m >> i & 1:
                rows[t].append((f"cve-2002-{m}-FOO", D[i], float(i)))
    rows["nvd"].append(("CVE-2002-1", D[0], -1.0))
    feeds = {t: spark.createDataFrame(r, "cve_id string, published timestamp, base_score double") for t, r in rows.items()}
    got = {r.cve_id: r for r in merge.merge_sources(feeds).collect()}
    assert len(got) == 15 and all(got[f"CVE-2002-{m}"].source_count == m.bit_count() for m in range(1, 16))
    assert got["CVE-2002-15"].sources == "NVD, JVN, EUVD, KEV" and got["CVE-2002-6"].base_score == 2.0 and got["CVE-2002-8"].published == D[3] and got["CVE-2002-8"].base_score is None
    assert got["CVE-2002-1"].base_score == 0.0
    with pytest.raises(ValueError):
        merge.merge_sources({"other": feeds["nvd"]})


def test_statistics_skip_null_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1)], "k string, y int")
    got = merge.group_stat_join(df, "k", {"n": F.count("*")}).collect()
    assert sorted((r.k or "", r.n) for r in got) == [("", None), ("a", 2), ("a", 2)]


def test_ranks_with_ties(spark):
    values = [5.0, 1.0, 5.0, 2.0, 2.0, 2.0, None, 9.0]
    got = ordering.average_rank(spark.createDataFrame([(v,) for v in values], "v double"), "v").collect()
    assert {r.v: r.rank for r in got} == {None: None, 1.0: 1.0, 2.0: 3.0, 5.0: 5.5, 9.0: 7.0}


def test_running_sums_do_not_depend_on_cells(spark):
    df = spark.createDataFrame([(float(v), DRAW.randint(1, 5)) for v in DRAW.sample(range(1000), 200)], "v double, n int")
    for cells in (1, 3, 64):
        got = sorted((r.v, r.n, r.run_n) for r in ordering.running_sums(df, "v", ["n"], rows=cells).collect())
        assert [g[2] for g in got] == np.cumsum([g[1] for g in got]).tolist()


def test_areas(spark):
    rows = [(DRAW.randint(0, 1), float(DRAW.randint(0, 6))) for _ in range(80)]
    got = ordering.auroc_auprc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    p, n = [s for y, s in rows if y], [s for y, s in rows if not y]
    assert got.auroc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p for b in n]))
    steps = sum(sum(1 for y, s in rows if y and s == v) / len(p) * np.mean([y for y, s in rows if s >= v]) for v in {s for _, s in rows})
    assert got.auprc == pytest.approx(steps)
    assert ordering.auroc_auprc(spark.createDataFrame([(1, 1.0)], "y int, s double"), "y", "s").first().auroc is None


def test_rank_metrics_edges(spark):
    df = spark.createDataFrame([(0, 1, 0.9), (1, 0, 0.9), (2, 1, 0.1)], "id int, y int, s double")
    got = ranking.rank_metrics(df, "y", "s", "id", (1, 2, 10)).first()
    assert (got.p_at_1, got.p_at_2, got.p_at_10, got.r_at_2) == (1.0, 0.5, pytest.approx(2 / 3), 0.5)
    assert got.ndcg_at_10 == pytest.approx((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)))
    assert ranking.rank_metrics(df.withColumn("y", F.lit(0)), "y", "s", "id", (2,)).first().p_at_2 is None
    odd = spark.createDataFrame([(0, 1, float("inf")), (1, 1, 0.5), (2, 0, None)], "id int, y int, s double")
    assert ranking.precision_top(odd, "y", "s", "id", 100).first()[0] == 1.0


def test_bins(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, -1.0)], "v double")
    got = {r.v: r.b for r in df.select("v", splits.fixed_bins(F.col("v"), [0, 1, 2, float("inf")], [1, 2, 3]).alias("b")).collect()}
    assert got == {0.0: 1, 1.0: 1, 1.5: 2, 2.0: 2, 3.0: 3, -1.0: None}
    tied = spark.createDataFrame([(v,) for v in (1.0, 1.0, 1.0, 1.0, 2.0, None)], "v double")
    assert {r.v: r.b for r in splits.quantile_bins(tied, "v", ["a", "b", "c", "d"], "b").collect()} == {1.0: "a", 2.0: "a", None: None}


def test_split_without_test_years(spark):
    df = spark.createDataFrame([(f"c{i}", 2010) for i in range(500)] + [("n", None)], "k string, y int")
    got = {r.split: r["count"] for r in splits.temporal_split(df, "y", "k", 2000, 2020).groupBy("split").count().collect()}
    assert sum(got.values()) == 500 and 350 < got["train"] < 450
    with pytest.raises(ValueError):
        splits.temporal_split(df, "y", "k", 2020, 2000)


def test_scaling_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0, None, 2.0), (3.0, None, 2.0), (None, None, 2.0)], "a double, b double, c double")
    _, test, used = splits.impute_and_scale(train, spark.createDataFrame([(None, 1.0, 5.0)], train.schema), ["a", "b", "c"])
    assert used == ["a", "c"] and test.first().z_a == 0.0 and test.first().z_c == 3.0


def test_leaks_are_left_out(spark):
    df = spark.createDataFrame([("x", 1, 2.0, "t", None)], "k string, kev_seen int, a double, b string, n int")
    assert splits.model_projection(df, "k", ["kev_seen", "a", "b", "n", "gone"], ["n"]).first().asDict() == {"k": "x", "a": 2.0, "n": 0.0}


def test_cohort(spark):
    rows = [(D[0], D[2]), (D[0], D[3]), (D[2], None), (D[3], D[1]), (None, D[0])]
    got = reports.unlabeled_positive_cohort(spark.createDataFrame(rows, "published timestamp, kev_published timestamp"), str(D[2])).first()
    assert (got.n, got.known, got.later, got.negative) == (3, 1, 1, 1)


def test_bags_and_density(spark):
    rows = [(i, int(i % 4 == 0), DRAW.gauss(2.0 * (i % 4 == 0), 1), DRAW.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    for fit in (lambda d: pu.train_pu_bagging(d, d, ["a", "b"], "id", "y", bags=5), lambda d: density.density_risk(d, d, ["a", "b"], "id", "y"), lambda d: density.density_risk(d, d, ["a", "b"], "id", "y", components=1)):
        got = fit(df)
        assert got.filter("risk_score < 0 or risk_score > 1 or risk_score is null").count() == 0 and ordering.auroc_auprc(got, "y", "risk_score").first().auroc > 0.8
        assert fit(df.filter("y = 0")).agg(F.max("risk_score")).first()[0] == 0.0
    x, c = np.random.default_rng(1).normal(size=(20, 3)), np.random.default_rng(2).normal(size=(30, 3))
    direct = np.log(np.mean(np.exp(-((x[:, None] - c) ** 2).sum(2) / 0.5), axis=1) / (0.5 * np.sqrt(2 * np.pi)) ** 3)
    assert np.allclose(density.log_density(x, c, 0.5), direct)


@pytest.mark.parametrize("components", [None, 2])
def test_density_equals_all_kernels(spark, monkeypatch, components):
    draw = np.random.default_rng(6)
    monkeypatch.setattr(density, "SLICE", 13)
    monkeypatch.setattr(density, "PILOT", 9)
    middles = draw.normal(scale=4, size=(5, 3))
    rows = [(i, int(draw.random() < 0.3), *map(float, middles[i % 5] + draw.normal(size=3))) for i in range(230)]
    rows += [(300 + i, 0, 1.0, 1.0, 1.0) for i in range(70)] + [(400, 1, None, 1.0, 2.0), (401, None, 2.0, None, None)]
    tried = [(i, int(i % 2), *map(float, 3 * draw.normal(size=3))) for i in range(60)] + [(60, 0, 1.0, 1.0, 1.0), (61, 1, 900.0, -900.0, 0.0), (61, 1, None, None, None)]
    schema, names = "id int, y int, a double, b double, c double", ["a", "b", "c"]
    train, test = spark.createDataFrame(rows, schema), spark.createDataFrame(tried, schema)
    got = density.density_risk(train, test, names, "id", "y", components=components, noise_ratio=0.7, cell=10).collect()
    x = density.vectors(train, names)
    p, n = (np.array([[v or 0.0 for v in r[2:]] for r in rows if (r[1] == 1) == k]) for k in (True, False))
    size = int(len(n) * 0.7)
    noise = np.array([r["x"] for r in density.scrambled(train.select(F.xxhash64(F.col("id").cast("string"), x).alias("id"), x.alias("x")), size, 5, 20).collect()])
    assert len(noise) == size
    t = np.array([[v or 0.0 for v in r[2:]] for r in tried])
    if components:
        every = np.vstack([p, n])
        axes = np.linalg.svd(every - every.mean(axis=0), full_matrices=False)[2][:components].T
        p, n, noise, t = ((m - every.mean(axis=0)) @ axes for m in (p, n, noise, t))
    logs = [density.log_density(t, m, 0.5) for m in (p, n, noise)]
    want = np.exp(logs[0] - np.logaddexp.reduce(logs))
    assert sorted((r["id"], r["y"]) for r in got) == sorted(r[:2] for r in tried)
    assert np.allclose(sorted(r["risk_score"] for r in got), sorted(want), atol=1e-6)
    by = dict(zip([r[0] for r in tried[:60]], want))
    assert all(abs(by[r["id"]] - r["risk_score"]) < 1e-6 for r in got if r["id"] < 60)


def test_density_shares_kernels_and_leaves_out_far_leaves_only(monkeypatch):
    draw = np.random.default_rng(9)
    centres = np.column_stack([np.round(draw.normal(scale=9, size=(3000, 2)), 1), draw.integers(0, 3, (3000, 2))])
    own = np.repeat(draw.normal(scale=9, size=(40, 2)), 9, axis=0)
    points = np.vstack([np.column_stack([own, np.tile([[a, b] for a in range(3) for b in range(3)], (40, 1))]), [[60.0, 0, 0, 0], [900.0, -900.0, 0, 0]]])
    weights = (draw.integers(0, 3, (3000, 3)) + 1) / 9000
    m, s = density.kernel_sums(points, centres, weights, 0.5)
    want = m + np.log(s)
    whole = np.logaddexp.reduce(want, axis=1)
    summed, before = [], len(points) * 3000
    monkeypatch.setattr(density.np, "exp", lambda x, *a, f=np.exp, **k: summed.append(np.size(x)) or f(x, *a, **k))
    for few, leaf in (([], 9), ([2, 3], 1)):
        summed.clear()
        monkeypatch.setattr(density, "LEAF", leaf)
        m, s = density.near_sums(points, whole - 3, centres, weights, 0.5, 1e-8, 32, few)
        assert 0 < sum(summed) < before / 2
        before = sum(summed)
        with np.errstate(divide="ignore"):
            got = m + np.log(s)
        assert np.allclose(np.exp(got - whole[:, None]), np.exp(want - whole[:, None]), atol=1e-8)
    parts = density.leaves(centres, 32)
    assert sorted(np.concatenate(parts)) == list(range(3000)) and max(map(len, parts)) <= 32
    assert sorted(map(len, density.leaves(np.zeros((100, 2)), 30))) == [25] * 4


def test_scrambled_columns_are_permutations(spark):
    rows = [(i, [float(i), float(i) ** 2, float(i % 7)]) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    made = np.array([r["x"] for r in density.scrambled(df, 150, 3, cell_rows=20).collect()])
    assert all(sorted(made[:, j]) == sorted(r[1][j] for r in rows) for j in range(3))
    assert abs(np.corrcoef(made[:, 0], made[:, 1])[0, 1]) < 0.3
    assert density.scrambled(df, 40, 3).count() == 40


def test_trees(spark):
    draw = np.random.default_rng(4)
    rows = [(i, 2000 + i % 3, y, float(draw.normal(2.5 * y)), float(draw.normal()) if i % 5 else None) for i, y in enumerate(map(int, draw.integers(0, 2, 240)))]
    df = spark.createDataFrame(rows, "id int, year int, y int, a double, b double").cache()
    train, test = df.filter("id < 160"), df.filter("id >= 160")
    area = lambda got: ordering.auroc_auprc(got, "y", "risk_score").first().auroc
    got, weights = learners.train_forest(train, test, ["a", "b"], "id", "y", trees=30)
    assert got.count() == 80 and area(got) > 0.9 and weights[0][0] == "a"
    grid = [{"depth": 1, "step": 0.1, "rounds": 1}, {"depth": 3, "step": 0.1, "rounds": 5}, {"depth": 3, "step": 0.1, "rounds": 9}]
    judged = []
    for g in grid:
        scores, _ = learners.train_boosted(train.filter("year < 2002"), train.filter("year = 2002"), ["a", "b"], "id", "y", grid=[g])
        judged.append(ordering.auroc_auprc(scores, "y", "risk_score").first().auprc)
    assert learners.tuned(train, ["a", "b"], "id", "y", "year", grid, 7) == grid[max(range(3), key=lambda i: (judged[i], -i))]
    assert learners.tuned(train.filter("y = 1 or year < 2002"), ["a", "b"], "id", "y", "year", grid, 7) == grid[0]  # one class in the last year
    got, weights = learners.train_boosted(train, test, ["a", "b"], "id", "y", "year", grid)
    assert got.count() == 80 and area(got) > 0.85 and weights[0][0] == "a"
    assert len(learners.GRID) == 8 and {g["rounds"] for g in learners.GRID} == {300, 600}


def tree_table(spark, n, width, seed):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, width)), 1)  # ties
    y = (x[:, 0] * x[:, 1] + x[:, 2] + draw.normal(scale=0.7, size=n) > 0).astype(int)
    ids = draw.integers(-(2**62), 2**62, n)
    frame = [(int(i), int(v), [float(c) for c in r]) for i, v, r in zip(ids, y, x)]
    return spark.createDataFrame(frame, "id long, y int, x array<double>").repartition(3), x, y, ids.view(np.uint64)


def grow_plainly(x, y, w, tree, node, tried, seed):
    """A tree by recursion and plain loops: (column, threshold, left, right) or the share of positives."""
    p, q = w[y == 1].sum(), w[y == 0].sum()
    if not p or not q:
        return p / (p + q)
    gini = lambda m: 2 * w[m & (y == 1)].sum() * w[m & (y == 0)].sum() / w[m].sum()
    best, looked, every = None, 0, np.ones(len(x), bool)
    for c in forest.order_of_columns(seed, tree, node, x.shape[1]):
        values = sorted(set(x[:, c]))
        if len(values) < 2:
            continue
        for low, high in zip(values, values[1:]):
            m = x[:, c] <= low
            gain = gini(every) - gini(m) - gini(~m)
            if best is None or gain > best[0] + 1e-9 * gini(every):
                best = (gain, c, (low + high) / 2)
        looked += 1
        if looked == tried:
            break
    if best is None:
        return p / (p + q)
    m = x[:, best[1]] > best[2]
    return (best[1], best[2], grow_plainly(x[~m], y[~m], w[~m], tree, 2 * node, tried, seed), grow_plainly(x[m], y[m], w[m], tree, 2 * node + 1, tried, seed))


def test_forest_equals_plain_trees_on_the_same_bootstraps(spark):
    train, x, y, ids = tree_table(spark, 90, 5, 1)
    test, tx, _, _ = tree_table(spark, 25, 5, 2)
    asked = test.select(F.monotonically_increasing_id().alias("row"), "x").cache()
    got, shares = forest.forest(train, asked, 5, trees=8, seed=3)
    want = np.zeros(25)
    for tree in range(8):
        n = forest.counts(ids, tree, 3).astype(float)
        own = n > 0
        w = n[own] * np.where(y[own] == 1, 0.5 / n[y == 1].sum(), 0.5 / n[y == 0].sum())
        root = grow_plainly(x[own], y[own], w, tree, 1, 2, 3)
        for i, row in enumerate(tx):
            node = root
            while isinstance(node, tuple):
                node = node[3] if row[node[0]] > node[1] else node[2]
            want[i] += node / 8
    by = {tuple(r["x"]): r["p"] for r in asked.join(got, "row").collect()}
    assert all(abs(by[tuple(row)] - p) < 1e-9 for row, p in zip(tx, want))
    assert abs(sum(shares) - 1) < 1e-9 and 0.5 < np.mean([forest.counts(ids, t, 3).mean() for t in range(8)]) < 1.5


def test_upper_nodes_are_split_together_and_their_rows_meet_below(spark):
    train, x, y, _ = tree_table(spark, 1500, 4, 5)
    test, tx, ty, _ = tree_table(spark, 400, 4, 6)
    asked = test.select(F.monotonically_increasing_id().alias("row"), "x", "y").cache()
    area = lambda p: ordering.auroc_auprc(asked.join(p, "row"), "y", "p").first().auroc
    whole, _ = forest.forest(train, asked, 4, trees=12, seed=3)
    split, shares = forest.forest(train, asked, 4, trees=12, seed=3, node_rows=150)
    assert split.count() == 400 and abs(area(whole) - area(split)) < 0.04 and area(split) > 0.8 and abs(sum(shares) - 1) < 1e-9
    upper, classes, _ = forest.upper_splits(train, 4, 12, 2, 150, 3)
    assert len(upper) > 12 * 5 and set(classes) == set(range(12))
    w = forest.counts(np.array([r["id"] for r in train.collect()]).view(np.uint64), 0, 3)
    xs = np.array([r["x"] for r in train.collect()])
    sizes = pd.Series(w).groupby(forest.nodes_of(xs, 0, upper)).sum()
    assert sizes.max() <= 150 and len(sizes) > 5


def test_trees_of_thousands_of_rows_are_grown_whole_and_exactly(spark, monkeypatch):
    monkeypatch.setattr(forest, "upper_splits", None)  # not called
    train, x, y, ids = tree_table(spark, 7000, 5, 14)
    asked = train.withColumn("row", F.col("id")).cache()
    got, shares = forest.forest(train, asked, 5, trees=3, seed=3)
    by = {r["row"]: r["p"] for r in got.collect()}
    w = np.array([forest.counts(ids, t, 3) for t in range(3)])
    same = pd.DataFrame(x).duplicated(keep=False).to_numpy()
    sure = (w > 0).all(axis=0) & ~same  # rows that all trees have seen, and no other row like them: leaves are pure
    assert sure.sum() > 1000 and all(by[int(i)] == v for i, v in zip(ids.view(np.int64)[sure], y[sure]))
    assert len(by) == len(set(ids)) and abs(sum(shares) - 1) < 1e-9


def test_boosting_equals_plain_rounds_whatever_the_tasks(spark):
    train, x, y, ids = tree_table(spark, 400, 4, 8)
    settings = [{"depth": 2, "step": 0.3}, {"depth": 3, "step": 0.1}]
    one, three = (boosting.fit(train, 4, settings, 7, seed=5, tasks=t) for t in (1, 3))
    edges = boosting.columns_edges(train, 4)
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    for i, s in enumerate(settings):
        margin = np.zeros(400)
        for number, tree in enumerate(one[i]):
            assert np.allclose(tree, three[i][number], atol=1e-7)
            p = 1 / (1 + np.exp(-margin))
            seen, columns = boosting.seen_rows(ids, number, 5), boosting.seen_columns(4, number, 5)
            g, h = np.where(seen, w * (p - y), 0), np.where(seen, w * p * (1 - p), 0)
            score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: E731, B023
            todo = [(1, np.ones(400, bool), 0)]
            while todo:
                node, m, depth = todo.pop()
                assert np.isclose(tree[node, 3], -g[m].sum() / (h[m].sum() + 1), atol=1e-9)
                cuts = [(score(m & (x[:, c] <= e)) + score(m & (x[:, c] > e)) - score(m), c, e) for c in columns for e in edges[c] if min(h[m & (x[:, c] <= e)].sum(), h[m & (x[:, c] > e)].sum()) >= 1]
                best = max(cuts, default=(0, -1, 0))
                if depth == s["depth"] or best[0] <= 1e-9:
                    assert tree[node, 0] == -1
                    continue
                c, e = int(tree[node, 0]), tree[node, 2]
                assert np.isclose(tree[node, 4], best[0]) and any(np.isclose(k[0], best[0]) and k[1] == c and k[2] == e for k in cuts)
                todo += [(2 * node, m & (x[:, c] <= e), depth + 1), (2 * node + 1, m & (x[:, c] > e), depth + 1)]
            margin += s["step"] * tree[boosting.places(x, tree, 2), 3]
        asked = train.withColumn("row", F.col("id"))
        got = {r["row"]: r["p"][i] for r in boosting.scored(asked, 4, [(s["step"], one[i]) for i, s in enumerate(settings)]).collect()}
        assert np.allclose([got[int(v)] for v in ids.view(np.int64)], 1 / (1 + np.exp(-margin)))


def test_boosting_sends_no_messages_where_rows_fit_a_task(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    stages, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, schema, barrier=False, **more: stages.append(barrier) or plain(self, f, schema, barrier, **more))
    value = lambda c: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)).cast("double")
    df = spark.range(60_000).select(F.xxhash64("id").alias("id"), F.array(*[value(c) for c in range(4)]).alias("x")).withColumn("y", (F.col("x")[0] + F.col("x")[1] > 120).cast("int"))
    settings = [{"depth": 3, "step": 0.3}, {"depth": 5, "step": 0.1}]
    trees = boosting.fit(df, 4, settings, 12)
    assert [len(t) for t in trees] == [12, 12] and [len(t[0]) for t in trees] == [16, 64] and not any(stages)
    asked = df.limit(2000).withColumn("row", F.col("id")).cache()
    fits = [(0.3, trees[0][:5]), (0.1, trees[1]), (0.3, trees[0]), (0.3, [])]
    both = boosting.scored(asked, 4, fits).select("row", F.posexplode("p").alias("k", "p")).join(asked, "row")
    area = {r["k"]: r["auroc"] for r in ordering.auroc_auprc(both, "y", "p", "k").collect()}
    assert area[2] >= area[0] > 0.9 and area[1] > 0.95 and area[3] == 0.5
    alone = {r["row"]: r["p"][0] for r in boosting.scored(asked, 4, fits[2:3]).collect()}
    assert all(alone[r["row"]] == r["p"][2] for r in boosting.scored(asked, 4, fits).collect())


def test_boosting_of_rows_that_cannot_be_split():
    y, ids, edges = np.array([0.0, 1.0] * 20), np.arange(40, dtype=np.uint64), [np.array([1.0]), np.array([0.5])]
    for x, leaves in ((np.zeros((40, 2), np.uint8), 1), (np.column_stack([y, y]).astype(np.uint8), 2)):
        trees = [[], []]
        boosting.grown(x, y, ids, 1.0, [{"depth": 4, "step": 0.5}, {"depth": 1, "step": 0.5}], trees, 3, 7, edges, lambda s: s)
        assert [len(t) for t in trees] == [3, 3] and all(len(set(boosting.places(x, t, 1))) == leaves for own in trees for t in own)


def test_boosting_is_no_worse_than_sparks_learner_and_goes_on_after_a_stage(spark, monkeypatch):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    train, _, _, _ = tree_table(spark, 900, 4, 11)
    test, _, _, _ = tree_table(spark, 600, 4, 12)
    asked = test.withColumn("row", F.col("id")).cache()
    long = boosting.fit(train, 4, [{"depth": 3, "step": 0.1}], 60)[0]
    monkeypatch.setattr(boosting, "ROUNDS_A_JOB", 17)
    stages = boosting.fit(train, 4, [{"depth": 3, "step": 0.1}], 60)[0]
    assert len(stages) == 60 and all(np.allclose(a, b, atol=1e-7) for a, b in zip(long, stages))
    own = asked.join(boosting.scored(asked, 4, [(0.1, long)]), "row").withColumn("s", F.col("p")[0])
    as_vectors = lambda df: df.withColumn("v", array_to_vector("x"))
    theirs = GBTClassifier(featuresCol="v", labelCol="y", maxIter=60, maxDepth=3, stepSize=0.1, seed=1).fit(as_vectors(train)).transform(as_vectors(asked)).withColumn("s", vector_to_array("probability")[1])
    a, b = (ordering.auroc_auprc(d, "y", "s").first().auroc for d in (own, theirs))
    assert a > b - 0.01 and a > 0.8


def test_weibull_is_at_its_optimum(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(300, 2))
    t = 100 * np.exp(0.5 + 0.7 * x[:, 0]) * draw.weibull(1.5, 300)
    e = draw.integers(0, 2, 300)
    noise = draw.normal(size=(300, 4))
    names = [f"w{i}" for i in range(4)]
    df = spark.createDataFrame([(i, *map(float, r), float(t[i]), int(e[i]), 1.0) for i, r in enumerate(np.hstack([x, noise]))], ["id", "a", "b", *names, "t", "e", "same"])
    got = learners.weibull_aft(df, ["a", "b", "same"], "t", "e", "id").toPandas().sort_values("id")
    # the parameters lie in log(-log S) = (log t - intercept - x beta) / scale
    z = np.log(-got.log_survival.to_numpy())
    lines = np.column_stack([np.log(t / 100), np.ones(300), x])
    found = np.linalg.lstsq(lines, z, rcond=None)[0]
    assert np.abs(lines @ found - z).max() < 1e-9 and np.allclose(got.log_density, z + np.log(found[0]) - np.log(t / 100) - np.exp(z))

    def objective(p):
        """Shape, intercept and coefficients: the mean likelihood less the penalty on coefficients of scaled covariates."""
        z = p[0] * (np.log(t / 100) - p[1] - x @ p[2:])
        return (e * (z + np.log(p[0]) - np.log(t / 100)) - np.exp(z)).mean() - 0.05 / 2 * ((p[2:] * x.std(axis=0, ddof=1)) ** 2).sum()

    at = np.array([found[0], *(-found[1:] / found[0])])
    steps = [np.eye(4)[i] * h for i in range(4) for h in (1e-3, -1e-3)]
    assert all(objective(at) > objective(at + s) for s in steps) and abs(at[0] - 1.5) < 0.3
    assert all(abs(objective(at + s) - objective(at - s)) / 2e-3 < 1e-5 for s in steps)
    free = learners.weibull_aft(df, ["a", "b"], "t", "e", "id", penalizer=0.0).toPandas().sort_values("id")
    z = np.log(-free.log_survival.to_numpy())
    loose = np.linalg.lstsq(lines, z, rcond=None)[0]
    assert abs(loose[2] / loose[0]) > abs(at[2]) and not np.allclose(loose, found, atol=1e-3)
    reduced, few = learners.components(df, names, 2)
    directions = np.linalg.svd(noise)[2][:2]
    own = reduced.orderBy("id").select(*few).toPandas().to_numpy()
    assert np.allclose(np.abs(own), np.abs(noise @ directions.T)) and not set(names) & set(reduced.columns)
    assert learners.weibull_aft(df, ["a"], "t", "e", "id", names, most=3, n=2).filter("log_survival <= 0").count() == 300


def test_logistic_fits_are_at_their_optima(spark):
    draw = np.random.default_rng(3)
    rows = [(b, float(y), float(draw.normal(y * (b + 1))), float(draw.normal())) for b in range(3) for y in draw.integers(0, 2, 150)]
    fitted = pu.logistic_fits(spark.createDataFrame(rows, "bag int, y double, a double, b double"), ["a", "b"], 3)
    for bag, w in enumerate(fitted):
        x = np.array([(1.0, a, b) for k, _, a, b in rows if k == bag])
        y = np.array([y for k, y, *_ in rows if k == bag])
        gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.array([1e-9, 1, 1]) * w
        assert np.abs(gradient).max() < 1e-6 and w[1] > 0.3


def test_wide_bags_are_fitted_by_a_job_of_few_expressions(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.group import GroupedData

    rows = spark.range(3000).select((F.col("id") % 2).cast("int").alias("bag"), *[(F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 500 - 1).alias(f"x{c}") for c in range(32)])
    rows = rows.withColumn("y", (F.col("x0") + F.col("x1") + F.col("x2") > 0).cast("double"))
    asked = []
    for kind in (DataFrame, GroupedData):  # an expression for each cell of a Hessian: 594 of them, too many to be compiled
        monkeypatch.setattr(kind, "agg", lambda self, *c, f=kind.agg: asked.append(len(c)) or f(self, *c))
    w = pu.logistic_fits(rows, [f"x{c}" for c in range(32)], 3)
    assert max(asked, default=0) < 100 and (w[:2, 1:4] > 1).all() and np.abs(w[:2, 4:]).max() < 0.5 and not w[2].any()


def test_quantiles(spark):
    rows = [(g, float(DRAW.randint(0, 40)) if DRAW.random() < 0.9 else None, DRAW.randint(1, 4)) for g in "abc" for _ in range(DRAW.randint(1, 90))]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    probs = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)
    for cell in (3, 25, None):
        got = ordering.quantiles(df, "v", probs, rows=cell).first()
        assert list(got.q) == pytest.approx(np.quantile([v for _, v, _ in rows if v is not None], probs))
        for r in ordering.quantiles(df, "v", probs, "g", rows=cell).collect():
            own = [v for g, v, _ in rows if g == r.g and v is not None]
            assert r.n == len(own) and list(r.q) == pytest.approx(np.quantile(own, probs))
    weighed = [v for _, v, w in rows if v is not None for _ in range(w)]
    assert list(ordering.quantiles(df, "v", probs, weight="w").first().q) == pytest.approx(np.quantile(weighed, probs))
    assert ordering.quantiles(df.filter("false"), "v", probs).count() == 0


def cox_loss(beta, z, t, e, g, penalizer):
    total = 0.0
    for s in set(g):
        m = g == s
        zs, ts, es = z[m], t[m], e[m]
        w = np.exp(zs @ beta)
        for u in set(ts[es == 1]):
            dead, risk = (ts == u) & (es == 1), ts >= u
            d = dead.sum()
            total += (zs[dead] @ beta).sum() - sum(np.log(w[risk].sum() - k / d * w[dead].sum()) for k in range(d))
    return total - penalizer / 2 * e.sum() * beta @ beta


def test_cox(spark):
    g = np.random.default_rng(4)
    n = 150
    frame = pd.DataFrame({"id": range(n), "a": g.normal(size=n), "b": g.normal(size=n), "stratum": g.choice(["x", "y"], n), "event": g.integers(0, 2, n)})
    frame["time_to_event"] = np.ceil(10 * g.exponential(np.exp(-0.8 * frame["a"])) + 0.1)
    df = spark.createDataFrame(frame)
    model = survival.cox_fit(df, ["a", "b"], "stratum", 0.1)
    z = ((frame[["a", "b"]] - frame[["a", "b"]].mean()) / frame[["a", "b"]].std(ddof=0)).to_numpy()
    loss = lambda b: cox_loss(np.array(b), z, frame["time_to_event"].to_numpy(), frame["event"].to_numpy(), frame["stratum"].to_numpy(), 0.1)
    for i in range(2):
        step = np.eye(2)[i] * 1e-4
        assert abs(loss(model.beta + step) - loss(model.beta - step)) / 2e-4 < 1e-3
    assert model.beta[0] > 0.3
    days = survival.predicted_day(df, model, "stratum", "id", q=0.5).toPandas()
    assert len(days) == int((frame["event"] == 0).sum())
    # the same by the full matrix
    steps = survival.baseline_steps(df, model, "stratum").toPandas()
    curves = {s: x.sort_values("t") for s, x in steps.groupby("g")}
    pool = np.concatenate([np.exp(-curves[s]["hazard"].to_numpy() * r) for s, r in zip(days["g"], days["risk_score"])])
    for q in (0.05, 0.5):
        days, threshold = survival.predicted_day(df, model, "stratum", "id", q=q).toPandas(), np.quantile(pool, q)
        close = 0
        for s, r, day in zip(days["g"], days["risk_score"], days["predicted_day"]):
            survives = np.exp(-curves[s]["hazard"] * r)
            crossed = curves[s][survives <= threshold]
            # Python's and the JVM's exp may differ in the last place, where a value is the threshold itself
            close += int(abs(survives / threshold - 1).min() < 1e-14)
            assert (np.isnan(day) and crossed.empty) or day == crossed["t"].min() or abs(survives / threshold - 1).min() < 1e-14
        assert close <= 2


def test_quantiles_of_products(spark):
    g = np.random.default_rng(9)
    risks = {"x": [*g.exponential(size=40), 2.5, 2.5, 0.0, 1e-200, 1e200], "y": [1.0] * 30, "z": list(g.exponential(5, size=7)), "only risks": [1.0]}
    hazards = {"x": np.cumsum(g.exponential(size=31)), "y": np.arange(1.0, 20.0), "z": np.array([1e-9, 3.0]), "only steps": np.array([1.0, 2.0])}
    rows = [(s, float(r)) for s, v in risks.items() for r in v]
    groups = spark.createDataFrame(rows, "g string, risk double").groupBy("g", "risk").agg(F.count("*").alias("n")).cache()
    steps = products.indexed(spark.createDataFrame([(s, float(i), float(h)) for s, v in hazards.items() for i, h in enumerate(v)], "g string, t double, hazard double")).cache()
    pool = np.concatenate([np.exp(-np.outer(risks[s], hazards[s])).ravel() for s in risks if s in hazards])
    for q, made in ((0.05, 10**6), (0.5, 60), (1.0, 10**6)):
        assert products.survival_quantile(groups, steps, q, made) == pytest.approx(np.quantile(pool, q), rel=1e-12, abs=1e-300)
    assert products.survival_quantile(groups.filter("g = 'only risks'"), steps, 0.5) is None
    again = products.first_below(groups.select("g", "risk"), steps, 0.25).collect()
    assert len(again) == groups.count()
    for r in again:
        first = [i for i, h in enumerate(hazards.get(r["g"], [])) if np.exp(-h * r["risk"]) <= 0.25]
        assert r["t"] == (first[0] if first else None)


@pytest.mark.parametrize("rows, cells", [(100_000, 64), (12, 3), (30, 2)])
def test_concordance(spark, monkeypatch, rows, cells):
    monkeypatch.setattr(concordance, "CELLS", cells)
    levels, real = [], concordance.cell
    monkeypatch.setattr(concordance, "cell", lambda *args: levels.append(1) or real(*args))
    data = [(float(DRAW.randint(1, 15)), float(DRAW.randint(1, 6)), DRAW.randint(0, 1)) for _ in range(120)] + [(7.0, DRAW.random(), DRAW.randint(0, 1)) for _ in range(60)] + [(DRAW.random(), 3.0, 1) for _ in range(30)]
    got = concordance.concordance_index(spark.createDataFrame([*data, (None, 1.0, 1), (1.0, None, 0)], "t double, s double, e int"), "t", "s", "e", rows=rows).first()
    pairs = [(a, b) for i, a in enumerate(data) for j, b in enumerate(data) if i != j and a[2] and (a[0] < b[0] or (a[0] == b[0] and not b[2]))]
    assert got.pairs == len(pairs) and got.concordance == pytest.approx(np.mean([(a[1] > b[1]) + (a[1] == b[1]) / 2 for a, b in pairs]))
    assert (len(levels) >= 6) == (rows < 1000)  # three levels at least, two calls each
    none = concordance.concordance_index(spark.createDataFrame([(1.0, 1.0, 0)], "t double, s double, e int"), "t", "s", "e").first()
    assert none.concordance is None and none.pairs is None


def test_likelihood_ratio(spark):
    rows = [(i, int(i < 10), float(i), float(i % 3)) for i in range(30)]
    got = learners.nb_llr(spark.createDataFrame(rows, "id int, y int, a double, b double"), ["a", "b"], "y", "id", 1).orderBy("id").collect()
    assert got[0].llr > 0 > got[29].llr and got[0].top == ["a"]


def test_survival_frame_edges(spark):
    rows = [("a", True, D[2], D[1], 1.0), ("b", True, D[2], D[2], 1.0), ("c", False, D[2], None, None), ("d", False, D[2], None, -1.0), ("e", True, D[2], D[4], 4.0)]
    df = spark.createDataFrame(rows, "cve_id string, kev_present boolean, published timestamp, kev_published timestamp, v double")
    got = survival.survival_frame(df, "2021-02-01", ["v"], variance="v").collect()
    assert [(r.cve_id, r.event, r.time_to_event, r.v_sqrt) for r in got] == [("e", 1, 2.0, 2.0)]


def test_suites_and_scores(spark):
    rows = [(f"c{i:03}", int(i % 5 == 0), float(i % 7), float(i % 5), DRAW.gauss(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double, c double")
    train, test = df.filter("id < 'c120'"), df.filter("id >= 'c120'")
    fit = lambda tr, rows, columns: learners.nb_llr(rows, columns, "y", "id", fit_on=tr).withColumnRenamed("llr", "risk_score")
    got = {(r.ablation, r.split): r for r in ranking.ablation_suite(train, test, ["a", "b", "c", "none"], {"full": (), "no_b": ("b",)}, {"nb": fit}, "y", "id", (10, 50)).collect()}
    assert set(got) == {(n, s) for n in ("full", "no_b") for s in ("train", "test")}
    for (name, split), r in got.items():
        part = test if split == "test" else train
        alone = fit(train, part, ["a", "b", "c"] if name == "full" else ["a", "c"])
        one = ordering.auroc_auprc(alone, "y", "risk_score").first()
        top = ranking.rank_metrics(alone, "y", "risk_score", "id", (10, 50)).first()
        assert (r.auroc, r.auprc, r.p_at_10, r.ndcg_at_50) == pytest.approx((one.auroc, one.auprc, top.p_at_10, top.ndcg_at_50))
    assert got["full", "test"].auroc == 1.0 > got["no_b", "test"].auroc and got["full", "test"].prevalence == pytest.approx(0.2)
    scores = ranking.model_scores(train, test, {"nb": (fit, ["a", "b"])}, "id").collect()
    assert len(scores) == 200 and {r.split for r in scores} == {"train", "test"} and all(r.risk_score_nb is not None for r in scores)


def test_logistic_side_by_side_equals_single_fits(spark):
    draw = np.random.default_rng(3)
    rows = [(i, int(draw.random() < 1 / (1 + math.exp(-float(v[0]) + 1))), *[None if draw.random() < 0.1 else float(c) for c in v]) for i, v in enumerate(draw.normal(size=(240, 4)))]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double, c double, d double")
    train, test = df.filter("id < 160"), df.filter("id >= 160")
    configs = {"all": ["a", "b", "c", "d"], "few": ["b", "d"], "one": ["a"], "none": []}
    got = learners.logistic_side_by_side(train, test, configs, "y", "id").collect()
    assert len(got) == 80 * 4
    for name in ("all", "few", "one"):
        alone = {r["id"]: r["risk_score"] for r in learners.train_logistic(train, test, configs[name], "id", "y")[0].collect()}
        assert all(abs(r["risk_score"] - alone[r["id"]]) < 1e-4 for r in got if r["ablation"] == name)
    assert all(abs(r["risk_score"] - 0.5) < 1e-6 for r in got if r["ablation"] == "none")
    suite = ranking.ablation_suite(train, test, "abcd", {"full": (), "few": ("a", "c")}, {}, "y", "id", (10,), {"logreg": learners.logistic_side_by_side}).collect()
    few = [r for r in got if r["ablation"] == "few"]
    one = ordering.auroc_auprc(spark.createDataFrame(few), "y", "risk_score").first()
    assert {(r.ablation, r.split) for r in suite} == {(n, s) for n in ("full", "few") for s in ("train", "test")}
    assert [r.auroc for r in suite if (r.ablation, r.split) == ("few", "test")] == [pytest.approx(one.auroc)]


def test_a_logistic_fit_is_at_its_optimum(spark):
    draw = np.random.default_rng(13)
    x = draw.normal(size=(150, 2))
    y = (draw.random(150) < 1 / (1 + np.exp(-x[:, 0] + 0.5))).astype(int)
    df = spark.createDataFrame([(i, int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x))], "id int, y int, a double, b double")
    got, coefficients = learners.train_logistic(df, df, ["a", "b"], "id", "y")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    beta = np.array([dict(coefficients)[c] for c in "ab"])
    p = np.array([r["risk_score"] for r in got.orderBy("id").collect()])
    intercept = np.log(p / (1 - p)) - z @ beta
    w = np.where(y == 1, 150 / (2 * y.sum()), 150 / (2 * (150 - y.sum())))
    loss = lambda q: (w * np.log1p(np.exp(-np.where(y == 1, 1, -1) * (q[0] + z @ q[1:])))).sum() + q[1:] @ q[1:] / 2
    at = np.array([intercept.mean(), *beta])
    assert np.ptp(intercept) < 1e-6 and all(abs(loss(at + s) - loss(at - s)) / 2e-4 < 1e-2 for s in np.eye(3) * 1e-4)


def test_tfidf_weights(spark):
    import math
    from collections import Counter

    texts = {1: "alpha alpha beta gamma", 2: "beta gamma gamma the and", 3: "alpha delta x", 4: None, 5: "ALPHA beta-gamma"}
    got = {(r.id, r.term): r.weight for r in text.tfidf_top_terms(spark.createDataFrame(list(texts.items()), "id int, t string"), "id", "t", 3).collect()}
    words = {i: Counter(w for w in (t or "").lower().replace("-", " ").split() if w in ("alpha", "beta", "gamma")) for i, t in texts.items()}
    idf = {w: math.log(6 / (1 + sum(w in c for c in words.values()))) + 1 for w in ("alpha", "beta", "gamma")}
    want = {}
    for i, c in words.items():
        norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        want |= {(i, w): n * idf[w] / norm for w, n in c.items()}
    assert got == pytest.approx(want)


def test_tfidf_as_columns(spark):
    df = spark.createDataFrame([(1, "alpha beta. beta"), (2, "alpha gamma"), (3, None)], "id int, t string")
    wide, names = text.tfidf_columns(df, "id", "t", 3)
    long = {(r.id, r.term): r.weight for r in text.tfidf_top_terms(df, "id", "t", 3).collect()}
    want = {i: [long.get((i, w), 0.0) for w in ("alpha", "beta", "gamma")] for i in (1, 2)}
    assert names == ["tfidf_0", "tfidf_1", "tfidf_2"] and {r.id: list(r[1:]) for r in wide.collect()} == want


def test_hazard_scopes(spark):
    df = spark.createDataFrame([("a", 2, "critical", 0.5), ("b", 1, "critical", 0.9), ("c", 3, "high", 0.7), ("d", 1, "low", 0.1)], "id string, n int, bin string, risk_score double")
    names = lambda **k: [r.id for r in survival.hazard_scope(df, "n", "bin", **k).collect()]
    assert (names(), names(scope="critical"), names(scope="all")) == (["c", "a"], ["b", "a"], ["b", "c", "a", "d"])
    with pytest.raises(ValueError):
        names(scope="none")
