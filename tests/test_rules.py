"""Rules stated in words, checked against plain versions: walks, rotations, cuts, ties, entity merges."""

import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import entities, hac, metrics, online, pairs, training, trees_sql
from cladeframe.operators.linkage import LINKAGES, PairScores
from cladeframe.plans.config import Config
from cladeframe.plans.run import run
from cladeframe.sources import tables


def points(x):
    return [(v, str(i), None) for i, v in enumerate(x)]


# Ties -----------------------------------------------------------------------------------------------


def test_neighbours_of_equal_points_are_the_lower_keys(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5))
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (900, None), (None, [0.0] * 5)], "pid long, vec array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(300) for k, j in enumerate(np.lexsort((np.arange(300), d[i]))[:3])}
    for block in (20_000, 70):
        got = pairs.knn(df, df, 3, block=block).collect()
        assert {(r.pid, r.nbr, r["rank"]) for r in got} == want
    nothing = pairs.knn(df, df.where("false"), 3)
    assert nothing.count() == 0 and nothing.columns == ["pid", "nbr", "distance", "rank"]


def test_neighbours_of_other_labels_leave_nulls_out(spark):
    rows = [(i, [float(i)], None if i % 5 == 0 else "ab"[i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "pid long, vec array<double>, label string")
    got = {r.pid: r.nbr for r in pairs.knn(df, df, 1, other_than="label").collect()}
    label = {i: t for i, _, t in rows}
    for i in range(20):
        near = [j for j in range(20) if label[i] and label[j] and label[i] != label[j]]
        assert got.get(i) == (min(near, key=lambda j: (abs(i - j), j)) if near else None)


@pytest.mark.parametrize("block", [20_000, 40])
def test_block_grids_see_each_pair_once(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(130, 4))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)], "pid long, vec array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    got = {(r.a, r.b): (r.score, r.same) for r in pairs.near_pairs(df, 0.6, label="label", block=block).collect()}
    want = {(i, j) for i, j in itertools.combinations(range(130), 2) if u[i] @ u[j] >= 0.6}
    assert set(got) == want and all(s == (i % 3 == j % 3) and v == pytest.approx(u[i] @ u[j]) for (i, j), (v, s) in got.items())
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for r in pairs.group_linkages(df, block=block).collect():
        a, b = (np.flatnonzero(np.arange(130) % 3 == g) for g in (r.g1, r.g2))
        m = d[np.ix_(a, b)]
        assert r.average == pytest.approx(-m.mean()) and r.complete == pytest.approx(-m.max()) and r.single == pytest.approx(-m.min())
        assert r.cosine_complete == pytest.approx((u[a] @ u[b].T).min() - 1)
        i, j = np.unravel_index(m.argmin(), m.shape)
        assert (r.best_a, r.best_b) == (a[i], b[j])


def test_approximate_neighbours_are_found(spark):
    x = np.random.default_rng(8).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, vec array<double>")
    got = pairs.approximate_knn(df, 3).groupBy("pid").agg(F.collect_set("nbr").alias("n"), F.count("*").alias("c")).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :3]
    assert len(got) == 400 and all(r.c == 3 for r in got)
    assert np.mean([len(set(r.n) & set(near[r.pid].tolist())) / 3 for r in got]) >= 0.9


def test_budgeted_best_pairs_are_a_sample_by_hash():
    rng = np.random.default_rng(5)
    s = rng.normal(size=(40, 40))
    s = s + s.T
    link = PairScores(s, budget=50)
    a, b = {"keys": np.arange(20)}, {"keys": np.arange(20, 40)}
    assert link.score(a, b) == link.score(b, a) <= s[:20, 20:].max()
    i, j = link.sample(a["keys"], b["keys"])
    assert len({*zip(i.tolist(), j.tolist())}) == 50 and len(set(i.tolist())) > 12 and len(set(j.tolist())) > 12


# Trees ----------------------------------------------------------------------------------------------


class PlainTree:
    """Grafting as it is stated, over nested sets of points and centroid scores: one node is the frozen
    set of its leaves, and a tree is the set of its nodes."""

    def __init__(self, x):
        self.x, self.nodes = x, set()

    def score(self, a, b):
        return -float(np.linalg.norm(self.x[sorted(a)].mean(0) - self.x[sorted(b)].mean(0)))

    def parent(self, a):
        return min((n for n in self.nodes if n > a), key=len, default=None)

    def sibling(self, a):
        p = self.parent(a)
        return p and p - a

    def own(self, p):
        return self.score(*self.kids(p))

    def kids(self, p):
        a = max((n for n in self.nodes if n < p), key=len)
        return a, p - a

    def beside(self, at, new):
        self.nodes = {n | new if n > at else n for n in self.nodes} | {at | new, new}

    def out(self, a):
        p = self.parent(a)
        keep = {n for n in self.nodes if n <= a}
        self.nodes = {n - a if n > a else n for n in self.nodes - keep if n != p}
        return keep

    def insert(self, i):
        leaf = frozenset([i])
        if not self.nodes:
            self.nodes = {leaf}
            return
        v = self.x[i]
        at = frozenset([min(range(i), key=lambda j: (np.linalg.norm(self.x[j] - v), j))])
        while (p := self.parent(at)) is not None and self.score(leaf, at) < self.own(p):
            at = p
        self.beside(at, leaf)
        self.graft(at | leaf)

    def graft(self, cur):
        barred = set(cur) | (set(self.sibling(cur)) if self.sibling(cur) and len(self.sibling(cur)) == 1 else set())
        while self.parent(cur) is not None:
            every = set().union(*self.nodes)
            free = sorted(every - barred)
            before = cur
            if not free:
                cur = self.parent(cur)
            else:
                c = self.x[sorted(cur)].mean(0)
                nn = frozenset([min(free, key=lambda j: (np.linalg.norm(self.x[j] - c), j))])
                meet = min((n for n in self.nodes if n >= cur | nn), key=len)
                grafted = False
                while cur != meet and nn != meet and self.sibling(nn) != cur:
                    s = self.score(cur, nn)
                    if not s > self.own(self.parent(nn)):
                        nn = self.parent(nn)
                    elif not s > self.own(self.parent(cur)):
                        cur = self.parent(cur)
                    else:
                        moved = self.out(nn)
                        self.beside(cur, nn)
                        self.nodes |= moved
                        cur, grafted = cur | nn, True
                        break
                if not grafted:
                    cur = meet
            barred |= cur - before


@pytest.mark.parametrize("seed", range(6))
def test_grafting_follows_the_stated_walk(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.6, size=(9, 2)) for c in ((0, 0), (3, 1), (0, 4))])[rng.permutation(27)]
    plain, made = PlainTree(x), online.OnlineTree(LINKAGES["centroid"]())
    for i, v in enumerate(x):
        plain.insert(i)
        made.insert(v, str(i))
        t = made.tree
        got = {frozenset(int(t.pid[k]) for k in t.leaves(n)) for n, p in enumerate(t.parent) if p != -2}
        assert got == plain.nodes
    assert made.telemetry["tried"] > 0


def test_box_rotations_follow_the_bounds():
    x = np.random.default_rng(3).normal(size=(200, 3))
    made = online.BoxTree(LINKAGES["centroid"](), exact=10)
    for i, v in enumerate(x):
        made.insert(v, str(i))
    t = made.tree
    for k in range(len(t.parent)):
        p = t.parent[k]
        if p < 0 or t.parent[p] < 0:
            assert not made.masked(k) and not made.balances(k)
            continue
        s, a = t.sibling(k), t.sibling(p)
        of = lambda n: x[[int(t.pid[i]) for i in t.leaves(n)]]

        def bounds(m, n):
            d = np.linalg.norm(of(m)[:, None] - of(n)[None], axis=2)
            if len(of(m)) <= 10 and len(of(n)) <= 10:
                return d.min(), d.max()
            lo, hi = made.span(m, n)
            assert lo <= d.min() + 1e-9 and hi >= d.max() - 1e-9
            return lo, hi

        assert made.masked(k) == (bounds(k, a)[1] < bounds(k, s)[0])
        size = lambda n: len(of(n))
        evens = abs(size(s) - size(k) - size(a)) < abs(size(p) - size(a))
        assert made.balances(k) == (evens and bounds(k, s)[1] > bounds(k, a)[0])
    assert made.telemetry["balanced"] > 0


def test_beam_search_of_a_box_tree_is_near_the_exact_one():
    x = np.random.default_rng(6).normal(size=(150, 3))
    made = online.BoxTree(LINKAGES["centroid"]())
    for i, v in enumerate(x):
        made.insert(v, str(i))
    q = np.random.default_rng(7).normal(size=(60, 3))
    exact = [made.nearest(v) for v in q]
    made.beam = 6
    assert np.mean([made.nearest(v) == k for v, k in zip(q, exact)]) >= 0.9
    made.beam = 1000
    assert [made.nearest(v) for v in q] == exact


def test_preset_neighbours_and_collapsed_trees():
    x = np.random.default_rng(1).normal(size=(30, 2))
    made, counts = online.build([(v, i, None, i - 1 if i else None) for i, v in enumerate(x)], "greedy", LINKAGES["centroid"]())
    # Each point stands beside the point before it: a chain of the order.
    depth = {made.pid[k]: len([*made.above(k)]) for k, c in enumerate(made.child) if c is None}
    assert depth[0] < depth[28] == depth[29] and counts["looked"] == 0


def _table(spark, edges, leaves, scores):
    parent = dict(edges)
    nodes = sorted({*parent, *parent.values()})
    return spark.createDataFrame([(n, parent.get(n), scores.get(n), n in leaves, leaves.get(n)) for n in nodes], "node long, parent long, score double, is_leaf boolean, label string")


def test_marked_chains_end_at_the_first_gap(spark):
    t = _table(spark, [(1, 5), (2, 5), (3, 6), (5, 6), (4, 7), (6, 7)], dict.fromkeys((1, 2, 3, 4), "a"), {})
    up = trees_sql.closure(t)
    cut = lambda m: dict(map(tuple, trees_sql.marker_cut(up, t, t.where(F.col("node").isin(m))).collect()))
    assert cut([5, 6, 7]) == {1: 7, 2: 7, 3: 7, 4: 7} and cut([5]) == {1: 5, 2: 5, 3: 3, 4: 4}
    assert cut([6, 7]) == {1: 1, 2: 2, 3: 7, 4: 7} and cut([0]) == {k: k for k in (1, 2, 3, 4)}
    broken = trees_sql.broken_marks(up, t.where("node in (6, 7)"), t).collect()
    assert sorted(map(tuple, broken)) == [(5, 6), (5, 7)]


def test_sweep_finds_what_cuts_attain(spark):
    rng = np.random.default_rng(13)
    x, labels = rng.normal(size=(24, 2)), rng.integers(0, 3, 24).astype(str).tolist()
    tree, _ = online.build([(v, str(i), labels[i]) for i, v in enumerate(x)], "graft", LINKAGES["centroid"]())
    rows = tree.rows()
    t = spark.createDataFrame(rows[["node", "parent", "score", "is_leaf", "label"]].astype(object).where(rows.notna(), None).values.tolist(), "node long, parent long, score double, is_leaf boolean, label string")
    up = trees_sql.closure(t)
    splits = trees_sql.split_counts(trees_sql.class_counts(up, t), t)
    gt = sum(n * (n - 1) / 2 for n in rows.loc[rows["is_leaf"], "label"].value_counts())
    for r in trees_sql.threshold_sweep(trees_sql.cut_values(up, t, splits), gt).collect():
        part = trees_sql.threshold_cut(up, t, r.t).join(t.select(F.col("node").alias("leaf"), "label"), "leaf")
        m = metrics.pairwise_f1(metrics.pair_counts(metrics.contingency(part, "cluster", "label"))).first()
        assert (m.tp, m.fp) == (r.tp, r.fp) and m.f1 == pytest.approx(r.f1)


# Entities and runs ----------------------------------------------------------------------------------


def plain_entity_tree(scores, attrs, weights, bias):
    """Exact clustering by the features as they are stated, over sets of mentions."""
    groups, made = [(frozenset([i]), None) for i in range(len(attrs))], {}
    while len(groups) > 1:
        best = None
        for (a, ea), (b, eb) in itertools.combinations(groups, 2):
            fn = set().union(*(attrs[i].get("fn", []) for i in a | b))
            ca = set().union(*(attrs[i].get("ca", []) for i in a | b))
            e = sorted(1.0 if v is None else v for v in (ea, eb))
            f = {"my_pw": max(scores[i, j] for i in a for j in b), "child_e_min": e[0], "child_e_max": e[1], "one_fn": float(len(fn) == 1), "gt1_fn": float(len([v for v in fn if len(v) > 1]) > 1), "ca_ratio": len(ca) / len(a | b)}
            s = sum(weights.get(k, 0.0) * v for k, v in f.items()) + bias
            if best is None or s > best[0]:
                best = s, a, b
        s, a, b = best
        made[a | b] = s
        groups = [g for g in groups if g[0] not in (a, b)] + [(a | b, s)]
    return made


def test_learned_merges_see_the_merged_attributes():
    rng = np.random.default_rng(17)
    n = 12
    scores = rng.normal(size=(n, n))
    scores = scores + scores.T
    attrs = [{"fn": [f"name{rng.integers(3)}"], "ca": [f"c{rng.integers(5)}", f"c{rng.integers(5)}"]} for _ in range(n)]
    weights = {"my_pw": 1.0, "child_e_min": 0.3, "child_e_max": -0.2, "gt1_fn": -1.5, "one_fn": 0.4}
    link = entities.EntityScores(scores, attrs, model="base_plus_name", weights=weights, bias=0.1)
    tree = hac.exact([(np.zeros(1), str(i), None) for i in range(n)], link)
    got = {frozenset(int(tree.pid[k]) for k in tree.leaves(i)): s for i, s in enumerate(tree.score) if s is not None}
    want = plain_entity_tree(scores, attrs, weights, 0.1)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    # n - 1 merges; a merge scores the new root against all others.
    assert link.computations == n * (n - 1) // 2 + sum(range(1, n - 1))


def test_history_features_and_names():
    link = entities.EntityScores(np.array([[0, 2.0, 1], [2, 0, 3], [1, 3, 0]]), [{}, {}, {}], [[0.0], [2.0], [5.0]], model="sub_ent")
    a, b, c = (link.leaf(np.zeros(1), k) for k in range(3))
    ab = link.merge(a, b) | {"score": 0.5}
    f = link.features(ab, c)
    assert (f["my_pw"], f["pw_min"], f["pw_max"], f["pw_mean"]) == (3.0, 2.0, 3.0, 5 / 3) and (f["es_min"], f["es_mean"]) == (0.5, 0.5 / 3)
    assert f["title_diameter"] == 5.0 and f["size_difference"] == -1.0 and (f["child_e_min"], f["child_e_max"]) == (0.5, 1.0)
    assert entities.feature_names("base_plus_name_plus_title") == ["one_fn", "gt1_fn", "gt1_mn", "gt1_mi", "my_pw", "new_edges", "child_e_min", "child_e_max", "title_diameter"]


def test_run_of_vectors_from_settings(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, size=(8, 2)) for c in (0, 4, 9)])
    lines = ["\t".join([f"p{i:02d}", str(i // 8), *map(str, v)]) for i, v in enumerate(x)]
    spark.createDataFrame([(v,) for v in lines], "value string").write.text(f"file://{tmp_path}/points")
    for scheme in ("ehac", "mini_batch", "graft", "rotate", "box", "facility"):
        c = Config.of({"points": f"file://{tmp_path}/points", "clustering_scheme": scheme, "linkage": "average" if scheme == "ehac" else "centroid", "partition_threshold": -1.5, "random_order": True})
        r = run(spark, c, f"file://{tmp_path}/{scheme}").collect()
        assert len(r) == 1 and r[0].n_mentions == 24 and r[0].best_f1 >= r[0].f1
        if scheme in ("ehac", "graft"):
            assert r[0].f1 == pytest.approx(1.0)
        tree = tables.read_clusters(spark, f"file://{tmp_path}/{scheme}/tree")
        gold = {v.mid: v.cluster for v in tables.read_clusters(spark, f"file://{tmp_path}/{scheme}/gold").collect()}
        assert tree.count() == 47 and gold == {f"p{i:02d}": str(i // 8) for i in range(24)}
        again = Config.of(__import__("json").loads("\n".join(v.value for v in spark.read.text(f"file://{tmp_path}/{scheme}/config").collect())))
        assert again.clustering_scheme == scheme and again.partition_threshold == -1.5
    with pytest.raises(ValueError):
        run(spark, Config.of({"points": f"file://{tmp_path}/points", "clustering_scheme": "none"}))


def test_models_are_saved_and_loaded(spark, tmp_path):
    fitted = {"pair": {"model": "email", "weights": {"em_overlap": 2.0}, "bias": -1.0}, "merge": None}
    training.save(spark, fitted, f"file://{tmp_path}/model")
    assert training.load(spark, f"file://{tmp_path}/model") == fitted


def test_cosine_average_keeps_a_matrix_and_not_a_heap_of_pairs():
    x = np.random.default_rng(3).normal(size=(300, 6))
    x[7] = 0
    slow, fast = hac.mini_batch(points(x), LINKAGES["cosine_average"](), 300), hac.exact(points(x), LINKAGES["cosine_average"]())
    assert slow.child == fast.child and [s for s in slow.score if s is not None] == pytest.approx([s for s in fast.score if s is not None])
    tracemalloc.start()
    hac.exact(points(x), LINKAGES["cosine_average"]())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * 300 * 300
