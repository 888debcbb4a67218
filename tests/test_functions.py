"""Functions, features, sources and metrics on fixtures worked out by hand."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import aggregates as A
from cladeframe.functions import features as X
from cladeframe.functions import scalar as S
from cladeframe.operators import baselines, components, metrics, pair_blocks, pairs
from cladeframe.plans.config import Config
from cladeframe.sources import sinks, tables


def one(spark, **columns):
    return list(spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first())


def strings(*values):
    return F.array(*map(F.lit, values)).cast("array<string>") if values else F.array().cast("array<string>")


def test_set_functions(spark):
    got = one(spark, a=S.set_cosine(strings("a", "b"), strings("b", "c")), b=S.set_cosine(strings("a", "b", "c"), strings("a", "b", "c")),
              c=S.set_cosine(strings(), strings("a")), d=S.jaccard(strings("a", "b"), strings("b", "c")), e=S.overlap(strings("a"), strings("b")))
    assert got == pytest.approx([0.25, 1 / 3, 0.0, 1 / 3, 0.0])


def test_vector_functions(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    got = one(spark, n=S.norm(v(3, 4)), d=S.difference_norm(v(1, 1), v(4, 5)), near=S.box_min_distance(v(0, 5), v(1, 1), v(2, 2)),
              far=S.box_max_distance(v(0, 5), v(1, 1), v(2, 2)), cos=S.cosine(v(1, 0), v(1, 1)), zero=S.cosine(v(0, 0), v(1, 1)), relu=S.relu(F.lit(-2.0)), s=S.expit(F.lit(0.0)))
    assert got == pytest.approx([5, 5, np.hypot(1, 3), np.hypot(2, 4), 1 / np.sqrt(2), 0, 0, 0.5])


def attrs(**kv):
    return F.map_from_arrays(strings(*kv), F.array(*[strings(*v) for v in kv.values()])) if kv else F.expr("map()").cast("map<string,array<string>>")


@pytest.mark.parametrize("a,b,want", [
    ({"fn": ["john"]}, {"fn": ["john"]}, [1, 0, 0, 0, 0, 0, 0, 1]),
    ({"fn": ["j"], "mn": ["a"]}, {"fn": ["john"], "mn": ["a"]}, [0, 0, 0, 0, 0, 1, 0, 0]),
    ({"fn": ["j"]}, {"fn": ["j"], "mn": ["b"]}, [0, 1, 0, 0, 1, 0, 1, 0]),
    ({"fn": ["john"], "mn": ["alan"]}, {"fn": ["jane"], "mn": ["amy"]}, [0, 0, 1, 1, 1, 1, 0, 0]),
])
def test_name_features(spark, a, b, want):
    assert one(spark, **X.name_features(attrs(**a), attrs(**b))) == pytest.approx(want)


def test_pair_models_have_their_widths(spark):
    widths = {m: len(X.pair_features(m)) for m in X.PAIR_MODELS}
    assert widths["base"] == 15 and widths["pubmed"] == 16 and widths["name"] == 8 and widths["mesh"] == 1


def test_merge_models(spark):
    f = X.merge_features("base_sub_ent", my_pw=F.lit(0.7), child1=F.lit(None).cast("double"), child2=F.lit(0.2))
    assert one(spark, **f) == pytest.approx([0.7, 0.0, 0.2, 1.0])
    assert one(spark, **X.merge_features("line", my_pw=F.lit(0.5), n1=F.lit(3), n2=F.lit(5))) == pytest.approx([0.5, -2.0])
    e = X.entity_name(attrs(fn=["john", "jane"], mn=["a", "b"]))
    assert one(spark, **e) == pytest.approx([0, 1, 0, 1])


def test_network_score(spark):
    f = {"x": F.lit(1.0), "y": F.lit(-2.0)}
    got = one(spark, s=X.mlp_score(f, [[1, 0], [0, 1]], [0, 0.5], [2, 3], 0.25), l=X.linear_score(f, {"x": 2, "y": 1}, 0.5))
    assert got == pytest.approx([2 * np.tanh(1) + 3 * np.tanh(-1.5) + 0.25, 0.5])


def test_mentions(spark):
    lines = [
        {"id": "1", "attrs": ["fn:john", "t:a:b", "bad", ":x", "fn:", "fn:john", "fn:jon"], "pack": [], "gt": "g1"},
        {"id": "2", "attrs": [], "gt": "None", "gt-dblp": "g2"}, {"id": "3", "attrs": None, "gt": "None"},
    ]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines] + [("not json",)], "value string")
    got = {r["mid"]: r for r in tables.mentions(df).collect()}
    assert got["1"]["attrs"] == {"fn": ["john", "jon"], "t": ["a:b"]} and got["1"]["gt"] == "g1"
    assert got["2"]["gt"] == "g2" and got["3"]["gt"] is None and got["3"]["attrs"] == {} and set(got) == {"1", "2", "3"}
    assert tables.mentions(df, skip_unlabeled=True).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("p1\tl\t1\t2.5\np2\tm\t-1\t0\n")
    assert [(r.pid, r.vec) for r in tables.read_vectors(spark, f"file://{tmp_path}/v.tsv").orderBy("pid").collect()] == [("p1", [1.0, 2.5]), ("p2", [-1.0, 0.0])]
    (tmp_path / "p.tsv").write_text("{}\t{}\t1\nbroken\n")
    assert sorted(r.bad for r in tables.read_labelled_pairs(spark, f"file://{tmp_path}/p.tsv").collect()) == [False, True]
    (tmp_path / "n.tsv").write_text("a\tnone\nb\ta\n")
    assert sorted(map(tuple, tables.read_neighbours(spark, f"file://{tmp_path}/n.tsv").collect())) == [("a", None), ("b", "a")]


@pytest.mark.parametrize("levels,want", [(3, [0, 1, 3, 4]), (4, [0, 1, 3, 4, 7, 8, 10, 11])])
def test_separated_line(spark, levels, want):
    rows = sorted((r.vec[0], r.label) for r in tables.separated_line(spark, levels).collect())
    assert [x for x, _ in rows] == want and [y for _, y in rows] == ["1"] * (len(want) // 2) + ["2"] * (len(want) // 2)


def test_flat_metrics(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "b"), (5, "y", None)], "mid int, c string, l string")
    cells = metrics.contingency(df, "c", "l")
    p = metrics.pairwise_f1(metrics.pair_counts(cells)).first()
    assert (p.tp, p.fp, p.gt, p.precision, p.recall, p.f1) == pytest.approx((1, 2, 2, 1 / 3, 0.5, 0.4))
    b = metrics.b_cubed(cells).first()
    assert (b.precision, b.recall, b.f1) == pytest.approx((2 / 3, 3 / 4, 12 / 17))
    bl = metrics.blanc(cells).first()
    assert bl.precision == pytest.approx((1 / 3 + 2 / 3) / 2) and bl.recall == pytest.approx((1 / 2 + 2 / 4) / 2)


def test_merge_precision(spark):
    df = spark.createDataFrame([("m", "a"), ("m", "a"), ("m", "a"), ("m", "b"), ("m", None)], "g string, l string")
    r = metrics.merge_precision(df, "g", "l").first()
    assert (r.tp, r.fp, r.precision) == (3, 3, 0.5)


def test_baselines(spark):
    df = spark.range(1).select(attrs(fn=["John"], mn=["Alan"], ln=["Smith"]).alias("attrs"), F.lit("c").alias("canopy"))
    r = df.select(*[c.alias(k) for k, c in baselines.keys().items()]).first()
    assert list(r) == ["c", "c|j|a|smith", "c|john|alan|smith", "c|j|smith", "c|john|smith"]


def test_components_and_forest(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 60, 70), rng.integers(0, 60, 70), rng.random(70))] + [(100 + i, 101 + i, 0.5) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long, score double")
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b, _ in edges:
        part[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for e in edges for x in e[:2] if e[0] != e[1]}
    assert {r.id: r.component for r in components.connected_components(df).collect()} == want
    forest = components.spanning_forest(df).collect()
    assert len(forest) == len(want) - len(set(want.values()))
    part, total = {}, 0.0
    for a, b, s in sorted(edges, key=lambda e: -e[2]):
        if root(a) != root(b):
            part[max(root(a), root(b))] = min(root(a), root(b))
            total += s
    assert sum(r.score for r in forest) == pytest.approx(total)


def test_token_set_join_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = rng.integers(0, 6)
        rows.append((i, "c" + str(i % 2), sorted({f"w{base}_{j}" for j in rng.choice(12, rng.integers(5, 12), replace=False)})))
    rows.append((60, "c0", []))
    df = spark.createDataFrame(rows, "mid long, canopy string, tokens array<string>")
    reps = {}
    for i, c, t in rows:
        if t:
            reps.setdefault((c, tuple(t)), i)
    want = sorted((i, j) for (c, s), i in reps.items() for (e, t), j in reps.items() if c == e and i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.6 - 1e-9)
    got = sorted((r.a, r.b) for r in pairs.token_set_join(df, 0.6).collect())
    assert got == want and len(want) > 5


def test_knn_blocks_agree(spark):
    x = np.random.default_rng(2).normal(size=(50, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pid long, vec array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), r + 1) for i in range(50) for r, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    for block in (1000, 17):
        assert {(r.pid, r.nbr, r["rank"]) for r in pairs.knn(df, df, 3, block=block).collect()} == want
    near = {(r.pid, r.nbr) for r in pairs.approximate_knn(df, 1, bucket=4.0, radius=6.0).collect()}
    assert len(near & {(a, b) for a, b, r in want if r == 1}) >= 40


def test_best_cross_pair(spark):
    s = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 4, 0.7), (3, 4, 0.1)], "a long, b long, score double")
    m = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20)], "mid long, group long")
    assert [tuple(r) for r in pairs.best_cross_pair(s, m).collect()] == [(10, 20, 1, 3, 0.9)]


def test_title_vectors(spark):
    titles = spark.createDataFrame([("m", "The Red fox"), ("m", "red"), ("n", "zzz")], "mid string, title string")
    vec = spark.createDataFrame([("red", [1.0, 0.0]), ("fox", [0.0, 4.0])], "w string, vec array<double>")
    idf = spark.createDataFrame([("fox", 2.0)], "w string, idf double")
    r = A.title_vectors(titles, vec, idf, ["the"]).collect()
    assert [x.mid for x in r] == ["m"] and r[0].tes == pytest.approx([2 / np.sqrt(8), 2 / np.sqrt(8)]) == r[0].tea


def test_config_and_drawing(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"nn_k": 3, "mystery": 1}')
    c = Config.load(str(tmp_path / "c.json"))
    assert c.nn_k == 3 and c.other == {"mystery": 1} and len(c.grid(linkage=["single", "average"], graft=[True, False])) == 4
    assert json.loads(c.json())["mystery"] == 1
    g = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    assert sinks.dot_graph(g).count("--") == 2 and sinks.dot_graph(g, limit=1) is None
    assert sinks.plain_json({"a": 1, "f": print}) == {"a": 1}


def test_token_sets_of_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(260):
        words = base if i % 10 == 0 else [w for w in base if rng.random() > 0.08] + [f"x{i}"]
        rows.append((i, None if i == 7 else "en" if i % 13 else "de", words))
    rows += [(900, "en", []), (901, "en", None), (902, None, base)]
    df = spark.createDataFrame(rows, "mid long, canopy string, tokens array<string>")
    sets = {i: (c, set(t)) for i, c, t in rows if t and c}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and rep[a] == a and rep[b] == b and sets[a][0] == sets[b][0]:
                x, y = sets[a][1], sets[b][1]
                if len(x & y) >= 0.8 * len(x | y) - 1e-9:
                    want[a, b] = (len(x & y), len(x), len(y))
    got = pairs.token_set_join(df, 0.8)
    assert {(r.a, r.b): (r.common, r.na, r.nb) for r in got.collect()} == want and len(want) > 5000
    assert {r.mid: r.rep for r in pairs.copies(df).collect()} == {i: rep.get(i, i) for i, _, _ in rows}


def test_values_go_to_blocks_of_pairs_and_not_to_each_pair(spark):
    cand = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    values = spark.createDataFrame([(i, i * i) for i in range(70)], "k long, v long")

    def work(p, v):
        return pa.table({"n_pairs": pa.array([p.num_rows]), "n_values": pa.array([v.num_rows])})

    total = [F.sum("n_pairs"), F.sum("n_values")]
    for dealt, most in ((pairs._by_hash(cand, 3), 5), (pairs._by_group(cand, 3, 10), 5), (pairs._by_group(cand, 3, 100), 1)):
        got = pairs._in_blocks(dealt, values, work, "n_pairs long, n_values long").agg(*total).first()
        assert got[0] == 60 * 59 / 2 and 60 <= got[1] <= 60 * most


def test_places_of_keys_pass_the_driver_only_where_they_are_few(spark, monkeypatch):
    """the places of all candidates were broadcast, by their number of keys and not of places."""
    cand = spark.createDataFrame([(a, b) for a in range(60) for b in range(a + 1, 60)], "a long, b long")
    values = spark.createDataFrame([(i, i * i) for i in range(70)], "k long, v long")

    def work(p, v):
        a, b = pairs._places(p, v)
        return pa.table({"a": p["a"], "b": p["b"], "v": pa.array(v["v"].to_numpy()[a] + v["v"].to_numpy()[b])})

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    want, schema = {(a, b, a * a + b * b) for a in range(60) for b in range(a + 1, 60)}, "a long, b long, v long"
    for most in (1000, 100):  # 60 keys have 5 places each
        monkeypatch.setattr(pairs, "PLACES", most)
        got = pairs._in_blocks(pairs._by_hash(cand, 3), values, work, schema)
        assert ("BroadcastHashJoin" in plan(got)) == (most == 1000) and {tuple(r) for r in got.collect()} == want
    for blocks in (1, 2, 7):
        got = pairs._between_blocks(cand, values, work, schema, blocks)
        assert "Join" not in plan(got) and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_sketches_go_to_few_blocks(spark, monkeypatch):
    """sketches went to as many blocks as full sets, and to more the more there were."""
    seen, between = [], pairs._between_blocks
    monkeypatch.setattr(pairs, "SETS", 8)
    monkeypatch.setattr(pairs, "_between_blocks", lambda *a: seen.append(a[-1]) or between(*a))
    rows = [(i, "c", [f"w{i // 2}_{j}" for j in range(9)] + [f"x{i}"]) for i in range(60)]
    df = spark.createDataFrame(rows, "mid long, canopy string, tokens array<string>")
    assert {(r.a, r.b) for r in pairs.token_set_join(df, 0.8).collect()} == {(i, i + 1) for i in range(0, 60, 2)}
    assert seen == [5]


def test_components_compute_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def edge(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (4, 4)], "a long, b long").mapInArrow(edge, "a long, b long")
    assert {(r.id, r.component) for r in components.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    assert seen.value == 4


def test_many_labels_of_components_do_not_pass_the_driver(spark, monkeypatch):
    """labels were broadcast by the size of their compressed files, three times a round."""
    kind, seen = type(spark.range(1)), []
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda *a: seen.append(join(*a)) or seen[-1])
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i % 20 != 19], "a long, b long")
    for most in (1000, 10):
        monkeypatch.setattr(components, "LABELS", most)
        seen.clear()
        assert {(r.id, r.component) for r in components.connected_components(e).collect()} == {(i, i // 20 * 20) for i in range(60)}
        assert any("BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in seen[:3]) == (most == 1000)


def test_features_of_blocks_are_those_of_the_expressions(spark):
    rng = random.Random(8)
    keys = ["fn", "mn", "ca", "t", "y", "em", "v", "vw", "i", "k", "mt", "r", "lda", "fil", "d"]
    some = {"fn": ["j", "jo", "al", "a"], "mn": ["b", "bo", "bert"], "ca": ["p q", "r q", "s", "t  u "], "y": ["1999", "2003", "x"], "d": ["1.25", "-3.5", "none"]}
    rows = []
    for i in range(40):
        attrs = {k: rng.sample(some.get(k, ["u", "v", "w", "x"]), rng.randint(0, 3)) for k in keys if rng.random() < 0.8}
        rows.append((i, rng.choice(["de", "en", None]), attrs))
    df = spark.createDataFrame(rows, "mid long, canopy string, attrs map<string,array<string>>")
    models = list(X.PAIR_MODELS)
    found = {}
    for m in models:
        found |= X.pair_features(m, "a_attrs", "b_attrs")
    p = pairs.canopy_pairs(df).select("a_mid", "b_mid", *[c.alias(k) for k, c in found.items()])
    want = {(r.a_mid, r.b_mid): r.asDict() for r in p.collect()}
    got = pair_blocks.feature_rows(df, models, digits=None)
    assert got.columns == ["a", "b", *found]
    for block in (700, 6):
        seen = pair_blocks.feature_rows(df, models, digits=None, block=block).collect()
        assert len(seen) == len(want) > 200
        for r in seen:
            w = want[r.a, r.b]
            assert {k: w[k] if k == "d_near" and w[k] is None else pytest.approx(w[k]) for k in found} == {k: r[k] for k in found}
    same = df.withColumn("attrs", F.map_filter("attrs", lambda k, _: k.isin("fn", "mn")))
    counts = pair_blocks.feature_counts(same, "name", F.array_join(S.items("attrs", "fn"), "/"))
    assert counts.agg(F.sum("n")).first()[0] == len(want) and counts.where("fn_match > 0").agg(F.sum("n")).first()[0] == sum(w["fn_match"] > 0 for w in want.values())


def test_mentions_go_to_few_parts_and_are_compared_in_blocks(spark, monkeypatch):
    """a mention went to as many tasks as its canopy has blocks; mentions of one id are no pair in any block."""
    seen, repartition = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: seen.append(df) or repartition(df, *a))
    rows = [(i % 190, "c", {"em": [f"e{i % 7}"]}) for i in range(200)] + [(500, "d", {}), (501, None, {})]
    df = spark.createDataFrame(rows, "mid long, canopy string, attrs map<string,array<string>>")
    ends = [(m, attrs["em"]) for m, _, attrs in rows[:200]]
    want = sorted((min(a, b), max(a, b), float(x == y)) for k, (a, x) in enumerate(ends) for b, y in ends[k + 1 :] if a != b)
    for most, times in ((20_000, 6), (13, 16)):  # of 20 blocks
        monkeypatch.setattr(pair_blocks, "DEALT", most)
        got = pair_blocks.feature_rows(df, ["email"], block=10)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert seen[-1].count() == 200 * times
