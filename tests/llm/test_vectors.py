import random
from collections import defaultdict

import numpy as np
import pytest

from photosluice.llm import density_clusters as dc
from photosluice.llm.coverage import components, cover_by_rounds, kinds, pick_varied
from photosluice.llm.learned_partitions import PartitionModel, balanced_partition, fit_layer, fit_partitions, neighbour_graph
from photosluice.llm.neighbours import neighbour_pairs, similar_vectors
from photosluice.llm.vectors import pack, unit, unpack, usable_rows

from .conftest import clustered

DIRTY = [None, [], [1.0] * 32, [0.0] * 64, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [None] + [1.0] * 63]


def usable(rows):
    return [k for k, r in enumerate(rows) if r is not None and len(r) == 64 and all(x is not None and np.isfinite(x) for x in r) and any(r)]


def brute_pairs(ids, rows, k=5, least=0.86):
    once = {}
    for i, r in zip(ids, rows):
        once.setdefault(i, r)
    at = usable(list(once.values()))
    names = [list(once)[a] for a in at]
    x = np.array([list(once.values())[a] for a in at], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = u @ u.T
    out = set()
    for i in range(len(names)):
        near = sorted((-round(sims[i, j], 6), names[j]) for j in range(len(names)) if j != i and sims[i, j] >= least)[:k]
        out |= {(min(names[i], n), max(names[i], n)) for _, n in near}
    return out


def data(seed, sizes):
    x = clustered(seed, sizes)
    rng = random.Random(seed)
    rows = [list(map(float, r)) for r in x]
    rows += [rows[0]] * 9 + [[2 * v for v in rows[1]]] * 2  # copies, and the same direction at another length
    rows += DIRTY
    ids = [f"{rng.randrange(10**9):09}-{k}" for k in range(len(rows))]
    order = list(range(len(rows)))
    rng.shuffle(order)
    ids, rows = [ids[k] for k in order], [rows[k] for k in order]
    return ids + ids[:20], rows + rows[:20]  # delivered again


def test_packing_round_trip():
    x = np.random.default_rng(0).normal(size=(7, 64)).astype(np.float32)
    assert (unpack(pack(x)) == x).all() and (unpack(pack(x).slice(2, 3)) == x[2:5]).all()
    assert len(unpack(pack(x[:0]))) == 0


def test_usable_rows():
    import pyarrow as pa

    rows = [*DIRTY, [1.0] * 64]
    at, x = usable_rows(pa.array(rows, pa.list_(pa.float32())))
    assert at.tolist() == [len(rows) - 1] and x.shape == (1, 64)
    big = unit(np.array([[3e38] * 64, [1e-38] * 64], np.float32))
    assert np.allclose(np.linalg.norm(big, axis=1), 1)


def test_partition_is_balanced_and_learned():
    x = unit(clustered(3, [10] * 40, alone=200)).astype(np.float32)
    graph = neighbour_graph(x, 10)
    label = balanced_partition(x, graph, 6, np.random.default_rng(1))
    assert np.bincount(label, minlength=6).max() <= 1.15 * len(x) / 6 + 1
    layer = fit_layer(x, 6)
    own = layer.log_probabilities(x).argmax(1)
    assert np.mean(own == fit_layer(x, 6).log_probabilities(x).argmax(1)) == 1  # the same every time
    groups = own[:400].reshape(40, 10)
    together = np.mean([(g == np.bincount(g).argmax()).mean() for g in groups])
    assert together > 0.8


@pytest.mark.parametrize("per_partition, fanout", [(10**6, 256), (60, 256), (20, 4)])
def test_neighbours_against_brute_force(spark, vectors, per_partition, fanout):
    ids, rows = data(7, [12, 30, 5, 5, 4, 3, 3, 2, 2, 60])
    df = vectors(ids, rows)
    model = fit_partitions(df, "asset_id", "embedding", per_partition, 2.5, fanout=fanout)
    if fanout == 4:
        assert model.below and model.partitions > 4
    got = {(r["asset_a"], r["asset_b"]) for r in neighbour_pairs(df, model=model).collect()}
    want = brute_pairs(ids, rows)
    if per_partition == 10**6:
        assert got == want
    else:
        assert len(got & want) >= 0.9 * len(want)


def test_neighbours_of_nothing(spark, vectors):
    assert similar_vectors(vectors([], [])).count() == 0
    assert similar_vectors(vectors([f"{k}" for k in range(len(DIRTY))], DIRTY)).count() == 0
    assert similar_vectors(vectors([None, None], [[1.0] * 64] * 2)).count() == 0


def test_ties_go_to_smaller_ids(spark, vectors):
    ids = [f"{k:02}" for k in range(9)]
    got = similar_vectors(vectors(ids, [[1.0] * 64] * 9)).collect()
    of = defaultdict(list)
    for r in sorted(got, key=lambda r: r["place"]):
        of[r["id"]].append(r["neighbour"])
    assert of["08"] == ["00", "01", "02", "03", "04"] and of["02"] == ["00", "01", "03", "04", "05"]


def groups_of(ids, rows, least=0.86):
    once = {}
    for i, r in zip(ids, rows):
        once.setdefault(i, r)
    at = usable(list(once.values()))
    names = np.array([list(once)[a] for a in at])
    label = components(np.array([list(once.values())[a] for a in at], np.float64), least)
    by = defaultdict(list)
    for n, c in zip(names, label):
        by[c].append(str(n))
    return {(min(g), i) for g in by.values() if len(g) >= 3 for i in g}


@pytest.mark.parametrize("params", [{}, {"rows_per_partition": 60}, {"tree_most": 8, "small": 0}])
def test_clusters_are_groups(spark, vectors, params):
    ids, rows = data(5, [12, 30, 5, 4, 3, 3, 2, 40])
    got = {(r["cluster_key"], r["id"]) for r in dc.density_clusters(vectors(ids, rows), mutual=True, **params).collect()}
    want = groups_of(ids, rows)
    if "rows_per_partition" in params:
        assert len(got & want) >= 0.9 * len(want)
    else:
        assert got == want


def test_clusters_of_nothing(spark, vectors):
    assert dc.density_clusters(vectors([], [])).count() == 0
    assert dc.density_clusters(vectors(list("abcdefg"), DIRTY)).count() == 0
    three = dc.density_clusters(vectors(list("abc"), [[1.0] * 64] * 3)).collect()
    assert {(r["cluster_key"], r["id"], r["size"]) for r in three} == {("a", x, 3) for x in "abc"}


def kruskal(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = set()
    for w, a, b in sorted((w, a, b) for a, b, w in edges):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.add((a, b))
    return out


@pytest.mark.parametrize("small", [0, 30, 10**6])
def test_spanning_forest(spark, small):
    rng = random.Random(small)
    edges = {(a, b): rng.randrange(9) / 8 for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a < b}
    rows = [(a, b, w) for (a, b), w in edges.items()]
    tree, nodes = dc.spanning_forest(spark.createDataFrame(rows, "a long, b long, w double"), small)
    assert {(r["a"], r["b"]) for r in tree.collect()} == kruskal(rows)
    roots = {r["h"]: r["root"] for r in nodes.collect()}
    assert all(roots[a] == roots[b] for a, b in edges) and set(roots) == {x for e in edges for x in e}


def test_condensed_hierarchy():
    # two groups of four at 0.01 and 0.02, joined at 0.1; one record at 0.12
    a = [0, 0, 0, 4, 4, 4, 0, 0]
    b = [1, 2, 3, 5, 6, 7, 4, 8]
    w = [0.01, 0.01, 0.01, 0.02, 0.02, 0.02, 0.1, 0.12]
    label, leave = dc.condensed(a, b, w, [1] * 9, 0.14, 3, 0.0)
    assert len(set(label[:4])) == len(set(label[4:8])) == 1 and label[0] != label[4] and label[8] == -1
    assert leave[0] > leave[4] > leave[8]
    whole, _ = dc.condensed(a, b, w, [1] * 9, 0.14, 3, 0.14)
    assert whole == [0] * 9
    assert dc.condensed([], [], [], [2], 0.14, 3, 0.14)[0] == [-1]


def test_exemplars(spark, vectors):
    ids, rows = data(5, [12, 6])
    df = vectors(ids, rows)
    from pyspark.sql import functions as F

    found = dc.exemplars(dc.density_clusters(df), df.select(F.col("asset_id").alias("id"), F.lit(0.5).alias("score")).distinct()).collect()
    by = defaultdict(list)
    for r in found:
        by[r["cluster_key"]].append(r["place"])
    assert all(sorted(p) == [0, 1, 2] for p in by.values()) and len(by) >= 2


def varied_model(requests, members, assets, least=0.86):
    out = set()
    for rid, pool, size in requests:
        names = sorted({a for p, a in members if p is not None and p == pool and a in assets})
        keep = [n for n in names if usable([assets[n][0]])]
        if not keep:
            continue
        label = components(np.array([assets[n][0] for n in keep], np.float64), least)
        eff = lambda n: 0.0 if assets[n][1] is None or assets[n][1] != assets[n][1] else min(1.0, max(0.0, assets[n][1]))
        by = defaultdict(list)
        for n, c in zip(keep, label):
            by[c].append(n)
        ranked = [(place, -eff(n), n) for g in by.values() for place, n in enumerate(sorted(g, key=lambda n: (-eff(n), n)))]
        out |= {(rid, n) for _, _, n in sorted(ranked)[: size or 0]}
    return out


@pytest.mark.parametrize("pool_most", [8000, 10])
def test_varied_subset_against_a_model(spark, pool_most):
    rng = random.Random(2)
    x = [list(map(float, r)) for r in clustered(9, [8, 5, 5, 3, 2], alone=12)] + DIRTY
    scores = [None, float("nan"), -1.0, 0.5, 0.5, 0.7, 2.0]
    assets = {f"a{k:02}": (v, rng.choice(scores)) for k, v in enumerate(x)}
    members = [(p, a) for p in ("p", "q", "r") for a in assets if rng.random() < 0.8] * 2 + [("p", "gone"), (None, "a00"), ("p", None)]
    requests = [(1, "p", 7), (2, "q", 1), (3, "r", 500), (4, "none", 5), (5, "p", 20), (6, "q", 0), (7, "q", None), (8, None, 3)]
    a = spark.createDataFrame([(i, v, s, "x") for i, (v, s) in assets.items()] * 2, "asset_id string, embedding array<float>, score double, pool string")
    m = spark.createDataFrame([(p, i, 3) for p, i in members], "partition_id string, asset_id string, score int")
    r = spark.createDataFrame(requests, "request_id long, partition_id string, pick_size int")
    got = pick_varied(r, m, a, pool_most=pool_most, rows_per_partition=1000).collect()
    assert len({(x["request_id"], x["asset_id"]) for x in got}) == len(got)
    assert {(x["request_id"], x["asset_id"]) for x in got} == varied_model(requests, members, assets)
    assert pick_varied(r, m.limit(0), a).count() == 0


def test_kinds_follow_chains():
    # each resembles the next only; the whole chain is one kind
    angles = np.arange(5) * 0.5
    rows = np.zeros((5, 64))
    rows[:, 0], rows[:, 1] = np.cos(angles), np.sin(angles)
    assert components(rows[[3, 1, 0, 4, 2]], 0.86).tolist() == [0] * 5
    assert PartitionModel().partitions == 1 and kinds is not None


def greedy_value(features, ids, k):
    held, chosen = defaultdict(float), []
    value = lambda i: sum(np.sqrt(held[f] + m) - np.sqrt(held[f]) for f, m in features[i])
    for _ in range(min(k, len(ids))):
        i = max((i for i in ids if i not in chosen), key=value)
        chosen.append(i)
        for f, m in features[i]:
            held[f] += m
    return sum(np.sqrt(v) for v in held.values())


def test_cover_by_rounds(spark):
    rng = random.Random(3)
    ids = [f"a{k:02}" for k in range(40)]
    features = {i: [(f"f{f}", rng.choice([0.5, 1.0, 2.0])) for f in rng.sample(range(6), rng.randrange(1, 4))] for i in ids}
    items = spark.createDataFrame([("p", i, rng.random()) for i in ids] + [("p", "bare", 1.0)], "pool string, id string, score double")
    rows = [("p", i, f, m) for i, fs in features.items() for f, m in fs] + [("p", "a00", "f0", -1.0)]
    weights = spark.createDataFrame(rows, "pool string, id string, feature string, mass double")
    requests = spark.createDataFrame([(1, "p", 8), (2, "p", 100), (3, "q", 5), (4, "p", 0), (5, None, 2)], "request_id long, pool string, pick_size int")
    got = cover_by_rounds(items, weights, requests).collect()
    by = defaultdict(list)
    for r in got:
        by[r["request_id"]].append(r["id"])
    assert sorted(by[2]) == sorted([*ids, "bare"]) and len(set(by[1])) == len(by[1]) == 8 and set(by) == {1, 2}
    held = defaultdict(float)
    for i in by[1]:
        for f, m in features[i]:
            held[f] += m
    assert sum(np.sqrt(v) for v in held.values()) >= 0.9 * greedy_value(features, ids, 8)


def test_rounds_agree_with_the_closed_form(spark):
    from photosluice.llm.coverage import varied_subset

    rng = random.Random(6)
    rows = [("p", f"a{k:02}", rng.choice([0.1, 0.5, 0.9]), rng.randrange(5)) for k in range(30)]
    items = spark.createDataFrame(rows, "pool string, id string, score double, kind long")
    requests = spark.createDataFrame([(1, "p", 12)], "request_id long, pool string, pick_size int")
    features = items.select("pool", "id", items["kind"].cast("string").alias("feature")).selectExpr("*", "1D as mass")
    a = {r["id"] for r in varied_subset(items, requests).collect()}
    assert a == {r["id"] for r in cover_by_rounds(items, features, requests, epsilon=0.01).collect()}


def brute_hits(x, least=0.86):
    """Similar pairs of distinct unit rows."""
    return {(int(i), int(j)) for s in range(0, len(x), 512) for i, j in np.argwhere(x[s : s + 512] @ x.T >= least) + [s, 0] if i < j}


def met_pairs(model, x):
    """Pairs of rows of which one is stored where the other is stored or sought."""
    row, part, home = model.route(x, np.arange(len(x)))
    out = set()
    for p in np.unique(part):
        r, h = row[part == p], home[part == p]
        sims = x[r[h]] @ x[r].T >= 0.86
        out |= {(int(min(a, b)), int(max(a, b))) for a, b in zip(r[h][np.nonzero(sims)[0]], r[np.nonzero(sims)[1]]) if a != b}
    return out


def test_copies_do_not_take_the_probes_of_others(spark, vectors):
    x = clustered(11, [4] * 400, alone=400, noise=0.4)
    rows = [list(map(float, r)) for r in x] + [list(map(float, x[0]))] * 1000
    random.Random(1).shuffle(rows)
    df = vectors([f"{k:05}" for k in range(len(rows))], rows)
    model = fit_partitions(df, "asset_id", "embedding", 150, 2.3)
    u = unit(x).astype(np.float32)
    assert 1.8 * len(u) < len(model.route(u, np.arange(len(u)))[0]) < 3.2 * len(u)
    want = brute_hits(u)
    assert len(met_pairs(model, u) & want) >= 0.98 * len(want)


def test_near_copies_in_many_partitions_all_meet(spark, vectors):
    x = clustered(12, [1000, *[4] * 300], alone=400, noise=0.35)
    df = vectors([f"{k:05}" for k in range(len(x))], x.tolist())
    model = fit_partitions(df, "asset_id", "embedding", 100, 2.3)
    u = unit(x).astype(np.float32)
    want, met = brute_hits(u), met_pairs(model, u)
    hot = {p for p in want if p[0] < 1000}
    assert len(hot) > 100_000 and hot <= met
    assert len((want - hot) & met) >= 0.98 * len(want - hot)
    got = {(r["asset_a"], r["asset_b"]) for r in neighbour_pairs(df, model=model).collect()}
    exact = brute_pairs([f"{k:05}" for k in range(len(x))], x.tolist())
    assert {p for p in exact if p[0] < "01000"} <= got
    # vectors alone form no dense group
    assert fit_partitions(vectors([f"{k}" for k in range(600)], clustered(1, [], alone=600).tolist()), "asset_id", "embedding", 100, 2.3).dense is None


def test_mean_probes_find_loose_pairs(spark, vectors):
    from photosluice.llm import neighbours

    x = clustered(21, [4] * 2500, alone=2000, noise=0.3)
    df = vectors([f"{k:05}" for k in range(len(x))], x.tolist())
    u = unit(x).astype(np.float32)
    want = brute_hits(u)
    for probes, recall in ((dc.MEAN_PROBES, 0.995), (neighbours.MEAN_PROBES, 0.998)):
        model = fit_partitions(df, "asset_id", "embedding", 600, probes)
        assert len(met_pairs(model, u) & want) >= recall * len(want)


def test_kinds_of_large_pools_are_exact(spark):
    # loose groups, a dense one, chains of it, and copies
    x = np.r_[clustered(31, [2] * 1000, alone=100, noise=0.38), clustered(32, [300], alone=0, noise=0.4)]
    x = np.r_[x, x[:1].repeat(50, 0)]
    rows = [("p", f"{k:04}", 0.5, v) for k, v in enumerate(x.tolist())]
    pools = spark.createDataFrame(rows, "pool string, id string, score double, vec array<float>")
    got, want = defaultdict(set), defaultdict(set)
    for r in kinds(pools, pool_most=100, rows_per_partition=60).collect():
        got[r["kind"]].add(r["id"])
    for k, c in enumerate(components(x, 0.86)):
        want[c].add(f"{k:04}")
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_joining_edges():
    from photosluice.llm.coverage import joining_edges

    rng = np.random.default_rng(4)
    for share in (0.01, 0.2, 0.9):
        mask = rng.random((40, 30)) < share
        mask[:20, :15] |= rng.random((20, 15)) < 0.8
        i, j = joining_edges(mask)
        assert mask[i, j].all() and len(i) <= 2 * 70
        all_i, all_j = np.nonzero(mask)
        parts = []
        for a, b in ((i, j), (all_i, all_j)):
            _, ends, root = dc._union_find(a, b + 40)
            parts.append(dict(zip(ends.tolist(), root.tolist())))
        assert parts[0] == parts[1]


@pytest.mark.parametrize("params", [{}, {"rows_per_partition": 4}])
def test_chains_are_no_groups(spark, vectors, params):
    def at(*angles):
        rows = np.zeros((len(angles), 64))
        rows[:, 0], rows[:, 1] = np.cos(angles), np.sin(angles)
        return rows.tolist()

    # a group of nine, more than the edges that a vector keeps; two tight groups of four joined by a bridge
    group = clustered(3, [9], alone=0).tolist()
    chain = at(0.0, 0.01, 0.02, 0.03, 0.4, 0.8, 0.81, 0.82, 0.83)
    ids = [f"g{k}" for k in range(9)] + [f"h{k}" for k in range(9)]
    df = vectors(ids, group + chain)
    got = {(r["cluster_key"], r["id"]) for r in dc.density_clusters(df, mutual=True, **params).collect()}
    assert got == {("g0", i) for i in ids[:9]}
    by = defaultdict(set)
    for r in dc.density_clusters(df, **params).collect():
        by[r["cluster_key"]].add(r["id"])
    assert by["g0"] == set(ids[:9])
    if not params:
        assert by["h0"] - {"h4"} == {"h0", "h1", "h2", "h3"} and {"h5", "h6", "h7", "h8"} in [g - {"h4"} for g in by.values()]


def on_circle(*angles):
    rows = np.zeros((len(angles), 64))
    rows[:, 0], rows[:, 1] = np.cos(angles), np.sin(angles)
    return rows


@pytest.mark.parametrize("bridge", [0.5, 0.7])
def test_stability_parts_groups_on_a_bridge(spark, vectors, bridge):
    # cosines of 0.88 and 0.76 between the groups: with and without the distance at which records count as similar
    x = on_circle(*[0.02 * k for k in range(5)], *[bridge + 0.08 + 0.02 * k for k in range(5)]).tolist()
    found = dc.density_clusters(vectors([f"a{k}" for k in range(10)], x)).collect()
    by = defaultdict(set)
    for r in found:
        by[r["cluster_key"]].add(r["id"])
    assert dict(by) == {"a0": {f"a{k}" for k in range(5)}, "a5": {f"a{k}" for k in range(5, 10)}}


def hierarchy(x, n, reach, same, min_size, min_samples, epsilon):
    """Clusters of distinct unit rows with ``n`` records each, from all pairs."""
    d = np.maximum(1 - x @ x.T, 0)
    core = []
    for i in range(len(x)):
        order = np.argsort(d[i], kind="stable")
        have = np.cumsum(n[order])
        far = d[i][order][np.argmax(have >= min_samples)] if have[-1] >= min_samples else reach
        core.append(far if far <= reach else same)
    core = np.maximum.outer(core, core)
    w = np.maximum(d, np.where(d <= same, np.minimum(core, same), core))
    edges = [(w[i, j], i, j) for i in range(len(x)) for j in range(i) if d[i, j] <= reach]
    tree, out = kruskal([(min(a, b), max(a, b), v) for v, a, b in edges]), set()
    label, _ = np.arange(len(x)), None
    for a, b in tree:
        label[label == label[b]] = label[a]
    for t in np.unique(label):
        at = np.flatnonzero(label == t)
        lines = sorted((w[a, b], a, b) for a, b in tree if label[a] == t)
        place = {v: k for k, v in enumerate(at.tolist())}
        got, leave = dc.condensed([place[a] for _, a, _ in lines], [place[b] for _, _, b in lines], [v for v, _, _ in lines], n[at].tolist(), reach, min_size, epsilon)
        for c in set(got) - {-1}:
            members = [at[k] for k in range(len(at)) if got[k] == c and leave[k] >= (1 - 1e-9) / same]
            out.add(frozenset(int(m) for m in members))
    return {c for c in out if sum(n[list(c)]) >= min_size}


@pytest.mark.parametrize("parts", [1, 5])
def test_hierarchy_against_all_pairs(spark, vectors, parts, monkeypatch):
    def everywhere(*args, **more):
        model = fit_partitions(*args, **more)
        model.margin, model.max_probes = 1e9, 99
        return model

    monkeypatch.setattr(dc, "fit_partitions", everywhere)
    rng = np.random.default_rng(8)
    x = clustered(21, [9, 8, 7, 6, 5, 4, 3, 2, 2], alone=30, noise=0.3)
    near = x[:9] + 0.35 * rng.normal(size=(9, 64)) / 8  # groups beside groups, beyond the similar
    x = np.concatenate([x, near, near + 0.1 * rng.normal(size=(9, 64)) / 8]).astype(np.float32)
    # ties are broken by vector key
    key = [r[0] for r in spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<float>").orderBy("k").selectExpr("xxhash64(v)").collect()]
    x = x[np.argsort(key)]
    n = np.where(np.arange(len(x)) % 13 == 0, 3, 1)
    ids = [f"{k:03}-{c}" for k in range(len(x)) for c in range(n[k])]
    df = vectors(ids, [x[int(i[:3])].tolist() for i in ids])
    got = defaultdict(set)
    for r in dc.density_clusters(df, k=len(x), rows_per_partition=-(-len(ids) // parts)).collect():
        got[r["cluster_key"]].add(int(r["id"][:3]))
    want = hierarchy(unit(x), n, dc.REACH, 0.14, 3, 3, 0.0)
    found = {frozenset(g) for g in got.values()}
    assert found == want


def test_boruvka_waits_for_edges_that_lead_elsewhere():
    # ends -1 lie elsewhere; edges in ascending order
    ia, ib = np.array([0, 1, 2, 0]), np.array([1, -1, 3, 2])
    chosen, comp, left = dc.boruvka(4, ia, ib)
    assert chosen.tolist() == [True, False, True, True] or chosen.tolist() == [True, False, True, False]
    assert comp[0] == comp[1] and comp[2] == comp[3] and left[1]
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(2, 40)
        e = sorted({(rng.randrange(9) / 8, *sorted(rng.sample(range(n), 2))) for _ in range(2 * n)})
        e = list({(a, b): (w, a, b) for w, a, b in reversed(e)}.values())
        e.sort()
        part = [rng.randrange(3) for _ in range(n)]
        full = kruskal([(a, b, w) for w, a, b in e])
        for p in range(3):
            own = [v for v in range(n) if part[v] == p]
            at = {v: k for k, v in enumerate(own)}
            here = [(w, a, b) for w, a, b in e if a in at or b in at]
            chosen, comp, left = dc.boruvka(len(own), np.array([at.get(a, -1) for _, a, _ in here]), np.array([at.get(b, -1) for _, _, b in here]))
            assert {(a, b) for (_, a, b), c in zip(here, chosen) if c} <= full
            assert all(c or s or (a, b) not in full for (_, a, b), c, s in zip(here, chosen, left))


def test_edges_that_one_end_lists_cross_partitions(spark, vectors, monkeypatch):
    def everywhere(*args, **more):
        model = fit_partitions(*args, **more)
        model.margin, model.max_probes = 1e9, 99
        return model

    monkeypatch.setattr(dc, "fit_partitions", everywhere)
    x = clustered(31, [14, 11, 9, 7, 5, 4, 3, 3], alone=40)
    ids = [f"{k:03}" for k in range(len(x))]
    df = vectors(ids, x.tolist())
    got = {(r["cluster_key"], r["id"]) for r in dc.density_clusters(df, k=1, rows_per_partition=12, mutual=True).collect()}
    assert got == groups_of(ids, x.tolist())


@pytest.mark.parametrize("epsilon", [0.0, 0.14])
def test_trees_in_bands_have_the_clusters_of_whole_ones(spark, epsilon):
    rng = np.random.default_rng(5)
    n = 300
    edges = [(int(rng.integers(max(0, i - 12), i)), i, float(np.round(rng.uniform(0.01, 0.3), 2))) for i in range(1, n)]
    tree = spark.createDataFrame(edges, "a long, b long, w double")
    vertices = spark.createDataFrame([(i, int(rng.integers(1, 4)), 0, 0) for i in range(n)], "h long, n long, x long, deg long")
    from photosluice.llm.density_clusters import _across

    def found(most):
        rows, first = _across(tree, vertices, most, 1000, 0.3, 0.14, 3, epsilon).orderBy("h").collect(), {}
        for r in rows:
            first.setdefault(r["part"], r["h"])  # the parts' own names mean nothing
        return [(r["h"], r["cluster"], round(r["lam"], 9), first[r["part"]]) for r in rows]

    whole = found(10**6)
    assert found(60) == whole and len({c for _, c, _, _ in whole}) > (1 if not epsilon else 0)
