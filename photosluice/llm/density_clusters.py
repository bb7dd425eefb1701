"""Clusters of mutually similar records by hierarchical density.

Steps: a mutual-reachability neighbour graph (candidates come from learned partitions, distances
are exact), its minimum spanning forest by distributed Boruvka rounds, the condensed hierarchy of
every tree, selection by stability, and the most persistent members as exemplars.

The graph reaches farther (``reach``) than the distance at which records count as similar, so that
stability decides which densities part into clusters. Boruvka begins inside the partitions: a
component takes its least edge as long as that edge stays in the partition, and trees that
no edge leaves are condensed there. The few that cross partitions go on in rounds over all tasks.

Exact copies of a vector are one node that carries their number. Only trees are handled one to a
task, and only up to ``TREE_MOST`` edges: a larger tree is condensed in bands of so many edges, with
the same clusters, so that no task holds an unbounded group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photosluice.core.storage import settle, unsent
from photosluice.functions.scalars import cosine
from photosluice.llm.learned_partitions import fit_partitions
from photosluice.llm.neighbours import _TIE, _cut, _packed, exact_cosine, routed, unpacked
from photosluice.operators.frames import ranked
from photosluice.llm.vectors import DIM, looks_usable, unit, unpack, usable_rows, vector_key

ROWS_PER_PARTITION = 6000
MEAN_PROBES = 2.3
REACH = 0.30  # distance up to which the graph holds edges
FINISH_MOST = 100_000  # edges that one task finishes, about 4 MB
TREE_MOST = 1_000_000  # edges of a tree that one task condenses, about 30 MB
LAMBDA_MOST = 1000.0  # 1 / distance of exact copies
BROADCAST_KEYS = 200_000  # keys of vectors sent to all tasks, 2 MB
LABEL, EDGE, VERTEX = 0, 1, 2


def _code(key: np.ndarray) -> np.ndarray:
    """36 bits of a vector key, of which sums over a partition are exact in double."""
    return (key.view(np.uint64) >> np.uint64(28)).astype(np.float64)


def _best_of(q: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` largest ``v`` of every ``q``."""
    order = np.lexsort((-v, q))
    s = q[order]
    return order[np.arange(len(s)) - np.searchsorted(s, s) < k]


def edge_search(k: int, least: float, reach: float, marks: int, dim: int):
    """Function from a partition's vectors to their nearest ones, for ``applyInArrow``.

    Besides the ``k`` nearest within ``reach``, every vector keeps an edge to the first one of a
    cosine of ``least`` or more, which ties dense groups together. ``deg`` counts the vectors of
    that cosine and ``x`` is the sum of their codes: every such pair that meets anywhere counts
    once for either vector.
    """
    low = 1 - reach

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        h, home = table.column("h").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        order = np.lexsort((h, ~home))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (home[order][1:] != home[order][:-1])]
        first, group = order[new], np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        key, stored, n = h[first], int(home[first].sum()), len(first)
        hp, part = table.column("hp").to_numpy()[first], table.column("part")[0].as_py()
        vias, ms = unpacked(table.column("via"), np.int32), unpacked(table.column("m"), np.int64)
        paths = (group[vias[1]] << 32) | vias[0]
        g, mark = group[ms[1]], ms[0]
        order = np.lexsort((mark, g))
        g, mark = g[order], mark[order]
        mass = np.bincount(g[np.r_[True, (g[1:] != g[:-1]) | (mark[1:] != mark[:-1])]] if len(g) else g, minlength=n)
        mass = np.minimum(mass, marks).astype(np.int32)
        u = unit(unpack(table.column("v"), dim)[first]) if n else np.empty((0, dim))
        x = u.astype(np.float32)
        xt = np.ascontiguousarray(x.T)
        count, code, weight = np.zeros(n, np.int64), np.zeros(n), _code(key)
        paths = np.sort(paths)
        known = lambda i, p: paths[np.minimum(np.searchsorted(paths, (i << 32) | p), len(paths) - 1)] == ((i << 32) | p) if len(paths) else np.zeros(len(i), bool)
        others, of_other = np.unique(hp[stored:], return_inverse=True)
        qs, cs, firsts = [], [], []

        def add(q, c, first):
            qs.append(q), cs.append(c), firsts.append(np.full(len(q), first))

        step = max(16, min(512, (1 << 22) // max(n, 1)))
        for s in range(0, stored, step):
            e = min(stored, s + step)
            sims = x[s:e] @ xt
            sims[np.arange(e - s), np.arange(s, e)] = -2
            near = sims >= low - _TIE
            at = np.flatnonzero(near)
            if not len(at):
                continue
            if len(at) > 64 * (e - s):
                # many hits: masks and products instead of pairs
                same = sims >= least
                i, j = np.nonzero(np.abs(sims - least) < _TIE)
                same[i, j] = exact_cosine(u, i + s, j) >= least
                full = same.astype(np.float64)
                inner = np.flatnonzero(hp[s:e] == part)
                count[s + inner] += np.count_nonzero(same[inner, :stored], axis=1)
                code[s + inner] += full[inner, :stored] @ weight[:stored]
                rows = np.flatnonzero(same.any(axis=1))
                add(rows + s, same[rows].argmax(axis=1), True)
                if n > stored:
                    count[stored:] += np.count_nonzero(same[:, stored:], axis=0)
                    code[stored:] += weight[s:e] @ full[:, stored:]
                    cols = np.flatnonzero(same[:, stored:].any(axis=0))
                    add(cols + stored, same[:, stored + cols].argmax(axis=0) + s, True)
                    for k_, p in enumerate(others):
                        rows = np.flatnonzero(~known(np.arange(s, e), np.int64(p)))
                        cols = stored + np.flatnonzero(of_other == k_)
                        sub = full[np.ix_(rows, cols)]
                        count[s + rows] += sub.sum(axis=1).astype(np.int64)
                        code[s + rows] += sub @ weight[cols]
                    cols = stored + np.flatnonzero(near[:, stored:].any(axis=0))
                    turned, theirs = np.ascontiguousarray(near[:, cols].T), np.ascontiguousarray(sims[:, cols].T)
                    _cut(theirs, turned, k)
                    j, i = np.nonzero(turned)
                    add(cols[j], i + s, False)
                _cut(sims, near, k)
                i, j = np.nonzero(near)
                add(i + s, j, False)
                continue
            v, i, j = sims.ravel()[at], at // n + s, at % n
            same = v >= least
            doubt = np.flatnonzero(np.abs(v - least) < _TIE)
            if len(doubt):
                same[doubt] = exact_cosine(u, i[doubt], j[doubt]) >= least
            a, b = i[same], j[same]
            foreign = b >= stored
            inner = ~foreign & (hp[a] == part)
            back = foreign.copy()
            back[foreign] = ~known(a[foreign], hp[b[foreign]].astype(np.int64))
            to, of = np.concatenate([a[inner], b[foreign], a[back]]), np.concatenate([b[inner], a[foreign], b[back]])
            count += np.bincount(to, minlength=n)
            code += np.bincount(to, weight[of], minlength=n)
            lead = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            add(a[lead], b[lead], True)
            best = _best_of(i, v, k + 2)
            add(i[best], j[best], False)
            out = np.flatnonzero(j >= stored)
            if len(out):
                best = out[_best_of(j[out], v[out], k + 2)]
                add(j[best], i[best], False)
                tie = np.flatnonzero(foreign)
                tie = tie[np.unique(b[tie], return_index=True)[1]]
                add(b[tie], a[tie], True)
        q, c, f = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (qs, cs, firsts))
        order = np.lexsort((~f.astype(bool), c, q))
        q, c, f = q[order], c[order], f[order].astype(bool)
        new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)
        q, c, f = q[new], c[new], f[new]
        cos = exact_cosine(u, q, c)
        good = cos >= low
        q, c, f, cos = q[good], c[good], f[good], cos[good]
        tie = np.flatnonzero(f)
        tie = tie[np.unique(q[tie], return_index=True)[1]]  # of several blocks' first ones, the first
        order = np.lexsort((c, -cos, q))
        near = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
        keep = np.unique(np.r_[near, tie])
        q, c, d = q[keep], c[keep], np.maximum(1 - cos[keep], 0)
        # an edge between partitions must be known in both
        cross = np.flatnonzero(hp[q] != hp[c])
        q, c, d = np.r_[q, c[cross]], np.r_[c, q[cross]], np.r_[d, d[cross]]
        order = np.lexsort((c, q))
        q, c, d = q[order], c[order], d[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])] if len(q) else np.zeros(0, bool)
        q, c, d = q[new], c[new], d[new]
        own, begin = np.unique(q, return_index=True)
        near = np.empty(len(q), _NEAR)
        near["d"], near["c"], near["hc"], near["nc"] = d, key[c], hp[c], mass[c]
        row = np.searchsorted(own, q)
        return pa.table(
            {
                "q": key[own], "hq": hp[own], "nq": mass[own], "deg": count[own], "x": code[own].astype(np.int64),
                "near": _packed(row, near, len(own)),
            }
        )

    return search


_NEAR = np.dtype([("d", np.float64), ("c", np.int64), ("hc", np.int32), ("nc", np.int32)])


def neighbour_lists(source: DataFrame, k: int, least: float, reach: float, marks: int, rows_per_partition: int, mean_probes: float, dim: int) -> DataFrame:
    """(``q``, ``hq``, ``nq``, ``deg``, ``x``, ``near``) of every vector, once for each partition where others are within ``reach``.

    ``near`` has, packed, their distance, key, partition and number of records (``marks`` at most).
    The same neighbour may come twice, from two partitions.
    """
    model = fit_partitions(source, "id", "vec", rows_per_partition, mean_probes, dim=dim, least=least)
    flow = routed(source, F.xxhash64("id"), "vec", model, 0, dim, marks)
    return flow.groupBy("part").applyInArrow(edge_search(k, least, reach, marks, dim), "q long, hq int, nq int, deg long, x long, near binary")


def boruvka(n: int, ia: np.ndarray, ib: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen edge?, component of each of ``n`` vertices, edge left?) for edges in ascending order.

    An end that lies elsewhere is -1. A component whose least edge leads elsewhere waits; the
    rounds end when no component can go on. Every chosen edge is in the minimum spanning forest.
    """
    ia, ib, m = np.asarray(ia, np.int64), np.asarray(ib, np.int64), len(ia)
    comp, chosen, live = np.arange(n), np.zeros(m, bool), np.arange(m)
    while True:
        ca, cb = (np.where(x[live] >= 0, comp[x[live]], -1) for x in (ia, ib))
        open_ = ca != cb
        live, ca, cb = live[open_], ca[open_], cb[open_]
        best = np.full(n + 1, m)
        for c in (ca, cb):
            np.minimum.at(best, c, live)
        root = np.flatnonzero(best[:n] < m)
        e = best[root]
        x, y = (np.where(z[e] >= 0, comp[z[e]], -1) for z in (ia, ib))
        inner = (x >= 0) & (y >= 0)
        root, e, x, y = root[inner], e[inner], x[inner], y[inner]
        if not len(root):
            left = np.zeros(m, bool)
            left[live] = True
            return chosen, comp, left
        chosen[e] = True
        parent = np.arange(n)
        parent[root] = np.where(x == root, y, x)
        two = root[(parent[parent[root]] == root) & (root < parent[root])]
        parent[two] = two
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]


def _union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chosen edge?, distinct ends, the component of each end) for edges in ascending order."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    chosen, comp, _ = boruvka(len(ends), at[: len(a)], at[len(a) :])
    low = np.full(len(ends), len(ends))
    np.minimum.at(low, comp, np.arange(len(ends)))
    return chosen, ends, ends[low[comp]]


def _tree_labels(h, n, deg, x, ia, ib, w, reach: float, same: float, min_size: int, epsilon: float):
    """(key, cluster, part, lam, mutual?) of the vertices of one tree that are in a cluster, or None.

    ``part`` is what stays together at the distance ``same``; it is mutual if every vector has all
    others of the part, and no other vector, within that distance.
    """
    label, leave = condensed(ia.tolist(), ib.tolist(), w.tolist(), n.tolist(), reach, min_size, epsilon)
    label, leave = np.asarray(label), np.asarray(leave)
    keep = (label >= 0) & (leave >= (1 - 1e-9) / same)
    if not keep.any():
        return None
    near = int(np.searchsorted(w, same, side="right"))
    if near == len(w):
        part = np.zeros(len(h), np.int64)
    else:
        _, part, _ = boruvka(len(h), ia[:near], ib[:near])
    lowest, cluster = (np.full(k, np.iinfo(np.int64).max) for k in (len(h), int(label.max()) + 1))
    np.minimum.at(lowest, part, h)
    np.minimum.at(cluster, label[keep], h[keep])
    code = _code(h).astype(np.int64)
    count, total, good = np.bincount(part, minlength=len(h)), np.zeros(len(h), np.int64), np.ones(len(h), bool)
    np.add.at(total, part, code)
    np.logical_and.at(good, part, (deg == count[part] - 1) & (x + code == total[part]))
    return h[keep], cluster[label[keep]], lowest[part[keep]], leave[keep], good[part[keep]]


def _in_partition(min_samples: int, reach: float, same: float, min_size: int, epsilon: float):
    """Function from the neighbour lists of a partition's vectors to finished labels and open rest, for ``applyInArrow``.

    Output: labels (key, cluster, part, lam, mutual?); edges (``a``, ``b``, ``w``) and vertices (key,
    records, code, neighbours) of the trees that reach into other partitions. An edge that leads
    there comes from both, with the weight that either end knows of, the larger being right.
    """

    def local(table: pa.Table) -> pa.Table:
        block = table.column("hq")[0].as_py()
        key, nq, n, deg, code = (table.column(c).to_numpy() for c in ("q", "nq", "n", "deg", "x"))
        values, row = unpacked(table.column("near"), _NEAR)
        q, first, of = np.unique(key, return_index=True, return_inverse=True)
        nq, n, qi = nq[first], n[first], of[row]
        totals = np.zeros((2, len(q)), np.int64)
        for total, part in zip(totals, (deg, code)):
            np.add.at(total, of, part)
        deg, code = totals
        d, c, hc, nc = (np.ascontiguousarray(values[k]) for k in ("d", "c", "hc", "nc"))
        order = np.lexsort((c, d, qi))
        new = np.r_[True, (qi[order][1:] != qi[order][:-1]) | (c[order][1:] != c[order][:-1])] if len(order) else np.zeros(0, bool)
        at = order[new]
        qi, d, c, hc, nc = qi[at], d[at], c[at], hc[at], nc[at]
        # core distance: that to the min_samples-th record, itself and copies included
        total = np.cumsum(nc)
        begin = np.searchsorted(qi, np.arange(len(q)))
        have = nq[qi] + total - np.r_[0, total][begin][qi]
        enough = np.flatnonzero(have >= min_samples)
        core = np.full(len(q), same)
        rows, first = np.unique(qi[enough], return_index=True)
        core[rows] = d[enough[first]]
        core[nq >= min_samples] = 0.0
        # an edge that only one end lists is longer than the other end's core distance; two similar
        # records are never farther apart than the distance at which records count as similar
        low = q[qi] < c
        a, b = np.where(low, q[qi], c), np.where(low, c, q[qi])
        ha, hb = np.where(low, block, hc), np.where(low, hc, block)
        w = np.maximum(d, np.where(d <= same, np.minimum(core[qi], same), core[qi]))
        order = np.lexsort((b, a))
        a, b, ha, hb, w = a[order], b[order], ha[order], hb[order], w[order]
        begin = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        w = np.maximum.reduceat(w, begin) if len(begin) else w
        a, b, ha, hb = a[begin], b[begin], ha[begin], hb[begin]
        order = np.lexsort((b, a, w))
        a, b, ha, hb, w = a[order], b[order], ha[order], hb[order], w[order]
        h = q
        ia = np.where(ha == block, np.searchsorted(h, a), -1)
        ib = np.where(hb == block, np.searchsorted(h, b), -1)
        chosen, comp, left = boruvka(len(h), ia, ib)
        is_open = np.zeros(len(h), bool)
        for end in (ia[left], ib[left]):
            is_open[comp[end[end >= 0]]] = True
        mass = np.bincount(comp, n, len(h)) if len(h) else np.zeros(0)
        trees = np.flatnonzero((mass >= min_size) & ~is_open)
        by_tree, inside = np.argsort(comp, kind="stable"), np.flatnonzero(chosen)
        inside = inside[np.argsort(comp[ia[inside]], kind="stable")]
        cut_v = [np.searchsorted(comp[by_tree], trees, side=s) for s in ("left", "right")]
        cut_e = [np.searchsorted(comp[ia[inside]], trees, side=s) for s in ("left", "right")]
        place, labels = np.empty(len(h), np.int64), []
        for v0, v1, e0, e1 in zip(*cut_v, *cut_e):
            vs, es = by_tree[v0:v1], inside[e0:e1]
            place[vs] = np.arange(len(vs))
            labels.append(_tree_labels(h[vs], n[vs], deg[vs], code[vs], place[ia[es]], place[ib[es]], w[es], reach, same, min_size, epsilon))
        labels = [x for x in labels if x is not None]
        lab = [np.concatenate(x) for x in zip(*labels)] if labels else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, float, bool)]
        rest = left | (chosen & is_open[comp[np.maximum(ia, 0)]]) if len(h) else left
        vs = np.flatnonzero(is_open[comp])
        zero = lambda k, t=np.int64: np.zeros(k, t)
        parts = [
            (LABEL, *lab),
            (EDGE, a[rest], b[rest], zero(int(rest.sum())), w[rest], zero(int(rest.sum()), bool)),
            (VERTEX, h[vs], n[vs], code[vs], deg[vs].astype(float), zero(len(vs), bool)),
        ]
        cols = [np.concatenate([np.full(len(p[1]), p[0], np.int32) for p in parts])] + [np.concatenate([p[k] for p in parts]) for k in range(1, 6)]
        return pa.table(dict(zip(("kind", "a", "b", "c", "w", "ok"), cols)))

    return local


def spanning_forest(edges: DataFrame, small: int = FINISH_MOST) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of (``a``, ``b``, ``w``): its edges, and the tree (``h``, ``root``) of each end.

    Boruvka rounds: each component takes its least edge (ties by the ends, so the forest is
    unique), components joined by such edges become one, edges inside one are dropped and parallel
    ones reduced to the least. Once at most ``small`` edges are left after a round, one task
    finishes them.
    """
    live = settle(edges.where("a <> b").select(F.col("a").alias("ca"), F.col("b").alias("cb"), "w", "a", "b"), "boruvka")
    nodes = live.select(F.explode(F.array("a", "b")).alias("h")).distinct().select("h", F.col("h").alias("root"))
    chosen, maps = [], []
    while (left := live.count()) > small or (left and not maps):
        best = live.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("p")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("p")))).alias("x"), "w", "a", "b")
        best = settle(best.groupBy("x.c").agg(F.min(F.struct("w", "a", "b", "x.p")).alias("e")).select("c", "e.*"), "least")
        chosen.append(best.select("a", "b", "w").distinct())
        hook = best.select("c", "p")
        back = hook.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        # the two components that chose the same edge would point at each other: the smaller stays
        parent = settle(
            hook.join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")),
            "parent",
        )
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = settle(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
            parent = jumped.select("c", "p")
            if jumped.where("moved").limit(1).count() == 0:
                break
        maps.append(parent)
        ra, rb = parent.select(F.col("c").alias("ca"), F.col("p").alias("ra")), parent.select(F.col("c").alias("cb"), F.col("p").alias("rb"))
        live = settle(
            live.join(ra, "ca").join(rb, "cb").where("ra <> rb")
            .groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))
            .agg(F.min(F.struct("w", "a", "b")).alias("e"))
            .select("ca", "cb", "e.*"),
            "boruvka",
        )
    if left:

        def finish(batches):
            parts = list(batches)
            if not parts:
                return
            t = pa.Table.from_batches(parts)
            ca, cb, w, a, b = (t.column(x).to_numpy() for x in ("ca", "cb", "w", "a", "b"))
            order = np.lexsort((b, a, w))
            took, ends, roots = _union_find(ca[order], cb[order])
            at = order[took]
            n, m = len(at), len(ends)
            yield pa.RecordBatch.from_pydict(
                {"x": pa.array(np.r_[a[at], ends]), "y": pa.array(np.r_[b[at], roots]), "w": pa.array(np.r_[w[at], np.full(m, -1.0)])}
            )

        last = settle(live.repartition(1).mapInArrow(finish, "x long, y long, w double"), "finish")
        chosen.append(last.where("w >= 0").select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
        maps.append(last.where("w < 0").select(F.col("x").alias("c"), F.col("y").alias("p")))
    for m in maps:
        nodes = nodes.join(m, F.col("root") == F.col("c"), "left").select("h", F.coalesce("p", "root").alias("root"))
    if not chosen:
        return edges.select("a", "b", "w").limit(0), nodes
    tree = chosen[0]
    for other in chosen[1:]:
        tree = tree.union(other)
    return tree.distinct() if len(chosen) > 1 else tree, nodes


def condensed(a, b, w, mass, max_distance: float, min_size: int, epsilon: float):
    """Condensed hierarchy of one tree.

    ``a``, ``b`` index the tree's vertices, edges come in ascending ``w``; ``mass`` is the number
    of records of each vertex. Returns (cluster of each vertex or -1, lambda at which it leaves).
    """
    n = len(mass)
    size, parent = list(mass) + [0] * (n - 1), list(range(2 * n - 1))
    kids: list[tuple[int, int, float]] = []
    for i in range(n - 1):
        x, y = a[i], b[i]
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        z = n + i
        parent[x] = parent[y] = z
        size[z] = size[x] + size[y]
        kids.append((x, y, min(1.0 / w[i], LAMBDA_MOST) if w[i] > 0 else LAMBDA_MOST))
    leave = [0.0] * n
    owner = [-1] * n
    birth, stability, above = [1.0 / max_distance], [0.0], [-1]
    if size[2 * n - 2] < min_size:
        return owner, leave
    todo = [(2 * n - 2, 0, 0.0)]
    while todo:
        node, cluster, fall = todo.pop()
        if node < n:
            lam = fall or LAMBDA_MOST
            owner[node], leave[node] = cluster, lam
            if not fall:
                stability[cluster] += (lam - birth[cluster]) * size[node]
            continue
        x, y, lam = kids[node - n]
        if fall:
            todo += [(x, cluster, fall), (y, cluster, fall)]
            continue
        big = [size[x] >= min_size, size[y] >= min_size]
        if all(big):
            stability[cluster] += (lam - birth[cluster]) * size[node]
            for child in (x, y):
                birth.append(lam), stability.append(0.0), above.append(cluster)
                todo.append((child, len(birth) - 1, 0.0))
            continue
        for child, stays in ((x, big[0]), (y, big[1])):
            if not stays:
                stability[cluster] += (lam - birth[cluster]) * size[child]
            todo.append((child, cluster, 0.0 if stays else lam))
    # excess of mass: a cluster stays whole unless its parts are more stable together
    count = len(birth)
    whole, parts = [True] * count, [0.0] * count
    for c in range(count - 1, -1, -1):
        whole[c] = stability[c] >= parts[c]
        if above[c] >= 0:
            parts[above[c]] += max(stability[c], parts[c])
    pick = _topmost(above, whole)
    if epsilon > 0:
        # a cluster born at a distance under epsilon gives way to its first ancestor that was not
        rise = [False] * count
        for c in range(count):
            if pick[c] == c:
                up = c
                while above[up] >= 0 and 1.0 / birth[up] < epsilon:
                    up = above[up]
                rise[up] = True
        pick = _topmost(above, rise)
    return [pick[c] if c >= 0 else -1 for c in owner], leave


def _topmost(above: list[int], marked: list[bool]) -> list[int]:
    """For every cluster its topmost marked ancestor or itself, -1 if none; parents come first."""
    out = [-1] * len(above)
    for c, p in enumerate(above):
        out[c] = out[p] if p >= 0 and out[p] >= 0 else (c if marked[c] else -1)
    return out


def density_clusters(
    df: DataFrame,
    id_col: str = "asset_id",
    vec_col: str = "embedding",
    least: float = 0.86,
    min_size: int = 3,
    min_samples: int = 3,
    epsilon: float = 0.0,
    k: int = 6,
    reach: float = REACH,
    rows_per_partition: int = ROWS_PER_PARTITION,
    mean_probes: float = MEAN_PROBES,
    tree_most: int = TREE_MOST,
    small: int = FINISH_MOST,
    dim: int = DIM,
    mutual: bool = False,
) -> DataFrame:
    """(``cluster_key``, ``size``, ``id``, ``lam``): the clusters of at least ``min_size`` records.

    ``cluster_key`` is the smallest id in the cluster; ``lam`` is the density (1 / distance) up to
    which the record stays in it, so the largest are its most typical members. The graph holds
    pairs up to the distance ``reach``; stability decides which densities part into clusters, and
    of a cluster those records are members that stay in it to the distance ``1 - least``. Clusters
    born at distances under ``epsilon`` give way to the one they come from; with 0 stability alone
    decides. Rows whose vector is null, of another size, all zero or not finite, and rows
    without an id are left out, records in no cluster too; an id delivered more than once counts
    once; ties are broken by vector key. An empty table gives no rows; other columns are ignored.

    ``mutual``: clusters are not divided below the distance ``1 - least`` (``epsilon`` is set to it);
    what of a cluster hangs together at that distance is a group of its own, and an exact check
    keeps the groups of which every two records have a cosine of ``least`` or more.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.col("id").isNotNull())
    same = 1 - least
    reach = max(reach, same)
    epsilon = same if mutual else epsilon
    member = settle(source.where(looks_usable("vec", dim)).select("id", vector_key("vec").alias("h")).distinct(), "members")
    weights = settle(member.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    several = F.broadcast(weights) if weights.count() <= BROADCAST_KEYS else weights
    lists = neighbour_lists(source, k, least, reach, min(min_samples, 8), rows_per_partition, mean_probes, dim)
    lists = lists.join(several, F.col("q") == F.col("h"), "left").drop("h").withColumn("n", F.coalesce("n", F.lit(1)))
    local = lists.groupBy("hq").applyInArrow(_in_partition(min_samples, reach, same, min_size, epsilon), "kind int, a long, b long, c long, w double, ok boolean")
    local = settle(local, "in-partition")
    labelled = local.where(F.col("kind") == LABEL).select(F.col("a").alias("h"), F.col("b").alias("cluster"), F.col("c").alias("part"), F.col("w").alias("lam"), "ok")
    vertices = local.where(F.col("kind") == VERTEX).select(F.col("a").alias("h"), F.col("b").alias("n"), F.col("c").alias("x"), F.col("w").cast("long").alias("deg"))
    if vertices.limit(1).count():
        labelled = labelled.unionByName(_across(local.where(F.col("kind") == EDGE).groupBy("a", "b").agg(F.max("w").alias("w")), vertices, tree_most, small, reach, same, min_size, epsilon))
    # vectors that nothing resembles but their own copies
    alone = weights.where(F.col("n") >= min_size).join(labelled.select("h"), "h", "left_anti")
    alone = alone.select("h", F.col("h").alias("cluster"), F.col("h").alias("part"), F.lit(LAMBDA_MOST).alias("lam"), F.lit(True).alias("ok"))
    found = member.join(labelled.unionByName(alone), "h")
    found = found.select("id", "h", F.col("part" if mutual else "cluster").alias("g"), "lam", "ok")
    if not mutual:
        return _keyed(found, min_size).select("cluster_key", "size", "id", "lam")
    found = settle(found, "labelled")
    sure = _keyed(found.where("ok"), min_size)
    doubtful = found.where("not ok")
    if doubtful.limit(1).count():
        sure = sure.unionByName(_mutual_of(_keyed(doubtful, min_size), source, least, rows_per_partition, dim))
    return sure.select("cluster_key", "size", "id", "lam")


def _keyed(found: DataFrame, min_size: int) -> DataFrame:
    keys = found.groupBy("g").agg(F.min("id").alias("cluster_key"), F.count("*").alias("size")).where(F.col("size") >= min_size)
    return found.join(keys, "g").select("cluster_key", "size", "id", "lam", "h")


def _across(edges, vertices, tree_most, small, reach, same, min_size, epsilon) -> DataFrame:
    """Labels of the trees that lie in several partitions."""
    tree, nodes = spanning_forest(edges, small)
    tree, nodes = settle(tree, "tree"), settle(nodes, "nodes")
    huge = nodes.groupBy("root").count().where(F.col("count") > tree_most).select("root")
    if not huge.limit(1).count():
        return _label_trees(tree, nodes, vertices, reach, same, min_size, epsilon)
    rooted = settle(tree.join(nodes.select(F.col("h").alias("a"), "root"), "a").join(huge, "root"), "huge")
    ends = settle(nodes.join(huge, "root"), "ends")
    labelled = _in_bands(rooted, ends.join(vertices, "h"), tree_most, reach, same, min_size, epsilon)
    _, parts = spanning_forest(rooted.where(F.col("w") <= same).select("a", "b", "w"), small)
    labelled = labelled.join(parts, "h", "left").select("h", "cluster", F.coalesce("root", "h").alias("part"), "lam", F.lit(False).alias("ok"))
    others = nodes.join(huge, "root", "left_anti")
    return labelled.unionByName(_label_trees(tree, others, vertices, reach, same, min_size, epsilon))


ROOT = 1 << 62  # label of the cluster that is a whole tree
_SUM = ("n", "total", "parts", "split")  # records, their lambda in all, stability of what it divides into, lambda at which it does


def _band(cols: list, min_size: int, epsilon: float):
    """(nodes, joins, sums of each node, last node) of the edges of one band of a tree, in ascending order.

    ``cols``: rank, weight, and of either end its key and :data:`_SUM`. A cluster that goes on in a
    node is whole if its records stay for as much as the clusters that it divides into.
    """
    rank, w = cols[0].tolist(), cols[1].tolist()
    keys, first, at = np.unique(np.concatenate([cols[2], cols[7]]), return_index=True, return_inverse=True)
    sums = list(zip(*(np.concatenate([cols[3 + k], cols[8 + k]])[first].tolist() for k in range(4))))
    parent, joins, m = list(range(len(keys) + len(w))), [], len(w)
    at = at.tolist()

    def up(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(m):
        x, y, z = up(at[i]), up(at[m + i]), len(sums)
        parent[x] = parent[y] = z
        lam = min(1.0 / w[i], LAMBDA_MOST) if w[i] > 0 else LAMBDA_MOST
        (nx, lx, px, sx), (ny, ly, py, sy) = sums[x], sums[y]
        big = (nx >= min_size, ny >= min_size)
        whole = [_whole(s, lam, epsilon) for s in (sums[x], sums[y])] if all(big) else [False, False]
        if all(big):
            sums.append((nx + ny, lam * (nx + ny), max(lx - lam * nx, px) + max(ly - lam * ny, py), lam))
        elif big[0]:
            sums.append((nx + ny, lx + lam * ny, px, sx))
        elif big[1]:
            sums.append((nx + ny, ly + lam * nx, py, sy))
        else:
            sums.append((nx + ny, lam * (nx + ny), 0.0, 0.0))
        joins.append((x, y, lam, big, whole, rank[i]))
    return keys, joins, sums, [up(x) for x in range(len(keys))]


def _whole(sums, birth: float, epsilon: float) -> bool:
    """Is a cluster born at ``birth`` taken whole, or as what divides only under the distance ``epsilon``?"""
    n, total, parts, split = sums
    return total - birth * n >= parts or (split > 0 and 1.0 / split < epsilon)


def _in_bands(edges, ends, band_most, reach, same, min_size, epsilon) -> DataFrame:
    """(``h``, ``cluster``, ``lam``) of trees (``root``, ``a``, ``b``, ``w``) that no task could hold, as :func:`condensed` has them.

    The edges of a tree come in bands of ``band_most``, the lightest first. What a band joins is one
    node of the next, with the sums that decide on its clusters; then labels go down through the
    bands again. One task holds a band of a tree, whatever the size of the tree.
    """
    edges = ranked(edges.select("root", "a", "b", "w"), ["root"], "r", F.asc("w"), F.asc("a"), F.asc("b"))
    left = settle(edges.select("root", "r", "w", F.col("a").alias("sa"), F.col("b").alias("sb"), F.floor(F.col("r") / band_most).alias("band")), "edges")
    bands = left.agg(F.max("band").alias("m")).first()["m"] + 1
    n, no = F.col("n").cast("double"), F.lit(0.0)
    live = ends.select("root", F.col("h").alias("s"), n.alias("n"), F.when(n >= min_size, n * LAMBDA_MOST).otherwise(no).alias("total"), no.alias("parts"), no.alias("split"))
    of = lambda c: live.select("root", F.col("s").alias(f"s{c}"), *[F.col(k).alias(f"{k}{c}") for k in _SUM])
    order = ["r", "w", *[f"{k}{c}" for c in "ab" for k in ("s", *_SUM)]]

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        keys, _, sums, last = _band([table.column(c).to_numpy() for c in order], min_size, epsilon)
        names: dict[int, int] = {}
        for key, z in zip(keys.tolist(), last):
            names.setdefault(z, key)
        root = table.column("root")[0].as_py()
        cols = {"root": [root] * len(keys), "s": keys, "t": [names[z] for z in last]}
        return pa.table(cols | {k: [sums[z][i] for z in last] for i, k in enumerate(_SUM)})

    def handed(table: pa.Table) -> pa.Table:
        table = table.sort_by("r")
        keys, joins, sums, last = _band([table.column(c).to_numpy() for c in order], min_size, epsilon)
        at = np.searchsorted(keys, table.column("sa").to_numpy()).tolist()
        state = {last[i]: x for i, x in zip(at, zip(table.column("lab").to_pylist(), table.column("fall").to_pylist()))}
        for z in range(len(sums) - 1, len(keys) - 1, -1):
            x, y, lam, big, whole, rank = joins[z - len(keys)]
            lab, fall = state.pop(z)
            for side, child in enumerate((x, y)):
                if fall or not all(big):
                    state[child] = (lab, fall or (0.0 if big[side] else lam))
                else:
                    state[child] = (2 * rank + side if lab < 0 and whole[side] else lab, 0.0)
        got = [state[i] for i in range(len(keys))]
        root = table.column("root")[0].as_py()
        return pa.table({"root": [root] * len(keys), "s": keys, "lab": [x[0] for x in got], "fall": [float(x[1]) for x in got]})

    steps = []
    for k in range(bands):
        step = left.where(F.col("band") == k).join(unsent(of("a")), ["root", "sa"]).join(unsent(of("b")), ["root", "sb"])
        step = settle(step.select("root", *order), "band")
        moved = settle(step.groupBy("root").applyInArrow(joined, "root long, s long, t long, " + ", ".join(f"{c} double" for c in _SUM)), "moved")
        steps.append((step, moved.select("root", "s", "t")))
        kept = live.join(unsent(moved.select("root", "s")), ["root", "s"], "left_anti")
        live = settle(kept.unionByName(moved.select("root", F.col("t").alias("s"), *_SUM).distinct()), "live")
        left = left.where(F.col("band") > k)
        for c in ("sa", "sb"):
            to = moved.select("root", F.col("s").alias(c), F.col("t").alias("_t"))
            left = left.join(unsent(to), ["root", c], "left").withColumn(c, F.coalesce("_t", c)).drop("_t")
        left = settle(left, "edges")
    whole = (F.col("total") - F.col("n") / reach >= F.col("parts")) | ((F.col("split") > 0) & (1 / F.col("split") < epsilon))
    state = live.select("root", "s", F.when(whole, F.lit(ROOT)).otherwise(F.lit(-1)).cast("long").alias("lab"), no.alias("fall"))
    for step, moved in reversed(steps):
        above = moved.join(unsent(state.withColumnRenamed("s", "t")), ["root", "t"]).select("root", F.col("s").alias("sa"), "lab", "fall")
        below = step.join(unsent(above), ["root", "sa"]).groupBy("root").applyInArrow(handed, "root long, s long, lab long, fall double")
        kept = state.join(unsent(moved.select("root", F.col("t").alias("s")).distinct()), ["root", "s"], "left_anti")
        state = settle(kept.unionByName(below), "state")
    lam = F.when(F.col("fall") > 0, F.col("fall")).otherwise(F.lit(LAMBDA_MOST))
    kept = state.select("root", F.col("s").alias("h"), "lab", lam.alias("lam")).where((F.col("lab") >= 0) & (F.col("lam") >= (1 - 1e-9) / same))
    names = kept.groupBy("root", "lab").agg(F.min("h").alias("cluster"))
    return settle(kept.join(unsent(names), ["root", "lab"]).select("h", "cluster", "lam"), "labels")


def _mutual_of(found: DataFrame, source: DataFrame, least: float, block_rows: int, dim: int) -> DataFrame:
    """Rows of ``found`` whose cluster's members all resemble each other, by comparing the vectors.

    All are compared with one of them first; what is left, in pairs of blocks.
    """
    vectors = source.where(looks_usable("vec", dim)).select(vector_key("vec").alias("h"), "vec")
    doubt = settle(found.select("cluster_key", "h").distinct(), "doubt")
    wanted = doubt.select("h")
    # a few keys go to all tasks, so that the other vectors stay where they are
    vectors = vectors.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "h", "left_semi").dropDuplicates(["h"])
    own = settle(doubt.join(vectors, "h"), "doubtful")
    pivot = own.groupBy("cluster_key").agg(F.min_by("vec", "h").alias("pivot"), F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    wide = lambda c: F.transform(c, lambda x: x.cast("double"))
    tried = own.join(pivot, "cluster_key").withColumn("far", cosine(wide("vec"), wide("pivot")) < least - _TIE)
    bad = tried.where("far").select("cluster_key").distinct()
    own = settle(tried.drop("far", "pivot").join(bad, "cluster_key", "left_anti").withColumn("b", F.pmod("h", "blocks").cast("int")), "hopeful")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("b")).alias("lo"), F.greatest(o, F.col("b")).alias("hi")))
    dealt = own.select("cluster_key", "vec", "b", F.explode(meets).alias("m")).select("cluster_key", "vec", "b", "m.*")

    def compare(table: pa.Table) -> pa.Table:
        at, rows = usable_rows(table.column("vec").combine_chunks(), dim)
        block = table.column("b").to_numpy()[at]
        lo, hi = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("lo", "hi"))
        u = unit(rows) if len(rows) else rows
        x, apart = u.astype(np.float32), False
        for s in range(0, len(lo), 512):
            sims = x[lo[s : s + 512]] @ x[hi].T
            i, j = np.nonzero(np.abs(sims - least) < _TIE)
            near = np.einsum("ij,ij->i", u[lo[s + i]], u[hi[j]]) >= least
            sims[i, j] = np.where(near | (lo[s + i] == hi[j]), 2, -2)
            if apart := bool((sims < least).any()):
                break
        return table.select(["cluster_key"]).slice(0, int(apart))

    kind = found.schema["cluster_key"].dataType.simpleString()
    apart = dealt.groupBy("cluster_key", "lo", "hi").applyInArrow(compare, f"cluster_key {kind}").distinct()
    return found.join(own.select("cluster_key").distinct(), "cluster_key", "left_semi").join(apart, "cluster_key", "left_anti")


def _label_trees(tree, nodes, vertices, reach, same, min_size, epsilon) -> DataFrame:
    """(``h``, ``cluster``, ``part``, ``lam``, ``ok``) of every vertex in a cluster, each tree condensed in one task."""
    none = F.lit(0).cast("long")
    heads = nodes.join(vertices, "h").select("root", F.col("h").alias("a"), F.col("n").alias("b"), F.lit(-1.0).alias("w"), "deg", "x")
    lines = tree.join(nodes.select(F.col("h").alias("a"), "root"), "a").select("root", "a", "b", "w", none.alias("deg"), none.alias("x"))
    rows = heads.unionByName(lines).repartition("root").sortWithinPartitions("root", "w", "a", "b")

    def one(a, b, w, deg, x):
        n = int(np.searchsorted(w, 0.0))
        order = np.argsort(a[:n])
        h = a[:n][order]
        ia, ib = np.searchsorted(h, a[n:]), np.searchsorted(h, b[n:])
        return _tree_labels(h, b[:n][order], deg[:n][order], x[:n][order], ia, ib, w[n:], reach, same, min_size, epsilon)

    def label(batches):
        rest = None

        def trees(cols, cut):
            root = cols[0][:cut]
            begin = np.flatnonzero(np.r_[True, root[1:] != root[:-1]]) if cut else []
            got = [r for s, e in zip(begin, np.r_[begin[1:], cut] if cut else []) if (r := one(*(x[s:e] for x in cols[1:]))) is not None]
            if got:
                yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in zip(("h", "cluster", "part", "lam", "ok"), zip(*got))})

        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            yield from trees(cols, cut)
            rest = [x[cut:] for x in cols]
        if rest is not None and len(rest[0]):
            yield from trees(rest, len(rest[0]))

    return settle(rows.mapInArrow(label, "h long, cluster long, part long, lam double, ok boolean"), "labels")


def exemplars(clusters: DataFrame, scores: DataFrame, most: int = 3) -> DataFrame:
    """(``cluster_key``, ``size``, ``place``, ``id``, ``score``): the most persistent members of each cluster.

    ``scores`` has one row (``id``, ``score``) a record. Order: ``lam`` descending, then score
    descending (null last), then id. Groups are reduced before the shuffle by keeping the best
    ``most`` of each in every task, whatever their size.
    """
    ranked = clusters.join(scores, "id", "left").select(
        "cluster_key", "size", F.struct((-F.col("lam")).alias("lam"), (-F.coalesce("score", F.lit(-1.0))).alias("neg"), "id", "score").alias("x")
    )
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("x.id"), F.lit(64)))
    # a salted share is cut to `most` before the second grouping sees it
    w = Window.partitionBy("cluster_key", "salt").orderBy("x")
    few = salted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return few.groupBy("cluster_key", "size").agg(F.slice(F.array_sort(F.collect_list("x")), 1, most).alias("best")).select(
        "cluster_key", "size", F.posexplode("best").alias("place", "b")
    ).select("cluster_key", "size", "place", F.col("b.id").alias("id"), F.col("b.score").alias("score"))
