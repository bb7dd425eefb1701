"""Learned partitions of a vector collection.

A bounded sample gives a neighbour graph; a balanced partitioning of that graph gives labels; a
small softmax classifier learns to predict, for any vector, in which partitions its neighbours
lie. Every vector is then stored in its most probable partition and sought in the several most
probable ones. Beyond ``FANOUT`` partitions a second layer of classifiers, fitted inside each
partition of the first in parallel, keeps routing cheap.

The sample holds distinct vectors, so copies have no say in the fit. A group of near copies that
would fill more than half a partition is found in the sample and left out of the fit too: it gets
blocks of its own, every two of which are compared, and by the triangle inequality every vector
that may resemble a member is sought in all of its blocks. Pairs with an end in such a group are
thus complete, whatever the number of probes.

Documented bounds: the first layer is fitted on at most ``SAMPLE_MOST`` vectors, each classifier
of the second layer on at most ``SAMPLE_MOST``; the model has at most FANOUT * FANOUT partitions
(64 numbers each, 16 MB in all), which bounds the broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photosluice.llm.vectors import DIM, pack, unit, unpack, usable_rows, vector_key

FANOUT = 256
SAMPLE_PER_PARTITION = 200
SAMPLE_MOST = 24_000
DENSE_LEAST = 32  # members in the sample from which a group may count as dense
DENSE_BLOCK = 2  # rows of a dense group's block, in rows of a partition


@dataclass
class Layer:
    """Softmax classifier over partitions: logits are ``x @ weights + bias``."""

    weights: np.ndarray
    bias: np.ndarray

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


@dataclass
class PartitionModel:
    """Routes unit vectors to partitions."""

    top: Layer | None = None
    below: dict[int, Layer] = field(default_factory=dict)
    offsets: np.ndarray | None = None
    margin: float = 0.0
    max_probes: int = 8
    dense: np.ndarray | None = None  # a unit vector in the middle of each dense group
    blocks: np.ndarray | None = None  # number of blocks of each
    least: float = 0.86

    @property
    def partitions(self) -> int:
        if self.top is None:
            return 1
        return int(self.offsets[-1]) if self.below else len(self.top.bias)

    def candidates(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, log probability) of every partition within ``margin`` of a row's best."""
        n = len(x)
        if self.top is None:
            return np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        lp = self.top.log_probabilities(x)
        near = lp >= lp.max(axis=1, keepdims=True) - margin
        row, part = np.nonzero(near)
        score = lp[row, part]
        if not self.below:
            return row, part, score
        rows, parts, scores = [], [], []
        for c in np.unique(part):
            at = part == c
            r = row[at]
            if c not in self.below:
                rows.append(r), parts.append(np.full(len(r), self.offsets[c])), scores.append(score[at])
                continue
            sub = self.below[c].log_probabilities(x[r]) + score[at][:, None]
            i, j = np.nonzero(sub >= sub.max(axis=1, keepdims=True) - margin)
            rows.append(r[i]), parts.append(self.offsets[c] + j), scores.append(sub[i, j])
        return np.concatenate(rows), np.concatenate(parts), np.concatenate(scores)

    def route(self, x: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, is the row stored there); ``key`` deals the rows of dense groups to blocks.

        A member of a dense group is stored in its block and meets every other block of its group
        in a partition for the two. Whatever may resemble a member queries all blocks. Other rows
        have one partition of their own and at most ``max_probes`` in all.
        """
        if self.dense is None:
            return self._probe(x)
        sims = x @ self.dense.T
        best = sims.argmax(axis=1)
        member = sims[np.arange(len(x)), best] >= self.least
        plain = np.flatnonzero(~member)
        row, part, home = self._probe(x[plain])
        rows, parts, homes = [plain[row]], [part], [home]
        reach = math.cos(min(math.pi, 2 * math.acos(self.least))) - 1e-4
        row, group = np.nonzero(sims >= reach)
        begin = self.partitions + np.r_[0, np.cumsum(self.blocks * (self.blocks + 1) // 2)]
        for g in np.unique(group):
            n = int(self.blocks[g])
            r = row[group == g]
            own = member[r] & (best[r] == g)
            block = np.mod(key[r], n)[:, None]
            other = np.arange(n)[None, :]
            lo = np.where(own[:, None], np.minimum(block, other), other)
            hi = np.where(own[:, None], np.maximum(block, other), other)
            rows.append(np.repeat(r, n))
            parts.append((begin[g] + lo * n - lo * (lo - 1) // 2 + hi - lo).ravel())
            homes.append((own[:, None] & (lo == block)).ravel())
        return np.concatenate(rows), np.concatenate(parts), np.concatenate(homes)

    def _probe(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, partition, is it the row's own partition), at most ``max_probes`` a row."""
        row, part, score = self.candidates(x, self.margin)
        order = np.lexsort((part, -score, row))
        row, part, score = row[order], part[order], score[order]
        first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
        best = np.repeat(score[begin], np.diff(np.r_[begin, len(row)]))
        keep = (rank < self.max_probes) & (score >= best - self.margin)
        return row[keep], part[keep], first[keep]


def neighbour_graph(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Indices of the ``k`` most similar rows of every row (brute force over a bounded sample)."""
    n, k = len(x), min(k, len(x) - 1)
    out = np.empty((n, k), np.int32)
    for s in range(0, n, block):
        sims = x[s : s + block] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        out[s : s + block] = np.argpartition(sims, n - k, axis=1)[:, n - k :]
    return out


def _fill(scores: np.ndarray, capacity: int) -> np.ndarray:
    """Give every row its best label that still has room, the surest rows first."""
    n, parts = scores.shape
    ranked = np.argsort(-scores, axis=1)
    two = np.take_along_axis(scores, ranked[:, : min(2, parts)], axis=1)
    order = np.argsort(-(two[:, 0] - two[:, -1]), kind="stable")
    room, label = [capacity] * parts, np.empty(n, np.int32)
    for i in order:
        for j in ranked[i]:
            if room[j] > 0:
                room[j] -= 1
                label[i] = j
                break
    return label


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng, slack: float = 1.15) -> np.ndarray:
    """Labels 0..parts-1 of nearly equal sizes that cut few edges of ``graph``.

    Starts from spherical k-means and moves rows towards the labels of their neighbours while the
    sizes stay within ``slack`` of the mean.
    """
    n = len(x)
    capacity = math.ceil(slack * n / parts)
    centres = x[rng.choice(n, parts, replace=False)].copy()
    for _ in range(6):
        label = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        size = np.linalg.norm(sums, axis=1)
        empty = size == 0
        sums[empty] = x[rng.choice(n, int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    geometry = x @ centres.T
    label = _fill(geometry, capacity)
    rows = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(4):
        votes = np.bincount(rows * parts + label[graph].ravel(), minlength=n * parts).reshape(n, parts)
        label = _fill(votes / graph.shape[1] + geometry, capacity)
    return label


def fit_layer(x: np.ndarray, parts: int, seed: int = 7, epochs: int = 12) -> Layer:
    """Partition the sample's neighbour graph and learn to predict the partitions of neighbours."""
    rng = np.random.default_rng(seed)
    x = np.ascontiguousarray(x, np.float32)
    graph = neighbour_graph(x, 10)
    label = balanced_partition(x, graph, parts, rng)
    n = len(x)
    target = np.bincount(
        np.repeat(np.arange(n), graph.shape[1]) * parts + label[graph].ravel(), minlength=n * parts
    ).reshape(n, parts)
    target = (target / graph.shape[1] * 0.5).astype(np.float32)
    target[np.arange(n), label] += 0.5
    w, b = np.zeros((x.shape[1], parts), np.float32), np.zeros(parts, np.float32)
    m, v, step = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)], 0
    scaled = x * np.float32(math.sqrt(x.shape[1]))
    for epoch in range(epochs):
        rate = 0.05 * (1 - epoch / epochs) + 0.002
        order = rng.permutation(n)
        for s in range(0, n, 512):
            i = order[s : s + 512]
            z = scaled[i] @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[i]) / len(i)
            step += 1
            for k, (value, grad) in enumerate(((w, scaled[i].T @ g), (b, g.sum(0)))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                value -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Layer(w * np.float32(math.sqrt(x.shape[1])), b)


def sample_units(df: DataFrame, vec_col: str, total: int, most: int, dim: int) -> tuple[np.ndarray, float]:
    """At most ``most`` distinct usable vectors as unit rows, chosen by a hash, and about how many there are in all."""

    def packed(batches):
        for b in batches:
            at, rows = usable_rows(b.column(0), dim)
            if len(rows):
                h, first = np.unique(b.column(1).to_numpy(zero_copy_only=False)[at], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pack(unit(rows[first]))], names=["h", "v"])

    share = min(1.0, 1.1 * most / max(total, 1))
    keyed = df.select(vec_col, vector_key(vec_col).alias("h"))
    while True:
        chosen = keyed.where(F.pmod(F.xxhash64(F.lit(11), "h"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
        got = chosen.mapInArrow(packed, "h long, v binary").dropDuplicates(["h"]).limit(2 * most).toArrow()
        if share == 1 or 2 * len(got) >= most:
            break
        share = min(1.0, share * min(16.0, 1.1 * most / max(len(got), 1)))  # many copies: a larger share
    order = np.argsort(got.column("h").to_numpy())[:most]
    return unpack(got.column("v"), dim)[order], len(got) / share


def dense_groups(x: np.ndarray, least: float, members: float, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(row in the middle, rows covered) of the groups of at least ``members`` rows that resemble one row."""
    n, free, leads, sizes = len(x), np.ones(len(x), bool), [], []
    count = np.concatenate([np.count_nonzero(x[s : s + block] @ x.T >= least, axis=1) for s in range(0, n, block)])
    while n and count[lead := int(np.where(free, count, 0).argmax())] >= members and free[lead]:
        took = np.flatnonzero(free & (x @ x[lead] >= least))
        took = took if len(took) else np.array([lead])
        leads.append(lead), sizes.append(len(took))
        free[took] = False
        for s in range(0, n, block):
            count[s : s + block] -= np.count_nonzero(x[s : s + block] @ x[took].T >= least, axis=1)
    return np.asarray(leads, np.int64), np.asarray(sizes, np.int64)


def fit_partitions(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    rows_per_partition: int,
    mean_probes: float,
    max_probes: int = 8,
    fanout: int = FANOUT,
    sample_most: int = SAMPLE_MOST,
    dim: int = DIM,
    least: float = 0.86,
) -> PartitionModel:
    """Fit the routing model for ``df``; the margin is set so that a row has ``mean_probes`` on average.

    Rows of dense groups, found for pairs with a cosine of ``least`` or more, don't count for it.
    """
    total = df.count()
    want = math.ceil(total / rows_per_partition)
    if want <= 1:
        return PartitionModel(max_probes=max_probes)
    two = want > fanout
    first = min(fanout, math.ceil(math.sqrt(want))) if two else want
    most = min(sample_most, first * SAMPLE_PER_PARTITION)
    x, distinct = sample_units(df, vec_col, total, most, dim)
    model = PartitionModel(max_probes=max_probes, least=least)
    scale = distinct / max(len(x), 1)
    leads, sizes = dense_groups(x, least, max(DENSE_LEAST, rows_per_partition / 2 / max(scale, 1)))
    if len(leads):
        model.dense = x[leads]
        model.blocks = np.ceil(sizes * scale / (DENSE_BLOCK * rows_per_partition)).astype(np.int64)
        x = x[(x @ model.dense.T).max(axis=1) < least]
    first = min(first, len(x) // 12)
    if first <= 1:
        return model
    model.top = fit_layer(x, first)
    if two:
        second = min(fanout, math.ceil(want / first))
        _fit_below(df, vec_col, model, total, second, sample_most, dim)
    model.margin = _margin(model, x[:4000], mean_probes)
    return model


def _fit_below(df, vec_col, model, total, parts, sample_most, dim) -> None:
    """One classifier inside each partition of the first layer, fitted in parallel."""
    top, first, dense, least = model.top, len(model.top.bias), model.dense, model.least
    want = min(sample_most, parts * SAMPLE_PER_PARTITION)
    share = min(1.0, first * want / max(total, 1))

    def routed(batches):
        for b in batches:
            _, rows = usable_rows(b.column(0), dim)
            if len(rows):
                x = unit(rows).astype(np.float32)
                if dense is not None:
                    x = x[(x @ dense.T).max(axis=1) < least]
                part = np.argmax(top.log_probabilities(x), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), pack(x)], names=["c", "v"])

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(group["v"].drop_duplicates()[: 2 * want]), np.float32).reshape(-1, dim)
        own = min(parts, len(x) // 12)
        if own <= 1:
            return pd.DataFrame({"c": [], "w": [], "b": []})
        layer = fit_layer(x, own)
        return pd.DataFrame({"c": [group["c"].iloc[0]], "w": [layer.weights.tobytes()], "b": [layer.bias.tobytes()]})

    chosen = df.where(F.pmod(F.xxhash64(F.lit(13), vector_key(vec_col)), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = (
        chosen.select(vec_col)
        .mapInArrow(routed, "c int, v binary")
        .groupBy("c")
        .applyInPandas(fitted, "c int, w binary, b binary")
        .collect()
    )
    sizes = np.ones(first, np.int64)
    for r in got:
        bias = np.frombuffer(bytes(r["b"]), np.float32)
        model.below[r["c"]] = Layer(np.frombuffer(bytes(r["w"]), np.float32).reshape(dim, -1), bias)
        sizes[r["c"]] = len(bias)
    model.offsets = np.r_[0, np.cumsum(sizes)]


def _margin(model: PartitionModel, x: np.ndarray, mean_probes: float) -> float:
    """The largest log-probability gap to the best partition at which ``x`` has ``mean_probes``."""
    row, _, score = model.candidates(x, 12.0)
    best = np.full(len(x), -np.inf)
    np.maximum.at(best, row, score)
    gaps = np.sort(best[row] - score)
    return float(gaps[min(len(gaps) - 1, int(mean_probes * len(x)) - 1)])
