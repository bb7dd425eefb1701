import numpy as np
import pytest


@pytest.fixture
def vectors(spark):
    """(ids, vectors) -> table of assets, with more columns whose names clash with those used inside."""

    def make(ids, rows, scores=None):
        data = [(i, None if v is None else [None if x is None else float(x) for x in v], None if scores is None else scores[k], k, "x", b"y", -1) for k, (i, v) in enumerate(zip(ids, rows))]
        return spark.createDataFrame(data, "asset_id string, embedding array<float>, score double, part int, h string, v binary, id long")

    return make


def clustered(seed, sizes, alone=40, noise=0.18, dim=64):
    """Unit vectors in tight groups and alone."""
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        for _ in range(n):
            e = rng.normal(size=dim)
            out.append(c + noise * e / np.linalg.norm(e))
    out += list(rng.normal(size=(alone, dim)))
    return np.asarray(out, np.float32)
