import numpy as np
import pytest

from tessera.llm import queries, vectors


def brute(rows):
    """{position: (n_links, component)} by comparing all with all."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    def fine(v):
        return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)

    n = [0] * len(rows)
    x = [np.array(v, np.float32).astype(np.float64) if fine(v) else None for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and rows[i][2] is not None and rows[i][2] == rows[j][2]:
                a, b = x[i] / abs(x[i]).max(), x[j] / abs(x[j]).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    n[i] += 1
                    n[j] += 1
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted([(k, n[i], least.get(find(i)), k == least.get(find(i))) for i, (k, _, _) in enumerate(rows)], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(a, b, c, 1, "x") for a, b, c in rows], "vec_id long, embedding array<float>, label int, n int, root string")
    return sorted((tuple(r) for r in vectors.near_duplicates(df).collect()), key=str)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose((vectors.hadamard(x) ** 2).sum(1), 16 * (x**2).sum(1)) and np.allclose(vectors.hadamard(vectors.hadamard(x)), 16 * x)


def test_signatures_name_the_nearest_axes():
    s = vectors.signatures(np.eye(8)[:3] * 5, 2)
    assert s.shape == (3, vectors.TABLES, 1 + 2 * vectors.PROBES) and all(len(set(t)) == len(t) for r in s for t in r.tolist())


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(5, v, 1), (3, v, 1), (3, v, 1), (9, v, 2), (8, [2.0, 4.0, 6.0, 8.0], 1), (7, v, None), (None, v, 3), (None, v, 3), (None, [1.0, 2.0, 3.0, 4.001], 3), (10, None, 1), (11, [0.0] * 4, 1), (12, [1.0, None, 2.0, 3.0], 1), (13, [float("nan")] * 4, 1), (14, [float("inf"), 1.0, 1.0, 1.0], 1), (15, [], 1), (16, [1.0, 2.0, 3.0], 1), (17, [1e-38, 2e-38, 3e-38, 4e-38], 1), (18, [1e38, 2e38, 3e38, 3.4e38], 1), (19, [-1.0, -2.0, -3.0, -4.0], 1), (20, [5.0], 4), (21, [7.0], 4)]
    assert [r[:3] for r in run(spark, rows)] == [r[:3] for r in brute(rows)]
    assert {r[0]: r[3] for r in run(spark, rows) if r[0] is not None} == {r[0]: r[3] for r in brute(rows) if r[0] is not None}


def test_empty(spark):
    assert run(spark, []) == []


def test_big_buckets_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(150)] + [(1000 + i, (centre + rng.normal(size=16) * 0.35).tolist(), 1) for i in range(150)] + [(2000 + i, rng.normal(size=16).tolist(), 1 + i % 2) for i in range(100)]
    rows += [(3000 + i, rows[0][1], 1) for i in range(20)]
    want = run(spark, rows)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    assert run(spark, rows) == want
    assert sum(r[1] for r in want) > 0.999 * sum(r[1] for r in brute(rows))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_recall(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got, want = sorted((tuple(r) for r in queries.op7_embedding_cross_polytope(spark, d).collect()), key=str), brute(rows)
    assert len(got) == len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(r[1] for r in got) >= 0.995 * sum(r[1] for r in want)


def test_recall_on_planted_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 64))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    for k, noise in enumerate((0.05, 0.12, 0.18)):  # cosines about 0.999, 0.993, 0.984
        rows += [(1000 * (k + 1) + i, (v + noise * rng.normal(size=64)).tolist(), i % 3) for i, v in enumerate(base)]
    got, want = run(spark, rows), brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert there > 2000 and 0.99 * there <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("axes", [2, 3])
def test_recall_with_several_axes(spark, axes):
    """As in tables of more than 10 ** 5 and 10 ** 8 vectors."""
    rng = np.random.default_rng(13)
    base = rng.normal(size=(500, 64))
    near = np.concatenate([base, base + 0.195 * rng.normal(size=base.shape)])  # cosines of about 0.981
    pairs = {i for i in range(500) if near[i] @ near[500 + i] / np.linalg.norm(near[i]) / np.linalg.norm(near[500 + i]) >= 0.98}
    df = spark.createDataFrame([(i, 1, v.tolist(), 1) for i, v in enumerate(near)], "cid long, label long, v array<double>, m long")
    found = {r.cid for r in vectors.linked(df, axes).collect()}
    assert len(pairs) > 200 and len({i for i in pairs if i in found}) >= 0.97 * len(pairs)


def test_doubles_are_compared_as_doubles(spark):
    """A pair that is above the limit in doubles and would be below it as floats, or the other way round, counts by its doubles."""
    rng = np.random.default_rng(14)
    rows = []
    for i in range(400):
        x = rng.normal(size=8)
        x /= np.linalg.norm(x)
        y = rng.normal(size=8)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        c = 0.98 + (1 if i % 2 else -1) * 2e-9
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, (c * x + np.sqrt(1 - c * c) * y).tolist(), i)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert all(r.n_links == (r.vec_id // 2) % 2 for r in got)
