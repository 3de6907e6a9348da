import numpy as np
import pytest

from moraine.llm import common
from moraine.llm import embedding_dedup as ed


def brute(rows):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.9 - 1e-12:
                links[a].add(b)
                links[b].add(a)
    out, seen = {}, set()
    for k in links:
        if k not in seen:
            stack, group = [k], {k}
            while stack:
                for m in links[stack.pop()] - group:
                    group.add(m)
                    stack.append(m)
            seen |= group
            for m in group:
                out[m] = min(good[g][0] for g in group)
    result = [(good[k][0], len(links[k]), out[k], good[k][0] == out[k]) for k in links]
    ids = [i for i, _ in good]
    rest = [(i, 0, i, True) for i, v in rows if not any(g is i or g == i for g in ids)]
    return result + rest


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n string")
    got = [tuple(r) for r in ed.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    check(
        spark,
        [(1, a), (1, [5.0, -1.0, 0.5]), (1, [5.0, -1.0, 0.5]), (21, [5.0, -1.0, 0.6]), (2, a), (3, [2.0, 4.0, 6.0]), (4, [-1.0, -2.0, -3.0]), (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 3.0]), (9, [float("nan"), 1.0, 1.0]),
         (10, [float("inf"), 1.0, 1.0]), (11, [1.0, 2.0]), (None, a), (12, [1.0, 2.0, 3.1]), (12, [1.0, 2.0, 3.1])],
    )


def test_empty(spark):
    check(spark, [])


def clusters(seed, n, size, noise, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        centre = rng.standard_normal(dim)
        rows += [[float(x) for x in np.float32(centre + noise * rng.standard_normal(dim))] for _ in range(size)]
    rng.shuffle(rows)
    return [(100 + i, v) for i, v in enumerate(rows)]


def test_clusters_equal_brute_force(spark):
    check(spark, clusters(3, 60, 5, 0.15))


def test_runs_longer_than_the_window(spark, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 8)
    check(spark, clusters(4, 3, 90, 0.05), passes=6)


def test_what_leaves_the_tasks_is_linear_in_a_cluster(spark, monkeypatch):
    """One cluster of distinct vectors: degrees are exact, and twice the vectors give about twice the rows."""
    monkeypatch.setattr(ed, "BLOCK", 64)
    rows, put = [], common.Stash.put

    def counted(self, df, name):
        out = put(self, df, name)
        if name.startswith(("windows", "far", "squares")):
            rows[-1] += out.count()
        return out

    monkeypatch.setattr(common.Stash, "put", counted)
    for n in (1500, 3000):
        x = np.array([v for _, v in clusters(8, 1, n, 0.25)], np.float32)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
        rows.append(0)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicates(df, passes=3).collect()}
        x = x.astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        want = (x @ x.T >= ed.THRESHOLD).sum(1) - 1
        assert want.sum() > 100 * n and all(got[i] == (want[i], 0) for i in range(n))
    assert rows[1] < 3 * rows[0], rows


def test_double_vectors_keep_their_precision(spark):
    a = [1.0, 0.0]
    cosine = lambda v: v[0] / np.sqrt(v @ v)
    c = 0.9 - 1e-9
    tried = (np.array([c, np.sqrt(1 - c * c)]) * k for k in np.linspace(1, 2, 1000))
    near = next(v.tolist() for v in tried if cosine(v) < 0.9 <= cosine(v.astype(np.float32).astype(np.float64)))
    df = spark.createDataFrame([(1, a), (2, near)], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in ed.near_duplicates(df).collect()] == [0, 0]


def test_recall_at_the_default_block(spark):
    """18,000 vectors in all directions with 2,000 pairs planted just above the threshold, over many windows."""
    rng, n, pairs, dim = np.random.default_rng(12), 18_000, 2000, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = rng.standard_normal((pairs, dim))
    turn -= (turn * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    x[pairs : 2 * pairs] = 0.902 * x[:pairs] + np.sqrt(1 - 0.902**2) * turn
    df = spark.createDataFrame([(i, v) for i, v in enumerate(np.float32(x).tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["component_id"] for r in ed.near_duplicates(df).collect()}
    assert len(got) == n and sum(got[pairs + i] == i for i in range(pairs)) / pairs >= 0.98


def test_passes_grow_with_the_number_of_vectors():
    assert ed.passes_for(100) == 2
    assert ed.passes_for(10_000) < ed.passes_for(1_000_000) < ed.passes_for(10**9)
    assert ed.passes_for(100_000, 0.99) < ed.passes_for(100_000, 0.9)


@pytest.mark.parametrize("a, b", [([0, 1, 2, 0], [1, 2, 0, 3])])
def test_forest_spans(a, b):
    left, right = ed._forest(np.array(a), np.array(b), 5)
    assert left.tolist() == [0, 0, 0] and right.tolist() == [1, 2, 3]


def cone(seed, n, pairs, dim=32):
    """Two thirds of n rows in all directions, a third at mutual cosine 0.75 around one, with pairs at cosine 0.901 among these."""
    rng = np.random.default_rng(seed)
    centre = np.eye(dim)[0]
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((n // 3 - pairs, dim))
    side[:, 0] = 0
    x = np.sqrt(0.75) * centre + np.sqrt(0.25) * unit(side)
    turn = rng.standard_normal((pairs, dim))
    turn[:, 0] = 0
    own = x[:pairs]
    turn = unit(turn - (turn * own).sum(1, keepdims=True) * own)
    y = 0.901 * own + np.sqrt(1 - 0.901**2) * turn
    return np.concatenate([x, y, unit(rng.standard_normal((n - n // 3, dim)))]).astype(np.float32)


@pytest.mark.parametrize("block", [8, 64])
def test_links_inside_a_dense_topic_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    n, pairs = 6000, 900
    x = cone(5, n, pairs)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_duplicates(df).collect()}
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= ed.THRESHOLD).sum(1) - 1
    assert len(got) == n and all(got[i][0] <= want[i] for i in range(n))
    # The model allows 0.005; three standard deviations more for chance.
    missed = 1 - sum(k for k, _ in got.values()) / want.sum()
    assert want.sum() >= 2 * pairs and missed <= ed.MISS + 3 * (ed.MISS / pairs) ** 0.5, missed
