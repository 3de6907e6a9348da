import random
import re

import numpy as np
import pytest

from moraine.llm import minhash as mh

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    out = []
    for k, (i, s) in enumerate(sets):
        c = least[root(k)] if i is not None else None
        out.append((i, len(s), c, i is None or i == c))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bands int")
    got = [tuple(r) for r in mh.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_small_cases(spark):
    check(
        spark,
        [
            (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A  b\tc\nd "), (8, "a b c d e"), (9, "x y z"), (10, "É é"),
            (None, "a b c d e"), (11, "a b c d e"), (11, "a b c d e"), (12, "long " * 50_000), (13, "long " * 60_000 + "end"), (14, "w" * 200_000),
        ],
    )


def test_empty(spark):
    check(spark, [])


def mutated(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_near_copies_equal_brute_force(spark):
    rng, rows, at = random.Random(1), [], 0
    for _ in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        for copy in range(rng.randrange(1, 8)):
            rows.append((at := at + 1, " ".join(mutated(rng, words, copy))))
    check(spark, rows)


def test_a_hot_group_around_the_threshold_and_a_common_passage(spark):
    rng, rows = random.Random(2), []
    words = [f"w{i}" for i in range(140)]
    rows += [(i, " ".join(mutated(rng, words, rng.randrange(1, 7)))) for i in range(150)]
    passage = [f"p{i}" for i in range(60)]
    rows += [(1000 + i, " ".join(passage + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60))])) for i in range(150)]
    check(spark, rows)


def test_short_near_copies_inside_long_ones(spark):
    """Buckets whose hub is too long to be like the others must not hide the links among these."""
    rng, rows, at = random.Random(3), [], 0
    for _ in range(10):
        words = [f"w{rng.randrange(9000)}" for _ in range(200)]
        longer = words + [f"w{rng.randrange(9000)}" for _ in range(120)]
        for copy in range(3):
            rows += [(at := at + 1, " ".join(mutated(rng, longer, copy))), (at := at + 1, " ".join(mutated(rng, words, copy)))]
    check(spark, rows)


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 1 << 63, n - n * 3 // 4, dtype=np.uint64)])
        x, y = mh.sketches([a, b])
        assert (x != mh.EMPTY).all() and (y != mh.EMPTY).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((x == y).mean() - true) < 0.2
    assert (mh.sketches([np.zeros(0, np.uint64)]) == mh.EMPTY).all()


def test_words_across_segments(monkeypatch):
    text = ("Word" + " x" * 30 + "\n\tlonger-word ") * 20
    whole = mh.WordHasher().words(text.encode())
    monkeypatch.setattr(mh, "SEGMENT", 16)
    cut = mh.WordHasher().words(text.lower().encode())
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert len(whole[0]) == len(text.split())


@pytest.mark.parametrize("links", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (9, 8), (2, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 80)]])
def test_components(spark, links):
    from moraine.llm.components import connected_components

    parent = {x: x for pair in links for x in pair}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
