import random

import pytest

from moraine.llm import mixing

SCHEMA = "doc_id long, text string, source string, target string, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "clash", None) for i, t, s in rows], SCHEMA)


def fair(sizes):
    """Targets by raising a common level, a source at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def corpus(seed, n, sources, longest=60):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.randrange(longest)), rng.choices(sources, [8] + [1] * (len(sources) - 1))[0]) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b"], ["é", "z", "Z", None, "🎉", "ab"], [f"s{i}" for i in range(15)]])
@pytest.mark.parametrize("slice_rows", [20_000, 50])
def test_targets_and_taken(spark, monkeypatch, sources, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = corpus(len(sources), 900, sources)
    got = mixing.mix(docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, len(t.split())) for i, t, _ in rows]
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    want = fair(sizes)
    for s in sizes:
        own = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 61
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (None, "x y z", "a"), (None, "x y z", "a"), (4, "p q", "b"), (4, "p q", "b"), (4, "p q r", "b"), (5, " \t  \x1f", "c")]
    got = mixing.mix(docs(spark, rows)).collect()
    sizes = sorted((str(r["doc_id"]), r["size"]) for r in got)
    assert sizes == sorted([("1", 0), ("2", 0), ("3", 2), ("None", 3), ("None", 3), ("4", 2), ("4", 2), ("4", 3), ("5", 2)])
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_empty(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mixed_documents(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, "a"), (2, "", None)])).count() == 2


def test_mixed_documents_repeat_as_taken(spark):
    rows = corpus(9, 400, ["a", "b", None]) + [(7, "same id", "b"), (7, "same id", "b")]
    given = docs(spark, rows)
    out = mixing.mixed_documents(given)
    assert out.columns == given.columns
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.mix(given).collect())


@pytest.mark.parametrize("slice_rows", [20_000, 50])
def test_the_queue_equals_a_plain_one(spark, monkeypatch, slice_rows):
    from .plain import queue

    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = corpus(3, 700, ["a", "b", None, "é"]) + [(9, "same row", "b"), (9, "same row", "b"), (None, "no id", "a"), (None, "no id", "a"), (8, None, "a")]
    dealt = max(len(rows) // slice_rows, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1)
    got = sorted((str(r["doc_id"]), str(r["source"]), r["size"], r["taken"]) for r in mixing.mix(docs(spark, rows)).collect())
    size = [len((t or "").split()) for _, t, _ in rows]
    want = [(str(i), str(s), n, n * x) for (i, _, s), n, x in zip(rows, size, queue(rows, 1 << dealt.bit_length()), strict=True)]
    assert got == sorted(want)
