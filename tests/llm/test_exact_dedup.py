import hashlib

import pytest

from moraine.llm import exact_dedup as ed
from moraine.llm.common import shared_dir

SCHEMA = "doc_id long, text string, text2 string, lang string, keep_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, "clash") for i, t in rows], SCHEMA)


def brute(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256((t or "").translate(fold).encode()).hexdigest(), []).append(i)
    out = []
    for h, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep if keep is not None else True, h) for i in ids]
    return out


CASES = {
    "groups": [(1, "Hello World"), (2, "hello world"), (3, "HELLO WORLD "), (4, ""), (5, None), (6, "É"), (7, "é"), (8, "x" * 300_000), (9, "X" * 300_000)],
    "nulls and repeats": [(None, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "c"), (2, "d")],
    "empty": [],
}


@pytest.mark.parametrize("rows", CASES.values(), ids=CASES.keys())
def test_equals_brute_force(spark, rows):
    got = [tuple(r) for r in ed.deduplicate(docs(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_heavy_and_light_groups(spark):
    rows = [(i, "copy") for i in range(1500)] + [(10_000 + i, f"t{i % 700}") for i in range(1400)]
    got = [tuple(r) for r in ed.deduplicate(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_later_batches_meet_the_index(spark):
    index = ed.DigestIndex(spark, shared_dir(spark), buckets=4)
    ed.deduplicate(docs(spark, [(1, "a"), (2, "A"), (3, "b")]), index).collect()
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in ed.deduplicate(docs(spark, [(7, "a"), (8, "c")]), index).collect()}
    assert again == {7: (2, False), 8: (8, True)}
    assert index.table().count() == 3
    reopened = ed.DigestIndex(spark, index.path, "reopened_digests", buckets=4)
    assert [r["doc_id"] for r in ed.keep_first(docs(spark, [(9, "B"), (10, "d")]), reopened).collect()] == [10]
    detail = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect()}
    assert detail["Num Buckets"] == "4" and "digest" in detail["Sort Columns"]


def test_keep_first_returns_the_columns_of_docs(spark):
    given = docs(spark, [(1, "a"), (2, "a"), (None, "a"), (None, "z"), (3, "b")])
    kept = ed.keep_first(given)
    assert kept.columns == given.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "z"), (2, "a"), (3, "b")]


def test_keep_first_keeps_other_texts_of_a_losing_id(spark):
    kept = ed.keep_first(docs(spark, [(1, "a"), (2, "A"), (1, "unique"), (3, "b")]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "unique"), (2, "A"), (3, "b")]
