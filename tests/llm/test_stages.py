"""Stages and operators that return the columns of docs: rows as the operator decides, columns as they were."""

import datetime as dt

import pytest

from moraine.llm import bpe, common, exact_dedup, langid, minhash, mixing, pii, url_filter

CLASHING = ("lang_pred", "score", "size", "i", "times", "n", "ids", "pii", "rule", "list", "kept", "body", "k", "part", "_slot", "_own_id", "_found", "_host", "digest", "n_tokens")
WORDS = "the quick brown fox jumps over the lazy dog and runs through the long green field to find some food for all of its young ones".split()
B = " ".join(WORDS)
ROWS = [
    (1, "aa bb cc", "s"), (1, B, "s"), (2, "AA bb cc", "t"), (None, "aa bb cc", "s"), (None, "cc dd", None), (3, B + " today", "s"), (4, "", "s"), (5, None, "t"),
    (6, "zz yy", "s"), (6, "zz yy", "s"), (6, "zz yy", "s"), (None, "cc dd", None), (7, "der Hund und die Katze sind im Haus", "t"), (8, "el perro y el gato en la casa", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, url string, fetched date, " + ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, "de" if t and "der" in t else "en", s, f"http://h{n}.org/x", dt.date(2024, 1, 2), *[f"{c}{n}" for c in CLASHING]) for n, (i, t, s) in enumerate(ROWS)]
    return spark.createDataFrame(rows, schema)


def identified(docs):
    return langid.identify(docs, langid.learn(docs))


def judged(docs):
    entries = docs.sparkSession.createDataFrame([("a", "h1.org", dt.date(2024, 1, 1), "add")], "list string, rule string, day date, action string")
    return url_filter.judge(docs, entries)


STAGES = [langid.keep_identified, exact_dedup.keep_first, minhash.keep_representatives, mixing.mixed_documents]
ADDING = [identified, bpe.encode_documents, bpe.encode_and_decode, pii.find_pii, judged]


@pytest.mark.parametrize("stage", STAGES + ADDING, ids=lambda f: f.__name__)
def test_columns_come_back_unchanged(docs, stage):
    out = stage(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and (stage in ADDING) == (len(out.columns) > len(docs.columns))
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    given = [tuple(r) for r in docs.collect()]
    got = [tuple(r)[: len(docs.columns)] for r in out.collect()]
    assert set(got) <= set(given)
    assert stage in STAGES or sorted(got, key=repr) == sorted(given, key=repr)


def pairs(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=repr)


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_exact_dedup_keeps_the_rows_that_it_says(docs, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    want = [(1, B), (2, "AA bb cc"), (None, "cc dd"), (None, "cc dd"), (3, B + " today"), (5, None), *[(6, "zz yy")] * 3, *((i, t) for i, t, _ in ROWS[-2:])]
    assert pairs(exact_dedup.keep_first(docs).collect()) == sorted(want, key=repr)


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_near_dedup_keeps_the_rows_that_it_says(docs, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    want = [r[:2] for r in ROWS if r[:2] not in ((2, "AA bb cc"), (3, B + " today"))]
    assert pairs(minhash.keep_representatives(docs).collect()) == sorted(want, key=repr)


def test_a_link_of_a_repeated_id_is_found_whatever_its_other_text(spark):
    """Ids that stand for two texts have the links of both."""
    given = spark.createDataFrame([(1, "another text of five words or more"), (1, B), (2, B + " today"), (3, "another text of five words or more")], "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(given).select("doc_id", "component_id", "kept").collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_null_and_repeated_rows_share_their_turns(docs):
    """What the mix takes of each id and text is what the documents of the mix hold."""
    want, n = {}, {}
    for r in mixing.decide(docs).collect():
        key = (r["doc_id"], r["source"], r["body"])
        want[key] = want.get(key, 0) + (r["times"] if r["size"] else 1)
        n[key] = n.get(key, 0) + 1
    assert sum(n.values()) == len(ROWS)
    body = {(r["doc_id"], r["source"], r["text"]): r["b"] for r in docs.select("*", mixing._body(docs["text"]).alias("b")).collect()}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        key = (r["doc_id"], r["source"], body[r["doc_id"], r["source"], r["text"]])
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_mixing_rows_that_are_all_alike(spark, monkeypatch):
    """A third of all rows with one id and text, and null ids, are dealt over slices and taken near their target."""
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(None, "a b c", "x")] * 400 + [(9, "one two", "y")] * 300 + [(i, "w " * (i % 9), "z") for i in range(200)]
    given = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(given).collect()
    assert len(got) == len(rows)
    for source in "xyz":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10 and all(r["taken"] <= 2 * r["size"] for r in own)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(given.repartition(3)).collect()), key=repr)
    mixed = mixing.mixed_documents(given).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(r["taken"] for r in got)
    times = {}
    for r in mixed:
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert times[None, "a b c"] == sum(r["taken"] for r in got if r["doc_id"] is None) // 3
