import datetime as dt

import pytest

from moraine.llm import common
from moraine.llm import url_filter as uf

from ..oracle import connect, normal


def day(n):
    return dt.date(2024, 1, n)


def entries(spark, rows):
    return spark.createDataFrame([(x, r, d, a) for x, r, d, a in rows], "list string, rule string, day date, action string")


def judged(spark, captures, listed):
    df = spark.createDataFrame([(i, u, f, "c") for i, (u, f) in enumerate(captures)], "page_id long, url string, fetched date, list string")
    return {r["page_id"]: (r["rule"], r["list_"], r["kept"]) for r in uf.judge(df, entries(spark, listed)).collect()}


LISTED = [
    ("a", "bad.com", day(5), "add"), ("a", "bad.com", day(10), "remove"), ("a", "bad.com", day(20), "add"), ("b", "good.org/ads", day(1), "add"),
    ("b", "sub.bad.com", day(6), "add"), ("b", "Twice.net", day(3), "add"), ("a", "twice.net", day(3), "add"), ("a", "off.net", day(3), "add"), ("a", "off.net", day(3), "remove"),
    (None, None, day(1), "add"), ("a", "nodate.com", None, "add"), ("a", "noact.com", day(1), None),
    ("a", "[2001:db8::1]", day(1), "add"), ("a", "2.3", day(1), "add"), ("a", "Case.org/Ads", day(1), "add"),
]


CAPTURES = [
    ("http://bad.com/x", day(4), None), ("http://bad.com/x", day(5), ("bad.com", "a")), ("http://bad.com/x", day(9), ("bad.com", "a")), ("http://bad.com/x", day(10), None),
    ("http://bad.com/x", day(25), ("bad.com", "a")), ("https://user:pw@SUB.Bad.com.:8080/x?q#f", day(7), ("sub.bad.com", "b")), ("http://deep.sub.bad.com", day(5), ("bad.com", "a")),
    ("http://notbad.com/", day(25), None), ("http://good.org/ads?x", day(2), ("good.org/ads", "b")), ("http://good.org/adsx", day(2), None), ("http://good.org/", day(2), None),
    ("http://twice.net", day(3), ("twice.net", "a")), ("http://off.net", day(9), None), (None, day(9), None), ("no url", day(9), None), ("http:///x", day(9), None), ("http://bad.com", None, ("bad.com", "a")),
    ("http://nodate.com", day(9), None), ("http://noact.com", day(9), None), ("http://[2001:db8::1]:80/x", day(9), ("[2001:db8::1]", "a")), ("http://[2001:db8::2]/x", day(9), None), ("http://[::1]:80/", day(9), None),
    ("http://bad.com\\x", day(6), ("bad.com", "a")), ("http://good.org\\ads", day(6), ("good.org/ads", "b")), ("http://a@b@bad.com/", day(6), ("bad.com", "a")), ("http://10.1.2.3/", day(6), None),
    ("http://case.org/Ads", day(6), ("case.org/Ads", "a")), ("http://case.org/ads", day(6), None), ("", day(6), None), ("http://bad.com/" + "x" * 100_000, day(6), ("bad.com", "a")),
]


@pytest.mark.parametrize("heavy", [1000, 1])
def test_the_entry_active_at_fetch_time_decides(spark, monkeypatch, heavy):
    monkeypatch.setattr(common, "LEAST_HEAVY", heavy)
    twice = [(u, f) for u, f, _ in CAPTURES for _ in range(2)]
    got = judged(spark, twice, LISTED)
    for i, (u, f) in enumerate(twice):
        want = CAPTURES[i // 2][2]
        assert got[i] == (*(want or (None, None)), want is None), (u, f)


def test_empty(spark):
    assert judged(spark, [], LISTED) == {}
    assert judged(spark, [("http://bad.com", day(6))], []) == {0: (None, None, True)}


def test_intervals(spark):
    got = {(r["rule"], r["since"], r["until"]) for r in uf.intervals(entries(spark, LISTED[:3])).collect()}
    assert got == {("bad.com", day(5), day(10)), ("bad.com", day(20), dt.date(9999, 12, 31))}


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = normal(uf.op4_url_filter(spark, sf).toPandas())
    assert got.equals(normal(connect(sf).sql(uf.SQL).df()))
    assert {rule.count("/") for rule in got["rule"] if rule != "null"} == {0, 1}  # domains and paths
    assert 10 < (got["kept"] == "False").sum() < 240


def test_no_broadcast_of_lists(spark):
    plan = uf.op4_url_filter(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan
