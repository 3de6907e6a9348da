import hashlib
import re

import pytest
from pyspark.sql import functions as F

from moraine.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


TEXTS = [
    None, "", "nothing here", "mail a.b+c@x-y.co.uk, or z@q.org.", "a@b.c_d@e.f@g.h", "x@y no dot @ a@.b a@b..c", "é🎉 me@site.com 🎉 you@site.org",
    "10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 000255.1.2.3 1.2.3 99999999999999999999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004",
    "card 4111  1111 1111 1111", "1" * 50_000, "a" * 60_000, "a@b" + ".c" * 30_000, "1.2" * 20_000, "+1 (555) 123-4567 or +49.30.1234567 +1 2 +" + "(" * 3000,
    "+12345678901234567", "IBAN GB82 WEST 1234 5698 7654 32 in the bank", "GB82WEST12345698765433", "my ssn is 123-45-6789", "part 123-45-6789 of a serial number",
    "social security 000-12-3456", "mail " + " ".join(f"u{i}@h{i}.org" for i in range(400)),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null@id.org", "c"), (1, "", "c")], "doc_id long, text string, spans string")
    return docs, pii.find_pii(docs)


def test_base_spans_equal_brute_force(found):
    docs, got = found
    rows = got.select("text", pii._joined(*pii.BASE).alias("base")).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert [x for x in r["base"].split(",") if x] == brute(r["text"]), (r["text"] or "")[:60]


def test_columns_stay_and_text_of_spans_is_the_text(found):
    docs, got = found
    assert got.columns == [*docs.columns, "pii"]
    for r in got.collect():
        for spans in r["pii"]:
            assert all(r["text"][s["start"] : s["end"]] == s["text"] and 0 <= s["score"] <= 1 for s in spans)


def test_the_method_adds_checked_spans(found):
    rows = {r["text"]: r["pii"] for r in found[1].collect()}
    iban = rows["IBAN GB82 WEST 1234 5698 7654 32 in the bank"]["iban"]
    assert [(s["text"], s["score"]) for s in iban] == [("GB82 WEST 1234 5698 7654 32", 1.0)]
    assert not rows["GB82WEST12345698765433"]["iban"]
    assert [s["text"] for s in rows["my ssn is 123-45-6789"]["ssn"]] == ["123-45-6789"]
    assert not rows["part 123-45-6789 of a serial number"]["ssn"] and not rows["social security 000-12-3456"]["ssn"]
    scores = [s["score"] for s in rows["mail a.b+c@x-y.co.uk, or z@q.org."]["email"]]
    assert scores == [1.0, 0.9] or scores == [1.0, 1.0]


def test_query_on_files(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op7_pii(spark, str(tmp_path)).collect():
        want = brute(TEXTS[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(x.startswith(k) for x in want) for k in PLAIN]
        assert r["spans"].startswith(",".join(want))


def test_no_python_and_no_shuffle(found):
    plan = found[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("lengths", [[5], [1, 2], [3, 0, 0, 4], list(range(50))])
def test_running_sums(spark, lengths):
    df = spark.createDataFrame([(lengths,)], "x array<int>")
    assert df.select(pii._running(F.col("x"))).first()[0] == [sum(lengths[:i]) for i in range(len(lengths))]
