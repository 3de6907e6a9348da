"""Personal data: regular expressions propose spans, validators confirm them, context adjusts the score.

All of it is one projection of built-in functions; nothing is shuffled. A kind's matches come from
regexp_extract_all and the text between them from split by the same pattern, so running sums of both
lengths give the offsets (code points). Patterns are written with possessive quantifiers and guards on
where they may start: they find what the plain forms find, leftmost and non-overlapping, but need time
linear in the text and no recursion on long digit or letter runs.

Kinds email, ip, card and phone are the base; valid base spans always stay. The method adds iban (mod-97)
and ssn (which has no checksum and stays only if a context word is near). A span's score is its
kind's prior, raised by CONTEXT words within NEAR characters of the gaps next to it.

Defined cases: null text counts as empty; empty texts have no spans (base_sha256 is then the digest of
the empty string); repeated rows and null ids are rows like others; further columns come back as they are, and if one
is named like the result, that gets an underscore behind its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

_LOCAL = "[A-Za-z0-9._%+-]"
# A later start in a run of local characters succeeds only if the run's first start does, where the run
# begins anew after the last match (\G). The same holds for digit runs and ip.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
BASE = ("email", "ip", "card", "phone")
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": "e?mails?|contact|write|reach",
    "ip": "ip|address|hosts?|servers?|login",
    "card": "cards?|credit|debit|visa|payments?",
    "phone": "phones?|telephone|call|tel|mobile|fax",
    "iban": "iban|accounts?|bank|transfers?",
    "ssn": "ssn|social|security",
}
NEAR, BOOST, LEAST = 40, 0.3, 0.5
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(lengths: Column) -> Column:
    """Sums of all lengths before each element, in steps of about the root of their number."""
    step = F.ceil(F.sqrt(F.size(lengths))).cast("int")

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def by_steps(begin: Column) -> Column:
        def before(x: Column, i: Column) -> Column:
            return F.get(begin, F.floor(i / step).cast("int")) + total(F.slice(lengths, i - F.pmod(i, step) + 1, F.pmod(i, step)))

        return F.transform(lengths, before)

    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int"))
    steps = F.transform(numbers, lambda b: total(F.slice(lengths, b * step + 1, step)))
    # Both arguments are bound first, or every element would compute them anew.
    return _let(steps, lambda whole: _let(F.transform(whole, lambda x, b: total(F.slice(whole, F.lit(1), b))), by_steps))


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """The check of ISO 7064 on an account number without spaces."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c < "A", 10).otherwise(100) + value(c)) % 97))
    return rest == 1


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return _let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _let(F.replace(text, F.lit(" ")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _spans(kind: str, text: Column, matches: Column) -> Column:
    """array<struct<kind, start, end, text, score>> of a kind's valid matches."""

    def located(gaps: Column) -> Column:
        def span(own: Column, i: Column, ends: Column) -> Column:
            start = F.get(ends, i) + F.length(F.get(gaps, i))
            near = F.lower(F.concat(F.right(F.get(gaps, i), F.lit(NEAR)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(NEAR))))
            score = F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near.rlike(rf"\b(?:{CONTEXT[kind]})\b"), BOOST).otherwise(0.0))
            return F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"), score.alias("score")
            )

        lengths = F.transform(matches, lambda own, i: F.length(F.get(gaps, i)) + F.length(own))
        return _let(_let(lengths, _running), lambda ends: F.transform(matches, lambda own, i: span(own, i, ends)))

    found = F.filter(_let(F.split(text, PATTERNS[kind], -1), located), lambda s: _valid(kind, s["text"]))
    if kind not in BASE:
        found = F.filter(found, lambda s: s["score"] >= LEAST)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """The columns of docs and ``pii`` (with underscores, if docs has that): a struct with an array of spans for each kind."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def matches(kind: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>")) if kind in NEEDS else found

    held = fresh(docs.columns, "_found")
    proposed = docs.withColumn(held, F.struct(*[matches(k).alias(k) for k in PATTERNS]))
    spans = F.struct(*[_spans(k, text, F.col(f"{held}.{k}")).cast(SPANS).alias(k) for k in PATTERNS])
    return proposed.withColumn(fresh(docs.columns, "pii"), spans).drop(held)


def _joined(*kinds: str) -> Column:
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(F.flatten(F.array(*[F.col(f"pii.{k}") for k in kinds])), shown))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"pii.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(*BASE).cast("binary"), 256).alias("base_sha256"),
        _joined(*PATTERNS).alias("spans"),
        F.coalesce(F.array_max(F.transform(F.flatten(F.array(*[F.col(f"pii.{k}") for k in PATTERNS])), lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
