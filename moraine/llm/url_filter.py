"""URL filters by a temporal list join.

List entries are dated: on a day a rule (a host, a domain, or a host with the first part of a path) is added
to or removed from a list. Per rule and list the entries become validity intervals, each ending when the
rule's next entry begins; of entries of one day, a removal wins. The intervals of a rule are one sorted array, which
lists and days bound.

Captures are reduced to their sites (host and first part of the path). A site proposes the rules that could
name it (host and path, host, all parent domains); proposals of rules that no entry names go before
the shuffle, the others find the intervals of their rule. Captures meet what was found for their site, and the
as-of join evaluates each: of every rule and list the last interval that began by the fetch time decides whether it is
active then. The most specific active rule names the capture; among equals the list that sorts first.

Lists are not broadcast: they may be large. Captures of sites without any rule pass without a shuffle; a host with a
third of all captures, or a domain with a third of all sites, finds its intervals by a broadcast of the few heavy ones.

Defined cases: a null or unparsable url, or one without a host, has no rule and is kept; addresses (in brackets or
of digits) have no parent domains; a backslash counts as a slash; a null fetch time is after every entry; null rules,
days or actions in a list are no entries; repeated captures get a row each; an empty list keeps all; further columns
come back as they are, and where one bears a result's name, that of the result gets an underscore behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SLOTS, Stash, fresh, join_counted

ALWAYS = "9999-12-31"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/\\?#]*@)?"
_HOST = _AUTHORITY + r"(\[[^\]/\\?#]*\]|[^/\\?#:@\[\]]+)"
_FIRST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]+[/\\]([^/\\?#]+)"
_ADDRESS = r"^(\[|[0-9.]+$)"


def host_of(url: Column) -> Column:
    """The lower-cased host without a final dot; null where there is none."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The first part of the path with its slash; empty where there is none."""
    part = F.regexp_extract(url, _FIRST, 1)
    return F.when(F.length(part) > 0, F.concat(F.lit("/"), part)).otherwise("")


def intervals(entries: DataFrame) -> DataFrame:
    """entries(list, rule, day, action 'add' or 'remove') -> (list, rule, since, until): days on which the rule holds."""
    host = F.substring_index("rule", "/", 1)
    rule = F.concat(F.lower(host), F.substr("rule", F.length(host) + 1))  # paths are case-sensitive
    one = entries.filter("rule IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL").groupBy("list", rule.alias("rule"), "day")
    one = one.agg(F.min(F.when(F.col("action") == "add", 1).otherwise(0)).alias("on"))
    nxt = F.lead("day").over(W.partitionBy("list", "rule").orderBy("day"))
    spans = one.withColumn("until", F.coalesce(nxt, F.lit(ALWAYS).cast("date")))
    return spans.filter("on = 1").select("list", "rule", F.col("day").alias("since"), "until")


def timelines(entries: DataFrame) -> DataFrame:
    """One row per rule: rule, and by list its intervals in order."""
    of_list = intervals(entries).groupBy("rule", "list").agg(F.sort_array(F.collect_list(F.struct("since", "until"))).alias("spans"))
    return of_list.groupBy("rule").agg(F.sort_array(F.collect_list(F.struct("list", "spans"))).alias("lists"))


def proposals(host: Column, path: Column) -> Column:
    """Rules that could name a site, most specific first."""
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parents = F.when(host.rlike(_ADDRESS), F.array(host)).otherwise(parents)
    return F.concat(F.when(path != "", F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>")), parents)


def _active(spans: Column, day: Column) -> Column:
    """As of a day: whether the last interval that began by then still holds."""
    begun = F.filter(spans, lambda s: s["since"] <= day)
    return F.coalesce(F.try_element_at(begun, F.lit(-1))["until"] > day, F.lit(False))


def _slots(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched, ...) -> its columns with rule, list (null if none holds) and kept."""
    stash = Stash(captures.sparkSession)
    host, path, day, slot, found, hit = (fresh(captures.columns, f"_{c}") for c in ("host", "path", "day", "slot", "found", "hit"))
    fetched = F.coalesce(F.to_date("fetched"), F.date_sub(F.lit(ALWAYS).cast("date"), 1))
    own = captures.select("*", host_of(F.col("url")).alias(host), path_of(F.col("url")).alias(path), fetched.alias(day))
    sites = own.filter(F.col(host).isNotNull()).groupBy(host, path).agg(F.count(F.lit(1)).alias("n"))
    sites = stash.put(sites, "sites")
    lines = stash.put(timelines(entries), "lines")

    named = F.broadcast(lines.select(_slots("rule").alias("slot")).distinct())  # SLOTS rows at most
    asked = sites.select(host, path, "n", F.posexplode(proposals(F.col(host), F.col(path))).alias("depth", "rule"))
    asked = stash.put(asked.withColumn("slot", _slots("rule")).join(named, "slot", "left_semi").drop("slot"), "asked")
    counts = asked.groupBy("rule").agg(F.count(F.lit(1)).alias("sites"))
    lines = stash.put(lines.join(counts, "rule"), "named")
    hits = join_counted(asked, lines, ["rule"], asked.count(), "sites")
    each = F.sort_array(F.collect_list(F.struct("depth", "rule", "lists"))).alias(found)
    matched = stash.put(hits.groupBy(host, path, "n").agg(each).withColumnRenamed("n", hit), "matched")
    rows = matched.agg(F.coalesce(F.sum(hit), F.lit(0))).first()[0]

    slots = F.broadcast(matched.select(_slots(host).alias(slot)).distinct())  # SLOTS rows at most
    own = own.withColumn(slot, _slots(host))
    concerned = own.filter(F.col(host).isNotNull()).join(slots, slot, "left_semi")
    concerned = join_counted(concerned, matched, [host, path], rows, hit, "left")
    by_list = F.flatten(F.transform(found, lambda m: F.transform(m["lists"], lambda x: F.struct(m["rule"].alias("rule"), x["list"].alias("list"), x["spans"].alias("spans")))))
    active = F.get(F.filter(by_list, lambda x: _active(x["spans"], F.col(day))), 0)
    concerned = concerned.select(*captures.columns, F.struct(active["rule"].alias("rule"), active["list"].alias("list")).alias(hit))
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("list"))
    passed = own.join(slots, slot, "left_anti").unionByName(own.filter(F.col(host).isNull()).join(slots, slot, "left_semi"))
    out = concerned.unionByName(passed.select(*captures.columns, none.alias(hit)))
    rule, list_, kept = (fresh(captures.columns, c) for c in ("rule", "list", "kept"))
    return out.select(*captures.columns, F.col(f"{hit}.rule").alias(rule), F.col(f"{hit}.list").alias(list_), F.col(f"{hit}.rule").isNull().alias(kept))


# The tables hold no lists and no fetch times. The query derives both from the pages: a page is fetched on the
# (page_id mod 365)th day of 2024, and the lists follow from the MD5 of each rule that could name a page.
_START = "2024-01-01"


def _hex_number(text: Column, start: int) -> Column:
    """Two hexadecimal digits of the MD5 of a text as a number from 0 to 255."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 2), 16, 10).cast("int")


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts, domains and paths of pages: one in sixteen is listed, one in three of those delisted later and one in six listed again."""
    url = F.col("url")
    rules = pages.select(F.explode(proposals(host_of(url), path_of(url))).alias("rule")).filter("rule IS NOT NULL").distinct()
    picked = rules.filter(_hex_number(F.col("rule"), 1) < 16)
    day = F.date_add(F.lit(_START).cast("date"), _hex_number(F.col("rule"), 3))
    name = F.when(_hex_number(F.col("rule"), 5) < 128, "malware").otherwise("adult")
    first = picked.select(name.alias("list"), "rule", day.alias("day"), F.lit("add").alias("action"))
    off = picked.filter(_hex_number(F.col("rule"), 7) < 86).select(name.alias("list"), "rule", F.date_add(day, 40).alias("day"), F.lit("remove").alias("action"))
    again = picked.filter(_hex_number(F.col("rule"), 7) < 43).select(name.alias("list"), "rule", F.date_add(day, 80).alias("day"), F.lit("add").alias("action"))
    return first.unionByName(off).unionByName(again)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit(_START).cast("date"), F.pmod(F.col("page_id"), F.lit(365)).cast("int")))
    return judge(captures, derived_entries(pages)).select("page_id", "rule", "list", "kept")


SQL = r"""
WITH p AS (
  SELECT page_id, date '2024-01-01' + (page_id % 365)::INT AS d,
         nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/\\?#]*@)?(\[[^\]/\\?#]*\]|[^/\\?#:@\[\]]+)', 1)), '.'), '') AS host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/\\?#]+[/\\]([^/\\?#]+)', 1), '') AS first_path
  FROM pages
), asked AS (
  SELECT page_id, d, 0 AS depth, host || '/' || first_path AS rule FROM p WHERE host IS NOT NULL AND first_path IS NOT NULL
  UNION ALL
  SELECT page_id, d, i AS depth, array_to_string(string_split(host, '.')[i:], '.') AS rule
  FROM p, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE NOT regexp_matches(host, '^(\[|[0-9.]+$)')
  UNION ALL
  SELECT page_id, d, 1, host FROM p WHERE regexp_matches(host, '^(\[|[0-9.]+$)')
), h AS (
  SELECT rule, md5(rule) AS m FROM (SELECT DISTINCT rule FROM asked)
), n AS (
  SELECT rule,
         ('0x' || substr(m, 1, 2))::INT AS a, ('0x' || substr(m, 3, 2))::INT AS b,
         ('0x' || substr(m, 5, 2))::INT AS c, ('0x' || substr(m, 7, 2))::INT AS e
  FROM h
), l AS (
  SELECT rule, CASE WHEN c < 128 THEN 'malware' ELSE 'adult' END AS list, date '2024-01-01' + b AS day, e FROM n WHERE a < 16
), spans AS (
  SELECT rule, list, day AS since, CASE WHEN e < 86 THEN day + 40 ELSE date '9999-12-31' END AS until FROM l
  UNION ALL
  SELECT rule, list, day + 80, date '9999-12-31' FROM l WHERE e < 43
), hits AS (
  SELECT page_id, s.rule, s.list, row_number() OVER (PARTITION BY page_id ORDER BY depth, s.list, s.rule) AS r
  FROM asked JOIN spans s ON asked.rule = s.rule AND d >= since AND d < until
)
SELECT p.page_id, hits.rule, hits.list, hits.rule IS NULL AS kept FROM p LEFT JOIN hits ON p.page_id = hits.page_id AND r = 1
"""
