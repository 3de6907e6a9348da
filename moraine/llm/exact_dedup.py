"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row per digest
(partial aggregation before the shuffle, so a group of copies is one row per task), sort-merge
anti-joined with the index, and what is new is appended. Only digests and ids move; texts are
read once.

Defined cases: a null text counts as empty; rows with a null doc_id belong to their group and
are kept only if no row of the group has an id (keep_id is then null and all of them stay, as
none can be named); rows that repeat the winner's doc_id all stay; an id that stands for several texts
wins or loses with each of them by itself; an empty table gives an empty result; further columns of the
input are ignored, by ``keep_first`` returned as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, join_counted, lower_ascii, shared_dir, without

INDEX_SCHEMA = "digest BINARY, keep_id BIGINT"
#: Rows of a new index that a bucket is to hold at most, and the bounds of the number of buckets.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 4_000_000, 64, 16_384


class DigestIndex:
    """A digest table at ``path``, registered as ``name``; both outlive the session if given."""

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, winners: DataFrame) -> None:
        """Add the digests that the index lacks."""
        known = self.table().select("digest").hint("merge")
        fresh = winners.select("digest", "keep_id").join(known, "digest", "left_anti")
        (
            fresh.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.path).saveAsTable(self.name)
        )

    def forget(self) -> None:
        """Take the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def buckets_for(rows: int) -> int:
    """A power of two that keeps buckets at BUCKET_ROWS digests, as the index outlives the batch that makes it."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, (rows // BUCKET_ROWS).bit_length())))


def _digest():
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest().alias("digest"))


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size (in this batch), kept, text_sha256.

    Of equal texts in a batch the largest doc_id stays; a text whose digest the index holds from
    an earlier batch is dropped in favour of that batch's row. The new digests are appended.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    hashed = stash.put(digests(docs), "digests")
    winners = stash.put(
        hashed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "winners",
    )
    rows = hashed.count()
    own = index or DigestIndex(spark, shared_dir(spark), buckets=buckets_for(rows))
    own.append(winners)
    final = winners.drop("keep_id").join(own.table().hint("merge"), "digest")
    if index is None:  # an index of one call: what it says is written, and its name leaves the catalog
        final = stash.put(final, "final")
        own.forget()
    out = join_counted(hashed, final, ["digest"], rows, "group_size")
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows that ``deduplicate`` keeps, with all their columns."""
    gone = deduplicate(docs, index).filter(~F.col("kept"))
    gone = gone.select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest")).distinct()
    gone = Stash(docs.sparkSession).put(gone, "gone")
    return without(docs, gone, {"id": F.col("doc_id").cast("long"), "digest": _digest()}, "id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
