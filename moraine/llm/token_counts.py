"""Token counts of documents in flat, unindexed token files.

A flat file is nothing but ids (unsigned 16- or 32-bit, little-endian), each document closed by an
end-of-document id. Files are cut into blocks of BLOCK ids that tasks read and search for separators with
one vector comparison each. A block yields the counts between its own separators and the lengths before
its first and after its last one. A prefix scan over the blocks of a file (running sums of separators and
a running maximum of the last separator's place) gives every block the number of the document
that is open at its start and that document's ids so far.

Defined cases: a null text is an empty document (count 0); what follows a file's last separator is a
document too, if it is not empty; an empty file has no documents; repeated rows and null ids are
documents like others; extra columns are ignored. Counts exclude separators.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import text_blocks
from .common import Stash, ship, spread
from .files import RollingWriter, read_range

SEPARATOR, BLOCK, FILE_BYTES = 50256, 2 << 20, 64 << 20


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


_loaded: dict = {}


def _encoding(ranks: str, pattern: str):
    import tiktoken

    if ranks not in _loaded:
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[ranks] = tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _loaded[ranks]


def write_flat(docs: DataFrame, folder: str, ranks: tuple[str, str] | None = None, separator: int = SEPARATOR, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode documents to flat 16-bit files in ``folder``; a row per document: file, place (its number in the file), doc_id."""
    ship(docs.sparkSession)
    path, pattern = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, out = _encoding(path, pattern), RollingWriter(folder, file_bytes, ".u16")
        end, place = np.array([separator], "<u2").tobytes(), 0
        for batch in batches:
            for at, texts in text_blocks(batch.column(1)):
                names, places = [], []
                for text in texts:
                    if out.out is None or out.full:
                        out.close()
                        out.open()
                        place = 0
                    out.write(encoding.encode_to_numpy(text, disallowed_special=()).astype("<u2").tobytes() + end)
                    names.append(out.name)
                    places.append(place)
                    place += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(places, pa.int64()), batch.column(0).slice(at, len(texts))], names=["file", "place", "doc_id"]
                )
        out.close()

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(docs.sparkSession, given).mapInArrow(run, "file string, place long, doc_id long")


def _sizes(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .files import filesystem

        for batch in batches:
            fs, path = filesystem(folder)
            sizes = [fs.get_file_info(f"{path}/{name}").size for name in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["file", "bytes"])

    return run


def _scan(folder: str, separator: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block, at, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(read_range(folder, name, at * width, n * width), f"<u{width}")
                where = np.flatnonzero(ids == separator)
                inner = np.diff(where) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name]),
                        pa.array([block], pa.int64()),
                        pa.array([at], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([len(where)], pa.int64()),
                        pa.array([int(where[0]) if len(where) else None], pa.int64()),
                        pa.array([int(where[-1]) if len(where) else None], pa.int64()),
                        pa.array([inner.tolist()], pa.list_(pa.int64())),
                    ],
                    names=["file", "block", "at", "n", "separators", "first", "last", "inner"],
                )

    return run


def count_tokens(files: DataFrame, folder: str, separator: int = SEPARATOR, width: int = 2, block: int = BLOCK) -> DataFrame:
    """files(file) in ``folder`` -> a row per document: file, place, n_tokens."""
    spark = files.sparkSession
    ship(spark)
    stash = Stash(spark)
    sized = files.select("file").mapInArrow(_sizes(folder), "file string, bytes long").filter("bytes > 0")
    ids = F.floor(F.col("bytes") / width)
    cut = sized.withColumn("ids", ids).select("file", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / block))).alias("block"))
    cut = cut.select("file", "block", (F.col("block") * block).alias("at"), F.least(F.lit(block), F.col("ids") - F.col("block") * block).alias("n"))
    cut = stash.put(cut, "blocks")
    cut = cut.repartition(max(spark.sparkContext.defaultParallelism, min(10_000, cut.count())), "file", "block")
    schema = "file string, block long, at long, n long, separators long, first long, last long, inner array<long>"
    scanned = stash.put(cut.mapInArrow(_scan(folder, separator, width), schema), "scanned")

    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    following = W.partitionBy("file").orderBy("block")
    light = scanned.select("file", "block", "at", "n", "separators", "first", "last")
    stitched = light.select(
        "*",
        F.coalesce(F.sum("separators").over(earlier), F.lit(0)).alias("place"),
        (F.coalesce(F.max(F.col("at") + F.col("last")).over(earlier), F.lit(-1)) + 1).alias("opened"),
        F.lead("block").over(following).isNull().alias("final"),
    )
    across = stitched.filter("separators > 0").select("file", "place", (F.col("at") + F.col("first") - F.col("opened")).alias("n_tokens"))
    rest = stitched.filter("final").select(
        "file",
        (F.col("place") + F.col("separators")).alias("place"),
        (F.col("at") + F.col("n") - F.greatest("opened", F.coalesce(F.col("at") + F.col("last") + 1, F.lit(0)))).alias("n_tokens"),
    )
    inside = scanned.select("file", "block", "inner").join(stitched.select("file", "block", "place"), ["file", "block"])
    inside = inside.select("file", "place", F.posexplode("inner").alias("i", "n_tokens"))
    inside = inside.select("file", (F.col("place") + F.col("i") + 1).alias("place"), "n_tokens")
    return across.unionByName(inside).unionByName(rest.filter("n_tokens > 0"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash = Stash(spark)
    folder = stash.path("flat")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    named = stash.put(write_flat(docs, folder), "named")
    counts = count_tokens(named.select("file").distinct(), folder)
    return named.join(counts, ["file", "place"], "left").select("doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
