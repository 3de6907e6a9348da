"""MinHash near-dedup on word shingles by fast similarity sketching.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. The sketch throws every
element into one of K bins per round and keeps the least value of each bin; a value's round is its
leading part, so later rounds only fill bins that stayed empty. After K hashed rounds, round K + j
throws every element into bin j, so that each coordinate is filled for any non-empty set. Large
sets need one or two rounds instead of K hashes per element, and the estimate of the similarity
has Chernoff-like concentration.

B bands of R coordinates give candidate buckets. At similarity 0.75, R = 4 and B = 32 miss a pair
with probability (1 - 0.75**4)**32 = 5e-6. Equal sets are first collapsed to one numbered class, so copies
meet in no bucket. In a bucket every class is paired with its hub (a star, linear in the bucket): the one that
meets most others over all its buckets, which in a group of near copies is the one most like the rest. Pairs
are confirmed on the full sets and links become components. Classes of buckets that still hold several components
go through an exact prefix-filter join across components, so no link is lost to the star. Keys that many rows
share (the hub of a large star, a common shingle) are dealt over blocks of about SQUARE rows.

Defined cases: null text and text without words give the empty set, linked with nothing; a row with
a null doc_id has its n_shingles, component_id null and kept true, and links nothing; repeated rows share the
result; rows with one doc_id and different texts are documents of their own with the same id, each with its own
links; further columns are ignored, by ``keep_representatives`` returned as they are, whatever their names;
empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, join_counted, mix64, ship, without
from .components import connected_components

WORDS = 5
BINS, ROWS = 128, 4
SEED = 0x5EED
BLOCK = 2 << 20
SEGMENT = 1 << 20
#: Rows of one key that a block holds where a key is split.
SQUARE = 1024
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHasher:
    """64-bit hashes of all words of a byte buffer, lower-casing A-Z, by a polynomial prefix hash."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64)
        self.table[65:91] = self.table[97:123]
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers = self.inverses = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, SEGMENT + 4096)
            for name, x in (("powers", self.base), ("inverses", self.inverse)):
                p = np.full(n, x, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start positions and hashes of the words of data, taken in segments cut at white space."""
        starts, hashes, at = [], [], 0
        buf = np.frombuffer(data, np.uint8)
        while at < len(buf):
            end = min(len(buf), at + SEGMENT)
            while end < len(buf):
                gap = np.flatnonzero(_white(buf[end : end + 4096]))
                if len(gap):
                    end += int(gap[0])
                    break
                end = min(len(buf), end + 4096)
            s, h = self._segment(buf[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _segment(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = ~_white(buf)
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self._grow(len(buf) + 1)
        prefix = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * self.powers[: len(buf)], out=prefix[1:])
        h = (prefix[end] - prefix[start]) * self.inverses[start]
        return start, mix64(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def _white(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


MIX = [np.uint64(int(x) | 1) for x in np.random.default_rng(SEED + 1).integers(0, 1 << 63, 16, dtype=np.uint64)]


SHORT = np.array(MIX[8:], np.uint64)


def shingle_sets(texts: list[bytes], hasher: WordHasher, size: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, words = hasher.words(b" ".join(texts))
    first = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * MIX[k]
    rolled = mix64(rolled)
    out = []
    for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(rolled[s : e - size + 1]))
        elif e > s:
            short = (words[s:e] * SHORT[: e - s]).sum(keepdims=True)
            out.append(mix64(short + np.uint64(e - s)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of ``bins`` coordinates per set; rows of empty sets hold EMPTY."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    out = np.full((len(sets), bins), EMPTY)
    flat = out.reshape(-1)
    mask, shift = np.uint64(bins - 1), np.uint64(8)
    for turn in range(2 * bins):
        if not len(values):
            break
        h = mix64(values + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        where = (h & mask).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, owner * bins + where, (np.uint64(turn) << np.uint64(56)) | (h >> shift))
        open_ = (out == EMPTY).any(axis=1)[owner]
        if not open_.all():
            values, owner = values[open_], owner[open_]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(len(sketch), -1, rows)
    keys = (np.arange(parts.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[None, :].repeat(len(sketch), 0)
    for r in range(rows):
        keys = keys + parts[:, :, r] * MIX[r]
        keys = keys ^ (keys >> np.uint64(29))
    return mix64(keys)


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about BLOCK bytes, so that arrays stay small however large the batch is."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= BLOCK or i + 1 == len(texts):
            yield at, [x or b"" for x in texts[at : i + 1]]
            at, size = i + 1, 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for at, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
            sets = shingle_sets(texts, hasher)
            keys = band_keys(sketches(sets)).view(np.int64)
            full = [bool(len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(texts)),
                    batch.column(2).slice(at, len(texts)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(mix64(s ^ MIX[9]).sum().view(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(mix64(s ^ MIX[10]).sum().view(np.int64)) for s in sets], pa.int64()),
                    _lists([k.view(np.uint64) if f else np.zeros(0, np.uint64) for k, f in zip(keys, full, strict=True)]),
                ],
                names=["doc_id", "body", "n_shingles", "key_a", "key_b", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        for at, texts in blocks(batch.column(1).cast(pa.binary()).to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(texts)), _lists(shingle_sets(texts, hasher))], names=["node", "shingles"]
            )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b, blocks) whose full sets overlap enough.

    ``blocks`` says over how many blocks the partners of an a are dealt: its set is copied to each of them, so the star
    of a large hub is no single key. Sets are never broadcast and neither are pairs, so the plan and what it moves per
    row are alike at every size.
    """
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    copies = pairs.groupBy("a").agg(F.max("blocks").alias("most"))
    right = sets.join(copies.hint("merge"), F.col("node") == F.col("a"))
    right = right.select("a", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("block"), F.col("shingles").alias("set_a"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    joined = dealt.join(left.hint("merge"), "b").join(right.hint("merge"), ["a", "block"])
    return (
        joined.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("both"))
        .filter(100 * F.col("common") >= percent * (F.col("both") - F.col("common")))
        .select("a", "b")
    )


def _blocks(rows):
    """Over how many blocks a key with so many rows is dealt."""
    return F.ceil(rows / SQUARE).cast("long")


def _across(sets: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """Pairs (a, b, blocks) of sets(node, component, shingles) in different components that may reach the similarity.

    Prefix and positional filtering, which are exact: with shingles ordered from the rarest on, the smaller of two
    such sets of n and m shingles shares one of its first n - ceil(2 percent / (100 + percent) * n) + 1 with the first
    m - ceil(percent / 100 * m) + 1 of the larger, and from their first common one on, both have as many left as they
    must share. A passage that many documents share stands last in that order, so it brings no pairs unless it
    makes up most of the smaller text; neither do copies of one text that each have too many shingles of their own.
    A shingle that many sets share is dealt over a square of blocks.
    """
    each = sets.select("node", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rarity = stash.put(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("docs")), "rarity")
    rows = rarity.agg(F.sum("docs")).first()[0] or 0
    ranked = join_counted(each, rarity, ["shingle"], rows, "docs").groupBy("node", "component", "n")
    ranked = ranked.agg(F.sort_array(F.collect_list(F.struct("docs", "shingle"))).alias("all"))
    first = F.slice("all", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    heads = ranked.select("node", "component", "n", F.posexplode(first).alias("place", "x")).filter("x.docs > 1")
    left = F.col("n") - F.col("place")
    short = (100 + percent) * left >= 2 * percent * F.col("n")
    heads = heads.select("node", "component", "n", left.alias("left"), short.alias("short"), F.col("x.shingle").alias("shingle"))
    heads = stash.put(heads, "heads")
    several = heads.groupBy("shingle").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("all"), F.max("short").alias("short")
    )
    several = stash.put(several.filter("x != y AND short").select("shingle", "all"), "several")
    rows = several.agg(F.sum("all")).first()[0] or 0
    heads = join_counted(heads, several, ["shingle"], rows, "all").withColumn("blocks", _blocks(F.col("all")))
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    values = ("n", "component", "left")
    one = heads.filter("short").select("shingle", "blocks", own.alias("i"), other.alias("j"), F.col("node").alias("x"), *[F.col(c).alias(f"{c}_x") for c in values])
    two = heads.select("shingle", other.alias("i"), own.alias("j"), F.col("node").alias("y"), *[F.col(c).alias(f"{c}_y") for c in values])
    pairs = one.join(two, ["shingle", "i", "j"]).filter(
        ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))))
        & (F.col("component_x") != F.col("component_y"))
        & (100 * F.col("n_x") >= percent * F.col("n_y"))
        & ((100 + percent) * F.least("left_x", "left_y") >= percent * (F.col("n_x") + F.col("n_y")))
    )
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "blocks").groupBy("a", "b").agg(F.max("blocks").alias("blocks"))


def _body(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def decide(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, body (a hash of the text, which tells rows of one id apart), n_shingles, component_id, kept."""
    spark = docs.sparkSession
    ship(spark)
    stash = Stash(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _body(F.col("text")).alias("body"))
    signed = given.mapInArrow(_signatures, "doc_id long, body long, n_shingles long, key_a long, key_b long, bands array<long>")
    signed = stash.put(signed, "signatures")
    keys = ["n_shingles", "key_a", "key_b"]
    reps = signed.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy(*keys)
    reps = reps.agg(F.min("doc_id").alias("id"), F.min_by("body", "doc_id").alias("body"), F.count(F.lit(1)).alias("copies"))
    reps = stash.put(reps.withColumn("node", F.monotonically_increasing_id()), "reps")  # numbered once, then read
    one = reps.select("node", F.col("id").alias("doc_id"), "body", *keys)
    banded = signed.join(one, ["doc_id", "body", *keys]).dropDuplicates(["doc_id", "body", *keys, "node"])
    banded = banded.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count(F.lit(1)).alias("members"))
    buckets = stash.put(buckets.filter("x != y").drop("x", "y"), "buckets")
    rows = buckets.agg(F.sum("members")).first()[0] or 0
    met = stash.put(join_counted(banded, buckets, ["bucket"], rows, "members"), "met")
    weight = met.groupBy("node").agg(F.sum("members").alias("weight"))
    members = stash.put(met.join(weight, "node"), "members")
    hub = F.max(F.struct("weight", (-F.col("node")).alias("id"), "n_shingles"))
    hubs = members.groupBy("bucket").agg(hub.alias("h"), F.max("members").alias("members"))
    hubs = stash.put(hubs.select("bucket", (-F.col("h.id")).alias("hub"), F.col("h.n_shingles").alias("hub_n"), "members"), "hubs")
    members = join_counted(members.drop("weight", "members"), hubs, ["bucket"], rows, "members")

    # Sets whose sizes differ too much can't be alike enough.
    alike = 100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n")
    stars = members.filter(F.col("node") != F.col("hub")).filter(alike)
    stars = stars.groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(_blocks(F.max("members")).alias("blocks"))
    stars = stash.put(stars, "stars")
    nodes = met.select("node").distinct().join(one.select("node", "doc_id", "body"), "node")
    # The texts are shuffled once; equal rows lie together then.
    texts = given.join(nodes.hint("merge"), ["doc_id", "body"]).dropDuplicates(["doc_id", "body", "node"])
    full = stash.put(texts.select("node", "text").mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    links = stash.put(_confirmed(stars, full, percent), "links1")
    found = connected_components(links)

    # A star finds its hub's links only. Classes of buckets that still hold several components go
    # through an exact join across components.
    open_ = members.filter("members > 2").join(found, "node", "left")
    open_ = open_.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = open_.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    open_ = open_.join(several.select("bucket"), "bucket", "left_semi").select("node", "component").distinct()
    open_ = stash.put(open_, "open")
    across = _across(full.join(open_, "node"), percent, stash).join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = stash.put(_confirmed(across, full, percent), "links2")
    if not more.isEmpty():
        found = connected_components(links.unionByName(more))

    # A component bears the smallest id of its classes; those without a link keep their own.
    linked = stash.put(reps.select("node", "id").join(found, "node"), "linked")
    least = stash.put(linked.groupBy("component").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("n")), "least")
    named = join_counted(linked, least, ["component"], linked.count()).select("node", "component_id")
    classes = reps.join(named, "node", "left").select(*keys, "copies", F.coalesce("component_id", "id").alias("component_id"))
    classes = stash.put(classes, "classes")
    stash.drop("buckets", "met", "members", "hubs", "stars", "sets", "links1", "open", "rarity", "heads", "several", "links2", "linked", "least", "reps")
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    slim = signed.drop("bands")
    out = join_counted(slim.filter(linkable), classes, keys, slim.count(), "copies").select("doc_id", "body", "n_shingles", "component_id")
    alone = slim.filter(~linkable).select("doc_id", "body", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links need 100 |A & B| >= percent |A or B|."""
    return decide(docs, percent).drop("body")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows that ``near_duplicates`` keeps, with all their columns."""
    gone = decide(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("id"), "body").distinct()
    gone = Stash(docs.sparkSession).put(gone, "gone")
    return without(docs, gone, {"id": F.col("doc_id").cast("long"), "body": _body(F.col("text"))}, "id")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
