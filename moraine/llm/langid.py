"""Language identification by hierarchical discrimination.

A first linear classifier tells the language family; within a family of several languages, one-versus-one
linear support vector machines vote. Features are hashed byte n-grams (1 to 4 bytes, lower-cased letters,
everything else one space), as shares of the text's n-grams, so any text length gives vectors of one scale.
A score is the mean of a weight table over a text's n-grams; whole texts are scored, in blocks of BLOCK bytes
that overlap by the length of an n-gram, so neither long texts nor their neighbours matter.

Training takes a bounded sample: at most about PER_LANGUAGE documents of each label, chosen by a hash of
the id among the documents whose crc32(doc_id) mod 4 is not 2, of about SAMPLE_BYTES in all per
label, but the FEW of lowest hash in any case, so that no label is left out; of a chosen text, FITTED characters at
most are fitted on. With many labels the sample of each shrinks (ALL_ROWS, ALL_BYTES in all), and so does the number of
hashed features, so that the model has MODEL_BYTES at most; more than MOST_LABELS labels are an error.
Prediction uses the text alone.

Defined cases: null text and text without a letter give ``und`` and score 0; null labels and null
ids are never learned from; with no labelled row, every text with a letter is ``und`` too; with one
label, it is predicted with score 1; further columns come back as they are, and where one bears a result's name, that of the
result gets an underscore behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, ship, spread

#: Rows of each label to learn from, and bytes of their texts.
PER_LANGUAGE, SAMPLE_BYTES = 400, 4 << 20
#: Rows and bytes to learn from in all, characters of a text, labels, and bytes of the model that is broadcast.
ALL_ROWS, ALL_BYTES, FITTED, MOST_LABELS, MODEL_BYTES = 6000, 60 << 20, 1 << 20, 200, 64 << 20
#: Rows of each label that are learned from however long they are, and the expected rows of a sample that surely holds as many.
FEW, SURE = 3, 50
BITS, ORDERS = 16, (1, 2, 3, 4)
UND = "und"
LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 20

# Families of ISO 639-1 codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def _folding() -> np.ndarray:
    """Byte classes: letters lower-cased, bytes of other scripts as they are, all else a space."""
    table = np.full(256, 32, np.uint64)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


FOLD = _folding()


def grams(pieces: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (a row for each order, a column for each byte that one begins at) of pieces joined by spaces, and each piece's begin."""
    gap = b" " * (max(ORDERS) - 1)
    joined = np.frombuffer(gap.join(pieces) + gap, np.uint8)
    begin = np.cumsum([0] + [len(p) + len(gap) for p in pieces])[:-1]
    x = FOLD[joined]
    n = len(joined) - len(gap)
    out = np.empty((len(ORDERS), n), np.uint16)
    code = np.zeros(n, np.uint64)
    for k in range(max(ORDERS)):
        code = (code << np.uint64(8)) | x[k : k + n]
        if k + 1 in ORDERS:
            h = code * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            out[ORDERS.index(k + 1)] = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)
    return out, begin


def cut(text: bytes, size: int = 0) -> Iterator[tuple[bytes, int]]:
    """Pieces of a text, each with the bytes that the n-grams of its end reach into, and how many n-grams begin in it."""
    size = size or BLOCK
    for at in range(0, max(1, len(text)), size):
        yield text[at : at + size + max(ORDERS) - 1], min(size, len(text) - at)


def features(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their shares of its n-grams, by order."""
    total = np.zeros((len(ORDERS), 1 << bits), np.int64)
    for piece, n in cut(text):
        codes, _ = grams([piece], bits)
        for k, row in enumerate(codes):
            total[k] += np.bincount(row[:n], minlength=1 << bits)
    ids = np.flatnonzero(total)
    return ids, total.reshape(-1)[ids] / max(1, len(text))


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, bits: int = BITS, epochs: int = 12, reg: float = 1e-5, seed: int = 5) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, averaged stochastic subgradient)."""
    scale = [v / np.sqrt((v * v).sum()) for _, v in rows]
    w, total = np.zeros(len(ORDERS) << bits), np.zeros(len(ORDERS) << bits)
    rng, step = np.random.default_rng(seed), 0
    factor = 1.0
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            step += 1
            ids = rows[i][0]
            rate = 1.0 / (1.0 + reg * step)
            factor *= 1 - reg * rate
            if signs[i] * factor * (w[ids] @ scale[i]) < 1:
                w[ids] += rate * signs[i] * scale[i] / factor
        if epoch >= epochs // 2:
            total += factor * w
    return total / (epochs - epochs // 2)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    #: One table per decision: (positive languages, negative languages); ``scale`` puts scores on the margin's scale.
    decisions: list[tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=list)
    families: list[tuple[str, ...]] = field(default_factory=list)
    weights: np.ndarray | None = None

    @property
    def bits(self) -> int:
        return self.weights.shape[2].bit_length() - 1

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One column per decision: the mean weight of the text's n-grams."""
        out = np.zeros((len(texts), self.weights.shape[0]))
        held, size = [], 0
        for i, text in enumerate(texts):
            for piece, n in cut(text):
                held.append((i, piece, n))
                size += len(piece)
                if size >= BLOCK:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out / np.maximum(1, [len(t) for t in texts])[:, None]

    def _add(self, held: list[tuple[int, bytes, int]], out: np.ndarray) -> None:
        """Add the weights of the n-grams that begin in some pieces to their texts' rows."""
        held = [h for h in held if h[2]]
        if not held:
            return
        owner, pieces, sizes = (list(x) for x in zip(*held, strict=True))
        codes, begin = grams(pieces, self.bits)
        # What lies between the n-grams of two pieces is summed as well, and left out.
        ends = np.stack([begin, begin + sizes], axis=1).reshape(-1)
        for d in range(self.weights.shape[0]):
            total = np.zeros(codes.shape[1] + 1, np.float32)
            for k in range(len(ORDERS)):
                total[:-1] += self.weights[d, k][codes[k]]
            np.add.at(out[:, d], owner, np.add.reduceat(total, ends, dtype=np.float64)[::2])

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UND, 0.0)] * len(texts)
        if len(self.languages) == 1:
            return [(self.languages[0], 1.0)] * len(texts)
        s = self.scores(texts)
        col = {d: i for i, d in enumerate(self.decisions)}
        if len(self.families) > 1:
            rest = [tuple(x for g in self.families if g != f for x in g) for f in self.families]
            margin = np.stack([s[:, col[f, r]] for f, r in zip(self.families, rest, strict=True)])
            family, family_score = margin.argmax(axis=0), _sigmoid(margin.max(axis=0))
        else:
            family, family_score = np.zeros(len(texts), int), np.ones(len(texts))
        labels, values = np.empty(len(texts), object), np.zeros(len(texts))
        for f, group in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, sure = np.zeros((len(rows), len(group))), np.zeros((len(rows), len(group)))
            for a, b in combinations(range(len(group)), 2):
                p = _sigmoid(s[rows, col[(group[a],), (group[b],)]])
                votes[:, a] += p >= 0.5
                votes[:, b] += p < 0.5
                sure[:, a] += p
                sure[:, b] += 1 - p
            best = (votes + sure / (1 + len(group))).argmax(axis=1) if len(rows) else np.zeros(0, int)
            labels[rows] = np.array(group, object)[best]
            own = sure[np.arange(len(rows)), best] / max(1, len(group) - 1) if len(group) > 1 else np.ones(len(rows))
            values[rows] = family_score[rows] * own
        return [(x, float(v)) for x, v in zip(labels, values, strict=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(2 * x, -30, 30)))


def fit(labelled: list[tuple[str, bytes]]) -> Model:
    languages = sorted({lang for lang, _ in labelled})
    groups: dict[str, list[str]] = {}
    for lang in languages:
        groups.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    model = Model(languages, [], [tuple(g) for g in groups.values()])
    if len(languages) < 2:
        return model
    names = np.array([lang for lang, _ in labelled], object)
    if len(model.families) > 1:
        model.decisions += [(f, tuple(x for g in model.families if g != f for x in g)) for f in model.families]
    model.decisions += [((a,), (b,)) for g in model.families for a, b in combinations(g, 2)]
    most = MODEL_BYTES // (len(model.decisions) * len(ORDERS) * 4)
    bits = min(BITS, most.bit_length() - 1)
    rows = [features(text, bits) for _, text in labelled]
    tables = []
    for positive, negative in model.decisions:
        of = [i for i, x in enumerate(names) if x in positive or x in negative]
        signs = np.array([1.0 if names[i] in positive else -1.0 for i in of])
        own = [rows[i] for i in of]
        w = train_svm(own, signs, bits)
        margins = np.array([w[i] @ v for i, v in own])
        spread_ = np.abs(margins).mean() or 1.0
        tables.append((w / spread_).reshape(len(ORDERS), -1))
    model.weights = np.stack(tables).astype(np.float32)
    return model


def _remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[str, bytes]]:
    """About ``per_language`` labelled rows of each language (whole texts, most_bytes of them), the same at every run."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.filter(_remainder() != 2).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    counts = counts.limit(MOST_LABELS + 1).collect()  # one row per language
    if not counts:
        return []
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels to learn")
    per_language = min(per_language, max(FEW, ALL_ROWS // max(1, len(counts))))
    most_bytes = min(most_bytes, ALL_BYTES // max(1, len(counts)))
    share = [{"lang": r["lang"], "n": r["n"], "chance": min(1.0, per_language / r["n"], most_bytes / max(1, r["bytes"]))} for r in counts]
    spot = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    chances = F.create_map(*[F.lit(x) for r in share for x in (r["lang"], r["chance"])])
    wanted = spot < F.coalesce(F.element_at(chances, F.col("lang")), F.lit(0.0))
    unsure = [r["lang"] for r in share if r["chance"] < 1 and r["n"] * r["chance"] < SURE]
    if unsure:
        body = F.xxhash64("text")
        least = rows.filter(F.col("lang").isin(unsure)).select("lang", spot.alias("spot"), body.alias("body"))
        least = least.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("spot", "body"))).filter(F.col("r") <= FEW)
        known = [F.struct(F.lit(r["lang"]), F.lit(r["spot"]), F.lit(r["body"])) for r in least.collect()]
        wanted = wanted | F.struct("lang", spot.alias("spot"), body.alias("body")).isin(known) if known else wanted
    got = rows.filter(wanted).select("lang", F.substring("text", 1, FITTED).alias("text"), "doc_id").collect()
    return [(r["lang"], r["text"].encode()) for r in sorted(got, key=lambda r: (r["doc_id"], r["lang"], r["text"]))]


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return fit(training_sample(docs, per_language))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of docs with lang_pred and score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # of MODEL_BYTES at most
    names, place = list(docs.columns), docs.columns.index("text")
    label, sure = fresh(names, "lang_pred"), fresh(names, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField(label, T.StringType()), T.StructField(sure, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(place).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < BLOCK:
                    size += len(texts[end] or "")
                    end += 1
                part = texts[at:end]
                some = [i for i, t in enumerate(part) if t and LETTER.search(t)]
                labels, scores = [UND] * len(part), [0.0] * len(part)
                if some:
                    for i, (one, score) in zip(some, own.predict([part[i].encode() for i in some]), strict=True):
                        labels[i], scores[i] = one, score
                columns = batch.slice(at, end - at).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(labels, pa.string()), pa.array(scores)], names=[*names, label, sure])
                at = end

    return spread(spark, docs).mapInArrow(run, schema)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents that get a language, with all their columns."""
    return identify(docs, learn(docs)).filter(F.col(fresh(docs.columns, "lang_pred")) != UND).select(*docs.columns)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs)
    return identify(docs.select("doc_id", (_remainder() == 2).alias("held_out"), "text"), model).drop("text")
