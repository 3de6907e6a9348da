import hashlib
import random

import corpus_pipeline
from moraine.llm import exact_dedup
from moraine.llm.bpe import default_tokenizer

from . import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_in_order_and_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    assert exact_dedup.keep_first(docs).count() == len({r["text"].encode().lower() for r in docs.collect()})


def lower(text):
    return text.encode().lower()


def by_hand(rows, slices):
    """(doc_id, sha256 of ids, sha256 of decoded text) of what all stages leave, by none of the operators' code."""
    rows = [r for r in rows if plain.has_letter(r[1])]
    best = {}
    for r in rows:
        if lower(r[1]) not in best or best[lower(r[1])][0] < r[0]:
            best[lower(r[1])] = r
    rows = list(best.values())
    kept = {i for i, _, _, own in plain.brute([(r[0], r[1]) for r in rows]) if own}
    rows = [r for r in rows if r[0] in kept]
    encode, out = plain.encoded(default_tokenizer()), []
    for r, times in zip(rows, plain.queue([(r[0], r[1], r[3]) for r in rows], slices), strict=True):
        ids, text = encode(r[1])
        ids = b"".join(i.to_bytes(4, "little") for i in ids)
        out += [(r[0], hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] * times
    return sorted(out)


def planted(given):
    """Given rows, with copies, copies in other case, chains of near copies, texts without letters and odd rows besides."""
    rng, rows = random.Random(4), list(given)
    for at, r in enumerate(rng.sample(given, 24)):
        words = r[1].split(" ")
        rows.append((1000 + at, r[1] if at % 2 else "".join(c.upper() if c.isascii() else c for c in r[1]), r[2], r[3], r[4]))
        for step in range(3):
            words[rng.randrange(len(words))] = f"new{step}"
            rows.append((2000 + 10 * at + step, " ".join(words), r[2], rng.choice(["src0", "src7", None]), None))
    odd = [None, "", " \t\n", "1234 5678 !?", "x", "漢字", "\U0001f389 \U0001f389", "a b c d", "a b c d e"]
    return rows + [(5000 + i, t, None, "odd", 0) for i, t in enumerate(odd)]


def test_run_equals_brute_force(spark, tmp_path):
    given = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows = planted(given)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id", "ids_sha256", "decoded_sha256").collect()
    slices = 1 << (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    assert sorted(map(tuple, got)) == by_hand(rows, slices)


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
