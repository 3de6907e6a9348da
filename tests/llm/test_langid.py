import random
import zlib

import pytest

from moraine.llm import langid

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return langid.learn(docs)


def test_held_out_accuracy(spark, docs):
    labels = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.op5_language_id(spark, SF).collect()
    assert len(got) == len(labels) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97


def test_families_come_first(model):
    assert model.languages == ["de", "en", "es", "fr"]
    assert model.families == [("de", "en"), ("es", "fr")]
    assert (("de",), ("en",)) in model.decisions and (("de",), ("fr",)) not in model.decisions


def test_held_out_rows_are_not_learned_from(docs):
    sample = {t for _, t in langid.training_sample(docs)}
    assert len(sample) > 100
    only_held = {r["text"].encode() for r in docs.collect() if held_out(r["doc_id"])} - {r["text"].encode() for r in docs.collect() if not held_out(r["doc_id"])}
    assert not sample & only_held


def test_the_sample_is_bounded(docs):
    assert len(langid.training_sample(docs, per_language=20)) < 4 * 40
    assert sum(len(t) for _, t in langid.training_sample(docs, most_bytes=20_000)) < 4 * 20_000 * 5


def test_odd_texts(spark, model):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the and of"), (None, "the and of"), (5, "the " * 300_000), (6, "漢字"), (6, "漢字"), (7, "½²")]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = langid.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        letters = r["text"] and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in got if r["text"] and r["text"].startswith("the")} == {"en"}
    kept = langid.keep_identified(df.unionByName(df.filter("doc_id = 4").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source")))
    assert kept.columns == df.columns


def plain_scores(model, text):
    """One decision after the other, one n-gram after the other."""
    folded = [x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in text] + [32] * 3
    out = [0.0] * len(model.decisions)
    for at in range(len(text)):
        code = 0
        for k in range(4):
            code = code << 8 | folded[at + k]
            h = code * (0x9E3779B97F4A7C15 + 2 * k) % 2**64
            spot = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - model.bits
            for d in range(len(out)):
                out[d] += float(model.weights[d, k, spot])
    return [x / max(1, len(text)) for x in out]


@pytest.mark.parametrize("block", [1 << 20, 7, 64])
def test_scores_equal_a_plain_scorer_whatever_the_blocks(model, monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    texts = [t.encode() for t in ("", "a", "Der Hund, die Katze!", "É à ñ 漢字", "the  end of\tthe text " * 5, "xyz", "q" * 129)]
    got = model.scores(texts)
    for t, row in zip(texts, got.tolist(), strict=True):
        assert row == pytest.approx(plain_scores(model, t), abs=1e-5)
    ids, values = langid.features(texts[2])
    monkeypatch.setattr(langid, "BLOCK", 1 << 20)
    whole = langid.features(texts[2])
    assert ids.tolist() == whole[0].tolist() and values.tolist() == whole[1].tolist()


def test_a_long_text_takes_bounded_memory(model):
    import tracemalloc

    text = b"the quick brown fox and the lazy dog " * 1_400_000
    tracemalloc.start()
    label, _ = model.predict([text])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert label == "en" and len(text) > 50_000_000 and peak < 200 << 20


def test_many_labels_share_the_bounds():
    rng = random.Random(1)
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)) for _ in range(120)]
    own = langid.fit([(f"l{i:03d}", w.encode()) for i, w in enumerate(words) for _ in range(2)])
    assert own.weights.nbytes <= langid.MODEL_BYTES and own.bits < langid.BITS and len(own.families) == 120
    assert [x for x, _ in own.predict([words[7].encode(), words[99].encode()])] == ["l007", "l099"]


def test_too_many_labels_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LABELS", 3)
    df = spark.createDataFrame([(i, "word", f"l{i}") for i in range(20)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        langid.learn(df)


def test_labels_with_long_texts_are_learned(spark):
    rows = [(i, "the cat and the dog are in the house " * 3, "en") for i in range(56)] + [(100 + i, "der Hund und die Katze sind im Haus " * 130_000, "de") for i in range(4)]
    own = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert own.languages == ["de", "en"]
    assert [x for x, _ in own.predict([b"die Katze und der Hund", b"the dog and the cat"])] == ["de", "en"]


@pytest.mark.parametrize("labels, want", [([], {"und"}), (["sv"], {"sv"}), ([None], {"und"})])
def test_few_labels(spark, labels, want):
    rows = [(i, "some words here", lang) for lang in labels for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    probe = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert {r["lang_pred"] for r in langid.identify(probe, langid.learn(df)).collect()} == want


def test_unknown_languages_are_families_of_their_own():
    model = langid.fit([("xx", b"qqq www zzz " * 9), ("yy", b"mmm nnn ooo " * 9), ("en", b"the and of to " * 9)] * 4)
    assert sorted(model.families) == [("en",), ("xx",), ("yy",)]
    assert [x for x, _ in model.predict([b"qqq zzz", b"nnn mmm", b"of the"])] == ["xx", "yy", "en"]


def test_no_label_is_left_out_of_the_sample(spark):
    rows = [(i, "word " * 200, "en") for i in range(100)] + [(1000 + i, f"ord {i} " * 2000, "sv") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(df, most_bytes=500)
    assert {lang for lang, _ in sample} == {"en", "sv"}
    assert sum(lang == "sv" for lang, _ in sample) == langid.FEW
    assert langid.learn(df).languages == ["en", "sv"]
