import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from moraine.llm import bpe, token_counts, token_output
from moraine.llm.common import Stash

WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "Hello, World! it's don't I'LL we've", "aaaaaaaaaaaaaaa bbb " + "a" * 3000, "<|endoftext|> x<|startoftext|>y <|endoftext|><|ENDOFTEXT|>",
    "İstanbul ΑΣ ς ß ﬁ é x́ y z\x1cq\x85w v 漢字 🎉🎉 ’s", "Å ́b ½ ² ٣٤ a_b-c 12345", "ÉCOLE Été ÀÇ ñandú Žižek ĳ Ŀ ŉ ſ Ǆ", "long " * 40_000,
    "x" * 100_000, "\x00\x01 nul", "the the the", "tab\tsep\x0bvt\x0cff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "c", 5) for i, t in enumerate(TEXTS)] + [(None, "null id", "c", 5), (3, "again", "c", 5), (3, "again", "c", 5)], "doc_id long, text string, n_tokens_ string, ids int")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(spark, docs, library):
    got = bpe.digests(docs).collect()
    want = []
    for r in docs.collect():
        ids = ids_of(library, r["text"])
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_bpe_keeps_columns_and_gives_ids_and_text(spark, docs, library):
    rows = bpe.encode_documents(docs.drop("ids")).collect()
    assert all(r["ids"] == ids_of(library, r["text"]) and r["n_tokens_"] == "c" for r in rows)
    rows = bpe.encode_and_decode(docs).collect()
    assert all(r["decoded"] == library.decode(ids_of(library, r["text"]), skip_special_tokens=False) for r in rows)


def test_random_words_with_other_merges(library):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abtheinrs'.,1é") for _ in range(rng.randrange(1, 14))) for _ in range(200)) for _ in range(20)]
    own = bpe.PairIndexBpe(WORD)
    own.memory = bpe.Memory(50 * bpe.ENTRY)
    for t in (texts[:7], texts[7:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(t)] == [ids_of(library, x) for x in t]
    assert len(own.memory) <= 50


def test_long_texts_are_encoded_in_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)
    monkeypatch.setattr(token_output, "PIECE", 40)
    texts = [t or "" for t in TEXTS if len(t or "") < 40_000] + ["a b " * 100 + "x" * 200 + " İ ’s " + "c d\n" * 50, " " * 100, "y" * 100]
    assert ["".join(bpe.pieces_of(t)) for t in texts] == texts
    want = [ids_of(library, t) for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.PairIndexBpe(WORD).encode(texts)] == want
    own = token_output.LibraryEncoder(WORD)
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == want


def test_every_character_alone_and_in_words_by_both_encoders(library):
    """Texts that hold one character beside plain ones, so that each is cut as a plain text if it counts as plain."""
    own, asking = bpe.PairIndexBpe(WORD), token_output.LibraryEncoder(WORD)
    for form in ("{}", "a{}b", "I{}'S", " {}1"):
        texts = [form.format(chr(c)) for c in [*range(1, 0x0600), *range(0x1E00, 0x2200), *range(0xFB00, 0xFB10)]]
        want = [ids_of(library, t) for t in texts]
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == want
        assert [np.frombuffer(x, asking.kind).tolist() for x in asking.encode(texts)] == want


def test_merges_whose_parts_rank_higher(tmp_path):
    """A vocabulary in which a merge yields a pair of lower rank: ranks are still taken in ascending order."""
    from tokenizers import models, normalizers, pre_tokenizers

    char = bpe._byte_characters()
    vocab = {c: i for i, c in enumerate(char)} | {f"{c}</w>": 256 + i for i, c in enumerate(char)}
    merges = [("ab", "ab"), ("a", "a"), ("a", "b"), ("abab", "a"), ("aa", "b</w>"), ("ab", "a</w>")]
    for a, b in merges:
        vocab.setdefault(a, len(vocab)), vocab.setdefault(b, len(vocab)), vocab.setdefault(a + b, len(vocab))
    t = Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>"))
    t.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    t.save(f"{tmp_path}/t.json")
    own, rng = bpe.PairIndexBpe(f"{tmp_path}/t.json"), random.Random(6)
    texts = [" ".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 20))) for _ in range(60)) for _ in range(5)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [ids_of(t, x) for x in texts]


def test_token_files_round_trip(spark, docs, library):
    folder = Stash(spark).path("tokens")
    files = token_output.write_tokens(docs, folder, file_bytes=60)
    assert files.count() > 2
    rows = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    want, start = [], 0
    for r in rows:
        ids = [*ids_of(library, r["text"]), 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_output.read_index(files, folder).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    names = [r["file"] for r in files.orderBy("start").collect()]
    first = token_output.TokenFile(folder, names[0])
    assert first.document(0).tolist() == [*ids_of(library, rows[0]["text"]), 1]
    with pytest.raises(ValueError):
        token_output.TokenFile(folder, f"{first.hash}.dict")


def test_empty_and_small_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    folder = Stash(spark).path("tokens")
    files = token_output.write_tokens(none, folder)
    assert files.count() == 0 and token_output.read_index(files, folder).count() == 0
    assert bpe.digests(none).count() == 0
    flat = Stash(spark).path("flat")
    assert token_counts.count_tokens(token_counts.write_flat(none, flat).select("file"), flat).count() == 0


def test_dictionary_is_trained_and_used(spark):
    many = spark.range(300).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 60), i -> concat('word', (id * i) % 17))) AS text")
    folder = Stash(spark).path("tokens")
    files = token_output.write_tokens(many, folder)
    f = token_output.TokenFile(folder, files.first()["file"])
    assert f.hash != hashlib.sha256(b"").hexdigest()
    assert token_output.read_index(files, folder).count() == 300


@pytest.mark.parametrize("block", [3, 7, 1 << 20])
def test_separator_scan_equals_brute_force(spark, tmp_path, block):
    rng = random.Random(block)
    flats = {"a.u16": [9, 9, 1, 2, 9], "b.u16": [5, 6, 7], "c.u16": [], "d.u16": [9], "e.u16": [1] * 20 + [9] + [2] * 13}
    for i in range(4):
        flats[f"r{i}.u16"] = [rng.choice([1, 2, 3, 9]) for _ in range(rng.randrange(1, 60))]
    want = []
    for name, ids in flats.items():
        np.array(ids, "<u2").tofile(f"{tmp_path}/{name}")
        counts, n = [], 0
        for x in ids:
            if x == 9:
                counts.append(n)
                n = 0
            else:
                n += 1
        want += [(name, i, c) for i, c in enumerate(counts + ([n] if n else []))]
    files = spark.createDataFrame([(n,) for n in flats], "file string")
    got = token_counts.count_tokens(files, f"file://{tmp_path}", separator=9, block=block)
    assert sorted(map(tuple, got.select("file", "place", "n_tokens").collect())) == sorted(want)


def test_counts_of_documents(spark, docs):
    import base64

    import tiktoken

    path, pattern = token_counts.default_ranks()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    stash = Stash(spark)
    named = stash.put(token_counts.write_flat(docs, stash.path("flat"), file_bytes=5000), "named")
    counts = token_counts.count_tokens(named.select("file").distinct(), stash.path("flat"), block=1000)
    got = named.join(counts, ["file", "place"], "left").fillna(0, ["n_tokens"]).select("doc_id", "n_tokens").collect()
    want = [(r["doc_id"], len(encoding.encode_ordinary(r["text"] or ""))) for r in docs.collect()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
