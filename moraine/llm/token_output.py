"""Token-id files with a shared zstandard dictionary and an index for access to single documents.

Layout of a file (little-endian):
  magic "MRNTOK1\\n", SHA-256 of the dictionary (32 bytes), bytes per id (1)
  one zstandard frame per document: its ids as unsigned 16- or 32-bit integers
  index: doc_ids (int64 each), null flags (1 byte each), token counts (uint32 each),
         frame offsets (uint64 each, one more than documents)
  place of the index (uint64), number of documents (uint64), magic
The dictionary lies beside the files as <hash>.dict. It is trained on the serialised arrays of a bounded
sample: the first SAMPLE_TEXT characters of about SAMPLE documents, chosen by a hash of id and text. It only makes
frames smaller; every document is written whole.

Documents are range-partitioned by doc_id and sorted, each task writes its range to files of about
FILE_BYTES, and returns their names. A document's start is the sum over earlier files plus the counts
before it in its own file's index.

Defined cases: null text is empty (only the end id); null ids come first; rows with equal ids follow one
another in the order of their texts; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import PIECE, Memory, cut_text, default_tokenizer, follows_word_rules, pieces_of, text_blocks
from .common import Stash, ship
from .files import RollingWriter, filesystem, read_range, write_small

MAGIC = b"MRNTOK1\n"
HEAD = len(MAGIC) + 32 + 1
END_ID = 1
SAMPLE, SAMPLE_TEXT, DICTIONARY_BYTES = 1000, 8192, 1 << 16
FILE_BYTES, LEVEL = 32 << 20, 1
#: Strings that the library encodes in one call; bytes of words that a worker remembers, and of texts encoded together.
ASKED, REMEMBERED, BLOCK = 4096, 128 << 20, 4 << 20


class LibraryEncoder:
    """The tokenizers library, asked once for each distinct word (or white-space chunk, where a text is not plain).

    No token of a tokenizer with these word rules reaches across words, so a text's ids are those of its
    words. With any other tokenizer, whole texts are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_words = follows_word_rules(spec)
        self.memory = Memory(REMEMBERED)
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def _ask(self, strings: list[str]) -> Iterator[bytes]:
        """Serialised ids of some strings, a few thousand at a time, since the library's results are large."""
        for at in range(0, len(strings), ASKED):
            ids = [e.ids for e in self.library.encode_batch_fast(strings[at : at + ASKED], add_special_tokens=False)]
            ends = (np.cumsum([0, *map(len, ids)]) * np.dtype(self.kind).itemsize).tolist()
            flat = np.array(list(chain.from_iterable(ids)), self.kind).tobytes()
            yield from (flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of each text."""
        if not self.by_words:
            return list(self._ask(texts))
        if any(len(t) > PIECE for t in texts):
            return [b"".join(x for piece in pieces_of(t) for x in self._by_words([piece])) for t in texts]
        return self._by_words(texts)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        cut, memory = [cut_text(t, self.special)[0] for t in texts], self.memory
        missing = [w for w in set(chain.from_iterable(cut)) if w not in memory]
        memory.update(zip(missing, self._ask(missing), strict=True))
        out = [b"".join(map(memory.__getitem__, own)) for own in cut]
        memory.settle(missing)
        return out


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary from about SAMPLE documents; empty if they are too few to train on."""
    import zstandard

    rows = docs.count()
    spot = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    start = F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_TEXT).alias("text")
    chosen = docs.select("doc_id", spot.alias("spot"), start).filter(F.col("spot") < min(1.0, SAMPLE / max(1, rows)))
    own = encoder(tokenizer)
    texts = [r["text"] for r in chosen.orderBy("spot", "doc_id", "text").limit(2 * SAMPLE).collect()]
    end = np.array([end_id], own.kind).tobytes()
    samples = sorted(x + end for x in own.encode(texts))
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


def _writer(tokenizer: str, folder: str, dictionary: bytes, end_id: int, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        own = encoder(tokenizer)
        kind = np.dtype(own.kind)
        end = np.array([end_id], kind).tobytes()
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=data)
        head = MAGIC + hashlib.sha256(dictionary).digest() + bytes([kind.itemsize])
        out, part, turn = RollingWriter(folder, file_bytes, ".tok"), TaskContext.get().partitionId(), 0
        ids, counts, offsets = [], [], []
        made = []

        def close() -> None:
            index = out.size
            out.write(np.array([i or 0 for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "u1").tobytes())
            out.write(np.array(counts, "<u4").tobytes() + np.array([*offsets, index], "<u8").tobytes())
            out.write(struct.pack("<QQ", index, len(ids)) + MAGIC)
            out.close()
            made.append((out.name, part, turn, len(ids), sum(counts)))
            ids.clear(), counts.clear(), offsets.clear()

        for batch in batches:
            for at, texts in text_blocks(batch.column(1), BLOCK):
                for doc_id, data_ in zip(batch.column(0).slice(at, len(texts)).to_pylist(), own.encode(texts), strict=True):
                    if out.out is None:
                        out.open()
                        out.write(head)
                    ids.append(doc_id)
                    counts.append(len(data_) // kind.itemsize + 1)
                    offsets.append(out.write(packer.compress(data_ + end)))
                    if out.full:
                        close()
                        turn += 1
        if out.out is not None:
            close()
        columns = list(zip(*made, strict=True)) or [[]] * 5
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "part", "turn", "docs", "tokens"]
        )

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents to files in ``folder``; a row per file: file, docs, tokens, start (tokens in files before it)."""
    spark = docs.sparkSession
    ship(spark)
    stash = Stash(spark)
    path = tokenizer or default_tokenizer()
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dictionary = train_dictionary(given, path, end_id)
    write_small(folder, f"{hashlib.sha256(dictionary).hexdigest()}.dict", dictionary)
    placed = given.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = placed.mapInArrow(
        _writer(path, folder, dictionary, end_id, file_bytes), "file string, part int, turn int, docs long, tokens long"
    )
    files = stash.put(files, "files")
    earlier = W.orderBy("part", "turn").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return files.select("file", "docs", "tokens", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("start"))


class TokenFile:
    """Random access to one file."""

    def __init__(self, folder: str, name: str):
        fs, path = filesystem(folder)
        size = fs.get_file_info(f"{path}/{name}").size
        self.folder, self.name = folder, name
        head, tail = read_range(folder, name, 0, HEAD), read_range(folder, name, size - 16 - len(MAGIC), 16 + len(MAGIC))
        if not head.startswith(MAGIC) or not tail.endswith(MAGIC):
            raise ValueError(f"{name} is not a token file")
        index, n = struct.unpack("<QQ", tail[:16])
        raw = read_range(folder, name, index, size - index - 16 - len(MAGIC))
        self.ids = np.frombuffer(raw, "<i8", n)
        self.nulls = np.frombuffer(raw, "u1", n, 8 * n)
        self.counts = np.frombuffer(raw, "<u4", n, 9 * n)
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 13 * n)
        self.kind = f"<u{head[-1]}"
        self.hash = head[len(MAGIC) : -1].hex()
        dictionary = read_range(folder, f"{self.hash}.dict", 0, 1 << 30)
        if hashlib.sha256(dictionary).hexdigest() != self.hash:
            raise ValueError(f"{self.hash}.dict does not match its hash")
        import zstandard

        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=data).decompress

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by one read of its frame."""
        at, end = int(self.offsets[i]), int(self.offsets[i + 1])
        return np.frombuffer(self.unpack(read_range(self.folder, self.name, at, end - at)), self.kind)

    def all(self, block: int = 4 << 20) -> Iterator[np.ndarray]:
        """The ids of all documents in order, read in blocks of frames."""
        at, n = 0, len(self.ids)
        while at < n:
            end = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + block, side="right")) - 1)
            end = min(end, n)
            begin = int(self.offsets[at])
            raw = memoryview(read_range(self.folder, self.name, begin, int(self.offsets[end]) - begin))
            for i in range(at, end):
                yield np.frombuffer(self.unpack(raw[int(self.offsets[i]) - begin : int(self.offsets[i + 1]) - begin]), self.kind)
            at = end


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f = TokenFile(folder, name)
                counts = f.counts.astype(np.int64)
                crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in f.all()]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(f.ids, mask=f.nulls.astype(bool)),
                        pa.array(start + np.cumsum(counts) - counts),
                        pa.array(counts),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """One row per document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    own = files.select("file", "start")
    own = own.repartition(max(files.sparkSession.sparkContext.defaultParallelism, files.count()))
    return own.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Stash(spark).path("tokens")
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_index(files, folder)
