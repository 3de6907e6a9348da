"""BPE encoding and decoding with a pair occurrence index.

Text is cut into words, which no merge crosses; equal words are encoded once. Texts of plain characters are cut
here; others are cut at white space into chunks, which are normalised and pre-tokenised into words by the
tokenizer file's own rules. All distinct words of a block lie behind one another in one symbol array with links
to their neighbours.
An index maps every pair of adjacent symbols to all its positions. Active pairs are taken in
ascending rank; all occurrences of a pair are merged at once, the links are mended, and the pairs
that arise at the seams are entered into the index (and may become active). Words are independent, so
the global order is each word's own order.

A worker remembers the ids of words it has met, up to a bound in bytes, and takes texts of more than PIECE
characters in pieces cut at white space.

Defined cases: null text is the empty text with no tokens; special tokens that stand in a text become
their ids, as the library does; repeated rows and empty tables need no care, as every row is encoded for itself;
further columns come back as they are, and where one bears a result's name, that of the result gets an underscore
behind it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, ship, spread

CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: Printable ASCII and Latin letters (U+00C0 to U+024F without the two signs, and without U+0130, whose lower
#: case is i and a mark that parts words). In this range the pre-tokeniser's classes are these, so words are cut
#: here, and A-Z may be lower-cased before.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
PLAIN = re.compile(rf"[\x09-\x0d\x20-\x7e{_LETTERS}]*")
PLAIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
#: The rules for which the above holds.
WORD_RULES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Bytes of words, chunks and ids that a worker remembers (with ENTRY for each one's own cost), bytes of text that are
#: encoded together, and characters of a text that are.
REMEMBERED, ENTRY, BLOCK, PIECE = 48 << 20, 200, 2 << 20, 2 << 20
SPACE = re.compile(r"[\x20\x09-\x0D]")


def _byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def follows_word_rules(spec: dict) -> bool:
    """Whether a tokenizer file cuts text by WORD_RULES after NFC, white space folding and lower-casing."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    rules = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
    return steps == ["NFC", "Replace", "Lowercase"] and rules == WORD_RULES


def cut_text(text: str, special: Iterable[str] | None) -> tuple[list[str], bool]:
    """The words of a plain text without special tokens, and true; else its white-space chunks, and false."""
    if special is not None and PLAIN.fullmatch(text):
        lower = text.encode().lower().decode()
        if not any(s in lower for s in special):
            return PLAIN_WORDS.findall(lower), True
    return CHUNK.findall(text), False


def pieces_of(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, cut at white space, which no word crosses."""
    at = 0
    while len(text) - at > PIECE:
        gap = SPACE.search(text, at + PIECE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:] if at else text


class Memory(dict):
    """Ids of words and chunks, up to ``most`` bytes: what comes first stays, as frequent words come early."""

    def __init__(self, most: int = 0):
        super().__init__()
        self.most, self.held = most or REMEMBERED, 0

    def settle(self, *latest: list[str]) -> None:
        """Count the latest keys, and take those out again that are too much."""
        for keys in latest:
            sizes = [ENTRY + 2 * len(k) + len(self[k]) for k in keys]
            if self.held + sum(sizes) <= self.most:
                self.held += sum(sizes)
                continue
            for k, size in zip(keys, sizes, strict=True):
                if self.held + size <= self.most:
                    self.held += size
                else:
                    del self[k]


class PairIndexBpe:
    """BPE of a tokenizers file (a BPE model with ranks by merge order)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_at = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        self.width = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * self.width
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in merges], np.int64)
        right = np.array([self.vocab[b] for _, b in merges], np.int64)
        joined = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        pairs = left * self.width + right
        self.pairs, first = np.unique(pairs, return_index=True)
        self.ranks, self.joined = first.astype(np.int64), joined
        self.left, self.right = left, right
        self.by_words = follows_word_rules(spec)
        char_of = _byte_characters()
        self.byte_of = {c: b for b, c in enumerate(char_of)}
        self.first = np.array([self.vocab[c] for c in char_of], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in char_of], np.int64)
        self.memory = Memory()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, -1 where no merge joins it."""
        pair = left * self.width + right
        at = np.searchsorted(self.pairs, pair)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == pair, self.ranks[at], -1)

    def _merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Apply all merges to the words laid out in symbols (word: the word of each position)."""
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.flatnonzero(np.diff(word, append=-1) != 0)
        after[last] = n
        before[np.concatenate(([0], last[:-1] + 1))] = n
        after, before = np.append(after, n), np.append(before, n)
        symbols = np.append(symbols, -1)
        inside = np.flatnonzero(after[:n] < n)
        rank = self._rank(symbols[inside], symbols[after[inside]])
        inside, rank = inside[rank >= 0], rank[rank >= 0]
        index: dict[int, list[np.ndarray]] = {}
        self._enter(index, inside, rank)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r, None)
            if lists is None:
                continue
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b, new = self.left[r], self.right[r], self.joined[r]
            at = at[(symbols[at] == a) & (symbols[after[at]] == b)]
            if a == b and len(at) > 1:
                at = self._left_most(at, after)
            if not len(at):
                continue
            gone = after[at]
            symbols[at], symbols[gone] = new, -1
            nxt = after[gone]
            after[at] = nxt
            before[nxt] = at
            after[n] = before[n] = n
            prev = before[at]
            seam = np.concatenate((prev[prev < n], at[nxt < n]))
            if len(seam):
                seam = np.unique(seam)
                found = self._rank(symbols[seam], symbols[after[seam]])
                for x in self._enter(index, seam[found >= 0], found[found >= 0]):
                    heapq.heappush(heap, x)
        live = np.flatnonzero(symbols[:n] >= 0)
        return symbols[live], word[live]

    @staticmethod
    def _enter(index: dict[int, list[np.ndarray]], at: np.ndarray, rank: np.ndarray) -> list[int]:
        """Add positions to their pairs' lists; the ranks that are new to the index."""
        if not len(at):
            return []
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        fresh = []
        for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            if r in index:
                index[r].append(part)
            else:
                index[r] = [part]
                fresh.append(r)
        return fresh

    @staticmethod
    def _left_most(at: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of overlapping occurrences (runs of one symbol) every other one, from the left."""
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        start = np.maximum.accumulate(np.where(~chained, np.arange(len(at)), 0))
        return at[(np.arange(len(at)) - start) % 2 == 0]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of any chunks as little-endian unsigned 32-bit integers."""
        words: dict[bytes, int] = {}
        pieces = [self._pieces(chunk, words) for chunk in chunks]
        ids = self._encode_words(list(words))
        return [b"".join([w.to_bytes(4, "little") if kind else ids[w] for kind, w in own]) for own in pieces]

    def _pieces(self, chunk: str, words: dict[bytes, int]) -> list[tuple[int, int]]:
        """Words (kind 0) and special ids (kind 1) of any chunk, by the library's own rules."""
        own, at = [], 0
        parts = [(m.start(), m.end(), self.special[m[0]]) for m in self.special_at.finditer(chunk)] if self.special_at else []
        for start, end, special in [*parts, (len(chunk), len(chunk), None)]:
            for w, _ in self.split(self.normalize(chunk[at:start])):
                own.append((0, words.setdefault(bytes(map(self.byte_of.__getitem__, w)), len(words))))
            own += [(1, special)] if special is not None else []
            at = end
        return own

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        if not words:
            return []
        lengths = np.array(list(map(len, words)))
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        flat, word = self.first[raw], np.repeat(np.arange(len(words)), lengths)
        flat[ends - 1] = self.final[raw[ends - 1]]
        flat, word = self._merge(flat, word)
        data = flat.astype("<u4").tobytes()
        cuts = (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        return [data[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if any(len(t) > PIECE for t in texts):
            return [b"".join(x for piece in pieces_of(t) for x in self._encode([piece])) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        cut, words, chunks, memory = [], set(), set(), self.memory
        for text in texts:
            own, plain = cut_text(text, self.special if self.by_words else None)
            cut.append(own)
            (words if plain else chunks).update(own)
        chunks = [c for c in chunks - words if c not in memory]
        words = [w for w in words if w not in memory]
        normal = [w if w.isascii() else self.normalize(w) for w in words]
        memory.update(zip(words, self._encode_words([w.encode() for w in normal]), strict=True))
        memory.update(zip(chunks, self.encode_chunks(chunks), strict=True))
        out = [b"".join(map(memory.__getitem__, own)) for own in cut]
        memory.settle(words, chunks)
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, as a tokenizer without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[str, PairIndexBpe] = {}


def loaded(path: str) -> PairIndexBpe:
    if path not in _loaded:
        _loaded[path] = PairIndexBpe(path)
    return _loaded[path]


def text_blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``size`` bytes with the place of the first; null becomes the empty text."""
    lengths = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
    at, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= size or i + 1 == len(lengths):
            yield at, [t or "" for t in column.slice(at, i + 1 - at).to_pylist()]
            at, total = i + 1, 0


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The columns of docs and ids (array of int)."""
    return _mapped(docs, tokenizer, list(docs.columns), "ids array<int>", _ids)


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The columns of docs, n_tokens, and decoded: the text of the ids."""
    return _mapped(docs, tokenizer, list(docs.columns), "n_tokens long, decoded string", _decoded)


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the decoded text."""
    return _mapped(docs, tokenizer, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def _ids(bpe: PairIndexBpe, encoded: list[bytes]) -> list[pa.Array]:
    offsets = np.cumsum([0] + [len(x) // 4 for x in encoded]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))]


def _decoded(bpe: PairIndexBpe, encoded: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x in encoded], pa.int64()), pa.array([bpe.decode(x) for x in encoded], pa.string())]


def _digests(bpe: PairIndexBpe, encoded: list[bytes]) -> list[pa.Array]:
    return [
        pa.array([len(x) // 4 for x in encoded], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in encoded], pa.string()),
        pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in encoded], pa.string()),
    ]


def _mapped(docs: DataFrame, tokenizer: str | None, keep: list[str], made: str, make) -> DataFrame:
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    given = docs.select(*[c for c in docs.columns if c in keep or c == "text"])
    kept = [c for c in given.columns if c in keep]
    added = [T.StructField(fresh(kept, f.name), f.dataType) for f in T.StructType.fromDDL(made).fields]
    names = [f.name for f in added]
    place = given.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            own = batch.select(kept)
            for at, texts in text_blocks(batch.column(place)):
                columns = own.slice(at, len(texts)).columns
                yield pa.RecordBatch.from_arrays([*columns, *make(bpe, bpe.encode(texts))], names=[*kept, *names])

    schema = T.StructType([given.schema[c] for c in kept] + added)
    return spread(docs.sparkSession, given).mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
