"""Byte-pair encoding and decoding of whole texts under a published vocabulary.

Merging keeps a contiguous array of part boundaries and the ranks of adjacent parts: the smallest rank is found by a
scan, its boundary deleted, and the two ranks beside it refreshed.  That is fastest for words of ordinary length; longer
ones take the same merges from a heap, so a word of any length stays near linear.  Words repeat, so each worker keeps the
ids of recent ones in two generations of bounded size.

Texts are split by Python's tables of characters.  A text with a character that they do not know yet, or not any more as
the library that publishes the vocabulary does, is put in normal form and split by that library; merging is the same.

Null texts count as empty and have no tokens.  Text that spells a special token becomes that token.  Repeated rows are
encoded alike, an empty table gives an empty result, and only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from perinuc.llm.common import own

# fixed values: white space and the split pattern of the published vocabulary
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

SHIFT = 24
LOW, NEVER = (1 << SHIFT) - 1, 1 << 62

# parts up to which a word is merged by scanning
SHORT = 64
# words, and their characters, of one generation of remembered ids
REMEMBER, REMEMBER_CHARS = 100_000, 128


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    symbol = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbol[b] for b in range(256)]


class Vocabulary:
    """Merges, symbols and special tokens of a vocabulary file."""

    def __init__(self, file: str | Path):
        spec = json.loads(Path(file).read_text(encoding="utf-8"))
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = ids | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        # rank and new part of a pair in one number, so that the smallest number is the smallest rank
        self.merges: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault((ids[a], ids[b]), rank << SHIFT | ids[a + b])
        symbols = byte_symbols()
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.library = Tokenizer.from_file(str(file))
        self.inner = [ids[s] for s in symbols]
        self.final = [ids[s + self.end] for s in symbols]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def merge_scan(self, parts: list[int]) -> list[int]:
        """Merge a short word: always the smallest rank, the leftmost of equal ones."""
        rank_of = self.merges.get
        ranks = [rank_of(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at] = best & LOW
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of((parts[at - 1], parts[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank_of((parts[at], parts[at + 1]), NEVER)
        return parts

    def merge_heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word, over a linked list and a heap of adjacent pairs."""
        n, merges = len(parts), self.merges
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m >> SHIFT, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := merges.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue  # one of the parts has been merged meanwhile
            parts[i], parts[j], right[i] = merges[(a, b)] & LOW, -1, right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := merges.get((parts[x], parts[y]))):
                    heapq.heappush(heap, (m >> SHIFT, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def bytes_of(self, symbols: str) -> bytes:
        return bytes(map(self.byte.__getitem__, symbols))

    def word(self, word: str) -> list[int]:
        return self.merged(word.encode("utf-8"))

    def merged(self, data: bytes) -> list[int]:
        """Ids of the parts of one word, given as its bytes."""
        parts = [self.inner[b] for b in data[:-1]]
        parts.append(self.final[data[-1]])
        return self.merge_scan(parts) if len(parts) <= SHORT else self.merge_heap(parts)


class Encoder(dict):
    """Ids of the space-free chunks of a text, as little-endian bytes, remembered between texts."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.older = vocabulary, {}
        self.pieces = regex.compile(PIECE).findall
        self.known: set[str] = set()

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            word = self.vocabulary.word
            got = np.array([i for piece in self.pieces(chunk) for i in word(piece)], "<u4").tobytes()
        if len(chunk) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def _assigned(self, text: str) -> bool:
        """Whether Python's tables know every character of the text."""
        fresh = set(text) - self.known
        self.known.update(c for c in fresh if unicodedata.category(c) != "Cn")
        return fresh <= self.known

    def _ordinary(self, text: str) -> bytes:
        if not text.isascii():
            if not self._assigned(text):
                return self._by_library(text)
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without regard to place
        text = text.lower()
        for space in SPACES:
            if space != " " and space in text:
                text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))

    def _by_library(self, text: str) -> bytes:
        """The library's normal form and pieces, in which a byte is a symbol; the merges are those of any other text."""
        library = self.vocabulary.library
        pieces = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(text))
        merged = (self.vocabulary.merged(self.vocabulary.bytes_of(piece)) for piece, _ in pieces)
        return np.array([i for ids in merged for i in ids], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special
        if not any(s in text for s in special):
            return self._ordinary(text)
        return b"".join(
            np.array([special[part]], "<u4").tobytes() if part in special else self._ordinary(part)
            for part in self.vocabulary.split_special.split(text)
        )

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.vocabulary.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", tokens: bool = False
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``tokens`` also ids and decoded text.

    ``vocabulary`` names a file that every executor has, such as one of an installed package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(vocabulary))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: list[tuple] = []
                for text_ in part.column(1).to_pylist():
                    ids = encoder.encode(text_ or "")
                    plain = encoder.decode(ids)
                    digests = hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
                    kept = (np.frombuffer(ids, "<u4").astype(np.int32), plain) if tokens else ()
                    found.append((len(ids) // 4, *digests, *kept))
                n, a, b, *more = zip(*found)
                arrays = [part.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
                if tokens:
                    arrays += [pa.array(more[0], pa.list_(pa.int32())), pa.array(more[1])]
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(own(docs, doc_id).alias("doc_id"), own(docs, text).cast("string").alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>, decoded string" if tokens else ""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if tokens else [])
    return rows.mapInArrow(run, schema)
