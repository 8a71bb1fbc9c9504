"""Byte-level BPE encoding and decoding with a priority queue of merge ranks over a linked symbol list.

A text is split at special tokens, then into pre-tokens by the GPT-2 pattern. A pre-token's bytes form a doubly
linked list of symbols; a heap holds (merge rank, position) of every adjacent pair. Popping an entry merges its pair
unless it is stale: a neighbour has been merged since, so that the pair at this position has another rank. Decoding
concatenates the vocabulary's byte strings. Encodings of pre-tokens are remembered per Python worker in a dict of
bounded size, which changes the speed only.

The work is one narrow pass: no shuffle, and memory bounded by an Arrow batch and the dict.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty text; texts of any
length are encoded whole (O(n log n) for one pre-token of n bytes); equal texts give equal rows; an empty table gives
an empty result; other columns of the input pass through, and output names that clash get a trailing underscore.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fresh, sliced

#: Fixed value: the pattern of GPT-2's pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encodings that one Python worker remembers, in two halves of which the older one is dropped when the newer is full.
REMEMBERED = 300_000
#: Bits of a symbol in a packed pair, bits of a position in a heap entry, and the mark of a symbol that is merged away.
SHIFT, PLACE, GONE = 20, 40, (1 << 20) - 1
#: Texts without other characters take the standard library's faster expressions, with the same result.
SIMPLE = re.compile(r"[^\x00-\x1b\x20-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
SIMPLE_PATTERN = re.compile(
    rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    others = [b for b in range(256) if b not in set(plain)]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


class Bpe(dict):
    """A byte-level vocabulary; as a dict, pre-token -> ids as little-endian 32-bit bytes, filled on demand."""

    def __init__(self, spec: str, remembered: int = REMEMBERED):
        super().__init__()
        data, letters = json.loads(spec), byte_letters()
        model, self.remembered = data["model"], remembered
        self.older: dict[str, bytes] = {}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pair_of = [vocab[a] << SHIFT | vocab[b] for a, b in merges]
        self.made = [vocab[a + b] for a, b in merges]
        self.ranks = {pair: rank for rank, pair in enumerate(self.pair_of)}
        size = max(max(vocab.values()), max(self.special.values(), default=0)) + 1
        self.strings = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(letters[x] for x in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.pattern = regex.compile(PATTERN)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def __missing__(self, word: str) -> bytes:
        if 2 * len(self) >= self.remembered:
            self.older = dict(self)
            self.clear()
        found = self.older.get(word)
        if found is None:
            found = array("I", self.merged(word.encode())).tobytes()
        self[word] = found
        return found

    def merged(self, raw: bytes) -> list[int]:
        """Ids of one pre-token."""
        n = len(raw)
        symbols = [*map(self.first.__getitem__, raw), GONE]
        get, pair_of, made = self.ranks.get, self.pair_of, self.made
        heap = []
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            rank = get(left << SHIFT | right)
            if rank is not None:
                heap.append(rank << PLACE | i - 1)
            left = right
        if heap:
            heapify(heap)
            after, before = [*range(1, n + 1), n], [*range(-1, n)]
            while heap:
                rank = heappop(heap)
                i = rank & (1 << PLACE) - 1
                rank >>= PLACE
                j = after[i]
                if symbols[i] << SHIFT | symbols[j] != pair_of[rank]:
                    continue  # stale: one of the pair has been merged since
                new = symbols[i] = made[rank]
                symbols[j] = GONE
                k = after[i] = after[j]
                before[k] = i
                rank = get(new << SHIFT | symbols[k])
                if rank is not None:
                    heappush(heap, rank << PLACE | i)
                if i:
                    h = before[i]
                    rank = get(symbols[h] << SHIFT | new)
                    if rank is not None:
                        heappush(heap, rank << PLACE | h)
        return [s for s in symbols if s != GONE]

    def encoded(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        find = (self.pattern if SIMPLE.search(text) else SIMPLE_PATTERN).findall
        if self.splits and self.splits.search(text):
            parts = []
            for k, part in enumerate(self.splits.split(text)):
                if k % 2:
                    parts.append(array("I", [self.special[part]]).tobytes())
                else:
                    parts += map(self.__getitem__, find(part))
            return b"".join(parts)
        return b"".join(map(self.__getitem__, find(text)))

    def decoded(self, ids: bytes) -> str:
        strings = self.strings
        return b"".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def worker_bpe(spec: str) -> Bpe:
    """The vocabulary, parsed once in each Python worker."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Bpe(spec)
    return _loaded[spec]


def read_spec(path: str) -> str:
    """A tokenizer's JSON file; its size is that of a vocabulary and does not grow with the data."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds column `ids` (binary: little-endian unsigned 32-bit token ids) to docs, and with `decoded` what they decode to.

    Decoding in the same pass spares a second set of Python workers with the vocabulary. See the module for defined cases.
    """
    names = fresh(docs, ids, *([decoded] if decoded else []))
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for b in sliced(batches):
            coded = [bpe.encoded(x.as_py() or "") for x in b.column(at)]
            added = [pa.array(coded, pa.binary())]
            if decoded:
                added.append(pa.array(map(bpe.decoded, coded), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    fields = [T.StructField(n, t) for n, t in zip(names, (T.BinaryType(), T.StringType()), strict=False)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(coded: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds column `decoded` (string) to a table with a binary column of ids; null ids decode to the empty text."""
    (name,) = fresh(coded, decoded)
    spec = coded.sparkSession.sparkContext.broadcast(read_spec(path))
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for b in sliced(batches):
            out = pa.array([bpe.decoded(x.as_py() or b"") for x in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, name])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(name, T.StringType())]))
