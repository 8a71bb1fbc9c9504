"""Harmonic packing: documents into sequences of `capacity` tokens, by classes of reciprocal capacity.

A document's ids (with an end id) are cut into pieces whose lengths fill a class well: class j holds lengths just up to
capacity / j, and j of its pieces fill a sequence. First come whole sequences, then the rest is cut at the next
reciprocal below it wherever keeping it whole would leave more than `waste` of its place empty. Lengths of at most
sqrt(capacity) are a class each. Each worker fills the sequences of its classes on its own, with a counter per class,
so packing needs no shuffle. What is left in sequences that a worker can't fill, less than one per class, is dealt to
fewer workers, which go on in the same way until one is left; its last sequences, less than one per class, are cut anew
and filled one after the other. The very last one is cut at powers of two, which need no padding.

The number of classes is bounded by capacity alone (127 for 4096), and so is what the last worker holds. Pieces are
written between levels, as lengths and checksums; a lost executor repeats its tasks.

Defined cases: a null text counts as empty and has the end id alone; texts of any length are packed whole; repeated rows
are packed as often as they come; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from .bpe import read_spec
from .common import saved, sliced

#: Texts of other characters are encoded by the library as a whole; in these, lower case and pre-tokens are plain.
OTHERS = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-ÿ]")
#: What the vocabulary's pattern cuts off as one pre-token behind an apostrophe, in lower case.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Pre-tokens that one Python worker remembers; and bytes of text that are cut up at once.
REMEMBERED, CHUNK = 1_000_000, 1 << 21
#: Share of a place in a sequence that a piece may leave empty before it is cut.
WASTE = 0.02
#: Pieces of unfilled sequences that one worker of the next level gets; many more than a worker can leave (20,000).
LEVEL_ROWS = 400_000
PLACED = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _byte_table() -> tuple[bytes, np.ndarray]:
    """Lower case of Latin-1 bytes, and the class of each lower byte: 0 space, 1 letter, 2 digit, 3 other."""
    lower = bytes(range(256)).decode("latin-1").lower().encode("latin-1")
    kinds = np.full(256, 3, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[[k for k in range(256) if chr(k).isalpha() and (k < 128 or k > 191)]] = 1
    kinds[48:58] = 2
    return lower, kinds


LOWER, KINDS = _byte_table()


def pre_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-case Latin-1 bytes that end with two spaces.

    A pre-token is a run of letters, one digit, or a run of other characters; an apostrophe that starts its run takes one
    of ENDINGS with it.
    """
    kind = KINDS[raw]
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    start = (kind != 0) & ((kind != before) | (kind == 2))
    at = np.flatnonzero(start & (raw == ord("'")))
    at = at[kind[at + 1] == 1]
    for ending in ENDINGS:
        letters = ending.encode()
        here = at[np.logical_and.reduce([raw[at + 1 + k] == c for k, c in enumerate(letters)])]
        start[here + 1] = False
        behind = here + 1 + len(letters)
        start[behind] |= kind[behind] == 1
    last = np.concatenate([start[1:] | (kind[1:] == 0), [True]]) & (kind != 0)
    return np.flatnonzero(start), np.flatnonzero(last) + 1


class Words:
    """Ids by the tokenizers library, remembered per pre-token: short ones by their eight bytes, others by themselves."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[int | bytes, int] = {}
        self.sizes, self.firsts, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def learned(self, key: int | bytes, word: bytes) -> int:
        """The number of a new pre-token."""
        ids, n = self.whole(word.decode("latin-1")), len(self.known)
        if n == len(self.sizes):
            self.sizes, self.firsts = np.resize(self.sizes, 2 * n), np.resize(self.firsts, 2 * n)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.sizes[n], self.firsts[n] = len(ids), self.used
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known[key] = n
        return n

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of plain characters, all at once."""
        if len(self.known) > REMEMBERED:
            self.forget()
        parts = [t.encode("latin-1").translate(LOWER) + b"  " for t in texts]
        data = b"".join(parts)
        raw = np.frombuffer(data + bytes(8), np.uint8)
        starts, ends = pre_tokens(raw[: len(data)])
        size = ends - starts
        number = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(size <= 8)
        keys, known = np.zeros(len(short), np.uint64), self.known
        for k in range(8):  # no byte of a pre-token is 0, so that eight bytes tell shorter ones apart
            keys |= np.where(size[short] > k, raw[starts[short] + k], 0).astype(np.uint64) << np.uint64(8 * k)
        keys, first, back = np.unique(keys, return_index=True, return_inverse=True)
        number[short] = np.array([known[key] if key in known else self.learned(key, data[starts[i] : ends[i]]) for key, i in zip(keys.tolist(), short[first].tolist(), strict=True)], np.int64)[back]
        long = np.flatnonzero(size > 8)
        words = [data[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        number[long] = [known[w] if w in known else self.learned(w, w) for w in words]
        # ids of pre-token after pre-token, then cut at the texts' ends
        n = self.sizes[number]
        done = np.cumsum(n)
        ids = self.ids[np.repeat(self.firsts[number] - (done - n), n) + np.arange(done[-1] if len(done) else 0)]
        bounds = np.searchsorted(starts, np.cumsum([len(p) for p in parts]))
        return np.split(ids, np.concatenate([[0], done])[bounds[:-1]])

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts. Those with other characters or a special token's string are left to the library."""
        out: list[np.ndarray] = [None] * len(texts)
        batch, size = [], 0
        for i, t in enumerate([*texts, None]):
            if batch and (t is None or size > CHUNK):
                for k, ids in zip(batch, self.plain([texts[k] for k in batch]), strict=True):
                    out[k] = ids
                batch, size = [], 0
            if t is None:
                break
            if OTHERS.search(t) or any(s in t for s in self.special):
                out[i] = self.whole(t)
            else:
                batch.append(i)
                size += len(t)
        return out


def class_of(length: int, capacity: int) -> tuple[int, int]:
    """(class, pieces that fill a sequence): short lengths are a class each, others go by their reciprocal."""
    small = isqrt(capacity)
    return (length if length <= small else small + capacity // length), capacity // length


def cuts(length: int, capacity: int, waste: float = WASTE) -> list[int]:
    """Lengths of the pieces that a document of so many tokens is cut into, in order."""
    out = [capacity] * (length // capacity)
    rest, small = length % capacity, isqrt(capacity)
    while rest > small:
        j = capacity // rest
        if capacity - j * rest <= waste * capacity:
            break
        piece = capacity // (j + 1)
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


_loaded: dict[str, Words] = {}


def worker_words(spec: str) -> Words:
    """The vocabulary, parsed once in each Python worker."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Words(spec)
    return _loaded[spec]


class Filler:
    """Sequences of one worker: a counter per class gives each piece its sequence and its place there."""

    def __init__(self, level: int, worker: int, capacity: int):
        self.base, self.capacity = level << 56 | worker << 32, capacity
        self.next = 0
        self.open: dict[int, list[tuple]] = {}  # class -> placed pieces of its unfilled sequence, fewer than fill it

    def sequence(self) -> int:
        self.next += 1
        return self.base | self.next - 1

    def place(self, row: tuple) -> list[tuple]:
        """Takes a piece (doc_id, start, length, ids_crc32, doc_tokens, ids), and gives the sequence that it fills, if any."""
        kind, most = class_of(row[2], self.capacity)
        mine = self.open.setdefault(kind, [])
        sequence, offset = (mine[-1][5], mine[-1][6] + mine[-1][2]) if mine else (self.sequence(), 0)
        mine.append((*row[:5], sequence, offset, row[5]))
        return self.open.pop(kind) if len(mine) == most else []

    def unfilled(self) -> list[tuple]:
        return [row for mine in self.open.values() for row in mine]

    def chopped(self) -> Iterator[tuple]:
        """Unfilled sequences' pieces one after the other, cut at whole sequences; what remains is cut at powers of two."""
        rows = self.unfilled()
        remaining, room, sequence, offset = sum(row[2] for row in rows), 0, 0, 0
        for doc, start, length, _, total, _, _, ids in rows:
            at = 0
            while at < length:
                if not room:
                    room = self.capacity if remaining >= self.capacity else 1 << remaining.bit_length() - 1
                    sequence, offset = self.sequence(), 0
                n = min(room, length - at)
                yield doc, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), total, sequence, offset, None
                at, room, offset, remaining = at + n, room - n, offset + n, remaining - n


def _filled(found: Iterator[tuple], kind: pa.DataType, level: int, capacity: int, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Pieces of filled sequences without their ids, then those of unfilled ones with them; or cut anew by the last worker."""
    filler, out = Filler(level, TaskContext.get().partitionId(), capacity), []
    for row in found:
        out += ((*done[:7], None) for done in filler.place(row))
        if len(out) > 10_000:
            yield _batch(out, kind)
            out = []
    yield _batch([*out, *(filler.chopped() if last else filler.unfilled())], kind)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(PLACED)
    kinds = [kind, *[pa.int64()] * 6, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PLACED)


def packed(
    docs: DataFrame, path: str, end_id: int, capacity: int = 4096, waste: float = WASTE, level_rows: int = LEVEL_ROWS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. See the module."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    plain = docs.schema["doc_id"].dataType
    kind, end = to_arrow_type(plain), np.array([end_id], "<u4").tobytes()
    schema = f"doc_id {plain.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

    def pieces(words: Words, b: pa.RecordBatch) -> Iterator[tuple]:
        texts = [t or "" for t in b.column(1).to_pylist()]
        for doc, found in zip(b.column(0).to_pylist(), words.encoded(texts), strict=True):
            ids, start = found.astype("<u4").tobytes() + end, 0
            for n in cuts(len(ids) // 4, capacity, waste):
                mine = ids[4 * start : 4 * (start + n)]
                yield doc, start, n, zlib.crc32(mine), len(ids) // 4, mine
                start += n

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = worker_words(spec.value)
        yield from _filled((row for b in sliced(batches, 1024) for row in pieces(words, b)), kind, 0, capacity)

    def further(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (tuple(row.values()) for b in sliced(batches, 4096) for row in b.to_pylist())
            yield from _filled(rows, kind, level, capacity, last)

        return run

    now, level, done, workers = saved(docs.mapInArrow(first, schema), "packed"), 0, None, None
    while True:
        filled = now.where("ids IS NULL").drop("ids")
        done = filled if done is None else done.unionByName(filled)
        left = now.where("ids IS NOT NULL")
        parts = -(-left.count() // level_rows)
        if not parts:
            return done
        level += 1
        if workers is not None:  # half as many workers at most, also where the rows allowed are fewer than workers leave
            parts = max(1, min(parts, workers // 2))
        workers = parts
        # by sequences, of which each worker has few: a document with many repeated rows is no hot key
        dealt = left.repartition(parts, "sequence_id") if parts > 1 else left.coalesce(1)
        dealt = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")
        now = saved(dealt.mapInArrow(further(level, parts == 1), schema), "packed")
