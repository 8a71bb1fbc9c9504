"""Edit-aware token counts: only what edits touch is encoded again.

A document is cut into pre-tokens. Runs of up to LEAF pre-tokens are the leaves of a segment tree, whose nodes hold
sums of characters and tokens. An edit (start, removed, inserted; code points, applied in order, each to the text that
the ones before have left) finds its first leaf by character sums, goes back to a pre-token that ends well before the
edit, and splits text again from there until a boundary falls on an old one behind the edit; the old pre-tokens follow
unchanged. Only the new pre-tokens are encoded; then the sums above the touched leaves are updated. A leaf that grows
beyond four times LEAF causes one new tree of the same pre-tokens, without encoding.

Boundaries are safe: a pre-token's end depends on three characters behind it at most, and where two splits share a
boundary they agree from there on. Special tokens' strings are ordinary text here.

Trees are kept between batches of edits: `counted` stores the characters and tokens of every pre-token beside its text,
and `edited` takes them up again, applies a batch of edits and stores the new text and tree; it splits and encodes the
edits' neighbourhoods alone. `edited_counts` does both at once for documents without a stored tree.

Each is one narrow pass over documents that carry their edits as an array; `with_edits` brings an edit table
into this form by one shuffle of the edits. Memory is bounded by an Arrow batch and a document.

Defined cases: a null text counts as empty; null or no edits leave the count as it is; starts and removals beyond the
text are cut to it; null insertions are empty, null starts are 0; edits of unknown documents are dropped; repeated
rows each get a row; an empty table gives an empty result; extra columns pass through, clashing output names get a
trailing underscore.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SIMPLE, SIMPLE_PATTERN, Bpe, read_spec, worker_bpe
from .common import fresh, sliced

LEAF, REACH = 64, 3
EDITS = "array<struct<start:int,removed:int,inserted:string>>"


class Counted:
    """A text's pre-tokens in the leaves of a segment tree of character and token sums."""

    def __init__(self, text: str, bpe: Bpe):
        self.bpe, self.text, self.encoded = bpe, text, 0
        # equal to the full pattern on texts of simple characters; edits may bring others, so that the choice is per split
        words = self.split(text, 0)
        self.build(list(words), [self.tokens(w) for w in words])

    @classmethod
    def stored(cls, text: str, lengths: bytes, counts: bytes, bpe: Bpe) -> Counted:
        """The tree of a text whose pre-tokens were counted before: nothing is split or encoded."""
        c = cls.__new__(cls)
        c.bpe, c.text, c.encoded = bpe, text, 0
        sizes = array("i", lengths).tolist()
        if sum(sizes) != len(text) or len(lengths) != len(counts):
            raise ValueError("a stored tree is not that of its text")
        c.plant(sizes, array("i", counts).tolist())
        return c

    def leaf_arrays(self) -> tuple[bytes, bytes]:
        """Characters and tokens of every pre-token in order, as 32-bit integers: what `stored` takes."""
        return tuple(array("i", [x for leaf in self.leaves for x in leaf[k]]).tobytes() for k in (0, 1))

    def tokens(self, word: str) -> int:
        self.encoded += 1
        return len(self.bpe[word]) // 4

    def split(self, text: str, at: int) -> list[str]:
        return (self.bpe.pattern if SIMPLE.search(text) else SIMPLE_PATTERN).findall(text, at)

    def build(self, words: list[str], counts: list[int]) -> None:
        self.plant([len(w) for w in words], counts)

    def plant(self, sizes: list[int], counts: list[int]) -> None:
        """A tree over pre-tokens of these sizes and counts."""
        self.leaves = [(sizes[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(sizes), LEAF)] or [([], [])]
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.sums[self.size + i] = sum(a), sum(b)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def leaf_of(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf for the text's end) and the leaf's first character."""
        i, at = 1, 0
        while i < self.size:
            i *= 2
            if char >= at + self.chars[i] and self.chars[i + 1]:
                at += self.chars[i]
                i += 1
        return min(i - self.size, len(self.leaves) - 1), at

    def update(self, leaf: int) -> None:
        a, b = self.leaves[leaf]
        i = leaf + self.size
        self.chars[i], self.sums[i] = sum(a), sum(b)
        while i > 1:
            i //= 2
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def edit(self, start: int, removed: int, inserted: str) -> None:
        old = self.text
        start = min(max(start, 0), len(old))
        stop = min(start + max(removed, 0), len(old))
        self.text = text = old[:start] + inserted + old[stop:]
        shift = len(text) - len(old)
        # the first pre-token that may change: one that ends less than REACH before the edit
        first, at = self.leaf_of(max(start - REACH, 0))
        while first and at > start - REACH:  # an empty leaf, or one that begins too late
            first -= 1
            at -= self.chars[first + self.size]
        k, sizes = 0, self.leaves[first][0]
        while k < len(sizes) and at + sizes[k] + REACH <= start:
            at += sizes[k]
            k += 1
        # split anew until a boundary falls on an old one behind the edit
        words, counts = [], []
        leaf, j, behind = first, k, at  # old place
        now = at
        pattern = self.bpe.pattern
        for m in pattern.finditer(text, at):
            if now - shift >= stop:
                while behind < now - shift and leaf < len(self.leaves):
                    if j < len(self.leaves[leaf][0]):
                        behind += self.leaves[leaf][0][j]
                        j += 1
                    else:
                        leaf, j = leaf + 1, 0
                if behind == now - shift and leaf < len(self.leaves):
                    break
            words.append(len(m[0]))
            counts.append(self.tokens(m[0]))
            now = m.end()
        else:
            leaf, j = len(self.leaves), 0
        if leaf == first:
            a, b = self.leaves[first]
            a[k:j], b[k:j] = words, counts
        else:
            a, b = self.leaves[first]
            a[k:], b[k:] = words, counts
            for i in range(first + 1, min(leaf, len(self.leaves))):
                self.leaves[i] = ([], [])
                self.update(i)
            if leaf < len(self.leaves):
                del self.leaves[leaf][0][:j], self.leaves[leaf][1][:j]
                self.update(leaf)
        self.update(first)
        if len(self.leaves[first][0]) > 4 * LEAF:
            self.plant([x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b])


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with column `edits`: each document's rows of edits (doc_id, seq, start, removed, inserted) by seq."""
    by = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("e"))
    slim = F.transform("e", lambda x: F.struct(x.start.cast("int").alias("start"), x.removed.cast("int").alias("removed"), x.inserted.alias("inserted")))
    return docs.join(by.select("doc_id", slim.alias("edits")), "doc_id", "left")


def edited_counts(docs: DataFrame, path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """Adds n_tokens (before), n_tokens_edited, n_pretokens and n_reencoded (pre-tokens encoded for the edits)."""
    names = fresh(docs, "n_tokens", "n_tokens_edited", "n_pretokens", "n_reencoded")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    a, e = docs.columns.index(text), docs.columns.index(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for b in sliced(batches):
            rows = []
            for x, changes in zip(b.column(a), b.column(e), strict=True):
                c = Counted(x.as_py() or "", bpe)
                before, words = c.total, c.encoded
                for change in changes.as_py() or []:
                    if change:
                        c.edit(change["start"] or 0, change["removed"] or 0, change["inserted"] or "")
                rows.append((before, c.total, words, c.encoded - words))
            added = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=[*b.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)]))


TREE = T.StructType([T.StructField("lengths", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def counted(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and `tree`, the tree of every text, to be written beside it. Null texts count as empty."""
    names = fresh(docs, "n_tokens", "tree")
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    a = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for b in sliced(batches):
            trees = [Counted(x.as_py() or "", bpe) for x in b.column(a)]
            yield _with(b, names, [[c.total for c in trees]], trees)

    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], TREE)]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def edited(docs: DataFrame, path: str, text: str = "text", tree: str = "tree", edits: str = "edits") -> DataFrame:
    """Applies edits to texts with stored trees: text, tree and n_tokens as they are then, and n_reencoded.

    docs: text, tree (of that very text; another one is an error, null is counted anew), edits, and other columns but
    n_tokens and n_reencoded, which are replaced. The result without its edits is the input of the next batch.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    docs = docs.drop("n_tokens", "n_reencoded")
    keep = [c for c in docs.columns if c not in (text, tree)]
    docs = docs.select(*keep, text, tree)
    e = keep.index(edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(spec.value)
        for b in sliced(batches):
            trees = []
            for x, t, changes in zip(b.column(len(keep)), b.column(len(keep) + 1), b.column(e), strict=True):
                x, t = x.as_py() or "", t.as_py()
                c = Counted.stored(x, t["lengths"], t["counts"], bpe) if t else Counted(x, bpe)
                for change in changes.as_py() or []:
                    if change:
                        c.edit(change["start"] or 0, change["removed"] or 0, change["inserted"] or "")
                trees.append(c)
            head = pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([c.text for c in trees], pa.string())], names=[*keep, text])
            yield _with(head, ["n_tokens", "n_reencoded", tree], [[c.total for c in trees], [c.encoded for c in trees]], trees)

    fields = [docs.schema[c] for c in keep] + [T.StructField(text, T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_reencoded", T.LongType()), T.StructField(tree, TREE)]
    return docs.mapInArrow(run, T.StructType(fields))


def _with(b: pa.RecordBatch, names: list[str], numbers: list[list[int]], trees: list[Counted]) -> pa.RecordBatch:
    """The batch with columns of numbers, and last the trees."""
    leaves = [c.leaf_arrays() for c in trees]
    stored = pa.StructArray.from_arrays([pa.array([x[k] for x in leaves], pa.binary()) for k in (0, 1)], names=["lengths", "counts"])
    return pa.RecordBatch.from_arrays([*b.columns, *(pa.array(n, pa.int64()) for n in numbers), stored], names=[*b.schema.names, *names])
