"""Spelling variants: words one edit apart, by composing the vocabulary's acceptor with a one-edit transducer and itself.

The composed machine V o E o V accepts a pair of words if one inserted, deleted or replaced code point makes one of
the other. Its states are (state, edited?, state); before the edit both components are equal. The machine is dealt to
workers by initial states: a pair of a class of n code points (the longer word has n) has its edit at one place, in the
first or in the last half of the longer word, and shares the other half. So each word goes to the partitions of its
halves, for pairs in which it is the longer and in which it is the shorter one. In a partition the rest of the words is
made into a minimised acceptor, composed, and its accepted pairs are enumerated from the initial state. The edit place
of an insertion among equal code points is the last possible one, so that each pair is accepted in one partition only.

Where a partition has more than `most` words, or a rest longer than LONGEST, its initial states are split: the rest is
halved again, and the words go to two partitions that share more. A rest of one code point ends this, since it has as
many values as there are letters; so partitions are bounded and nothing is capped.

Counting is a narrow pass with sums per word before the one shuffle. Accepted pairs are not shuffled: a partition gives
a count and the best partner of each of its words.

Defined cases: a null text has no words, a null doc_id counts as empty; texts and words of any length are taken whole;
repeated rows count again; ties of n go to the word that is first in code-point order; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, sliced

LETTERS = rb"[a-z\xc0-\xff]"
#: Of crc32 values, one in so many deletes a code point from a run.
ONE_IN = 199
#: Words of a partition of initial states, at most; and the longest rest that a partition works on.
MOST, LONGEST = 2000, 48
#: Counts that a task holds before it gives them away.
HELD = 200_000


def words_of(doc_id, text: str, min_chars: int) -> Counter:
    """Occurrences of the results of one text's runs, as Latin-1 bytes, of at least min_chars code points.

    Latin-1 has a byte for every code point that a run can have; others end a run, as what replaces them does. Lower case
    of bytes is that of A to Z only.
    """
    raw = text.encode("latin-1", "replace").lower()
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out, cut = Counter(re.findall(LETTERS + b"{%d,}" % min_chars, raw)), []
    for run in out:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
        if h % ONE_IN == 0:
            cut.append((run, h % len(run)))
    for run, at, n in [(run, at, out.pop(run)) for run, at in cut]:
        if len(run) > min_chars:
            out[run[:at] + run[at + 1 :]] += n
    return out


def vocabulary(docs: DataFrame, min_chars: int = 6, min_n: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words of at least min_chars code points and min_n occurrences."""

    def batch(counts: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for b in sliced(batches, 256):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.update(words_of(d, t or "", min_chars))
            if len(counts) > HELD:
                yield batch(counts)
                counts = Counter()
        yield batch(counts)

    counted = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


class Acceptor:
    """A minimised acyclic acceptor of distinct strings; states are numbers, equal right languages are one state."""

    def __init__(self, strings: list[str]):
        self.out: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}
        self.start = self._state(sorted(strings), 0)

    def _state(self, strings: list[str], at: int) -> int:
        """The state whose right language is the strings' parts from `at` on; recursion is as deep as the longest one."""
        final, out = len(strings[0]) == at, {}
        k = int(final)
        while k < len(strings):
            c, first = strings[k][at], k
            while k < len(strings) and strings[k][at] == c:
                k += 1
            out[c] = self._state(strings[first:k], at + 1)
        key = (final, *out.items())
        if key not in self.known:
            self.known[key] = len(self.out)
            self.out.append(out)
            self.final.append(final)
        return self.known[key]

    def common(self, p: int, r: int) -> list[str]:
        """What is accepted from both states: the paths of the composed machine behind the edit."""
        key = (p, r) if p <= r else (r, p)
        if key not in self.shared:
            a, b = self.out[p], self.out[r]
            found = [""] if self.final[p] and self.final[r] else []
            for c in a.keys() & b.keys():
                found += [c + rest for rest in self.common(a[c], b[c])]
            self.shared[key] = found
        return self.shared[key]

    def pairs(self, size: int, behind: str) -> Iterator[tuple[str, str]]:
        """Accepted pairs in which one string has `size` code points; of two lengths, the longer string first.

        The strings have `size` code points or one less, and `behind` follows all of them.
        """
        todo = [("", self.start)]
        while todo:
            read, q = todo.pop()
            out = sorted(self.out[q].items())
            for k, (c, to) in enumerate(out):
                todo.append((read + c, to))
                for d, other in out[k + 1 :]:
                    for rest in self.common(to, other):
                        if len(read) + len(rest) + 1 == size:
                            yield read + c + rest, read + d + rest
                for rest in self.common(to, q):
                    # among equal code points the last one is the edit's place
                    if not (rest + behind).startswith(c):
                        yield read + c + rest, read + rest


def half(n: Column, lo: Column, hi: Column, longer: bool) -> Column:
    """Key of the partition that word belongs to in class n with the edit in [lo, hi) of the longer word."""
    short = F.lit(0 if longer else 1)
    before, behind = F.substring("word", F.lit(1), lo), F.substring("word", hi - short + 1, F.length("word"))
    key = F.xxhash64(n, lo, hi, before, behind)
    return F.struct(key.alias("key"), n.alias("size"), lo.alias("lo"), hi.alias("hi"), F.lit(longer).alias("longer"))


def halves(words: DataFrame) -> DataFrame:
    """(word, n, key, size, lo, hi, longer): each word in its four first partitions."""
    n, zero = F.length("word"), F.lit(0)
    keys = []
    for longer in (True, False):
        size = n if longer else n + 1
        mid = (size / 2).cast("int")
        keys += [half(size, zero, mid, longer), half(size, mid, size, longer)]
    return words.select("word", "n", F.inline(F.array(*keys)))


def halved(rows: DataFrame) -> DataFrame:
    """The rows in the partitions of the two halves of their rests."""
    size, lo, hi = F.col("size"), F.col("lo"), F.col("hi")
    mid = ((lo + hi) / 2).cast("int")
    both = lambda longer: F.array(half(size, lo, mid, longer), half(size, mid, hi, longer))
    return rows.select("word", "n", F.inline(F.when(F.col("longer"), both(True)).otherwise(both(False))))


def partitions(words: DataFrame, most: int = MOST) -> DataFrame:
    """(key, members): all partitions of two words or more, with at most `most` words each, or a rest of one code point."""
    rows, done = halves(words), None
    while True:
        rows = saved(rows, "initial-states")
        sizes = rows.groupBy("key").agg(F.count("*").alias("words"), F.max(F.col("hi") - F.col("lo")).alias("rest"), F.max("longer").alias("any"))
        sizes = sizes.where("words > 1 AND any")  # words that are only the shorter ones have no pair
        large = ((F.col("words") > most) | (F.col("rest") > LONGEST)) & (F.col("rest") > 1)
        sizes = saved(sizes.select("key", large.alias("large")), "initial-state-sizes")
        now = rows.join(sizes.where("NOT large").select("key"), "key")
        done = now if done is None else done.unionByName(now)
        if sizes.where("large").isEmpty():
            return done.groupBy("key").agg(F.collect_list(F.struct("word", "n", "size", "lo", "hi", "longer")).alias("members"))
        rows = halved(rows.join(sizes.where("large").select("key"), "key"))


def near_in(members: list[dict]) -> dict[str, list]:
    """word -> [near words, -n and word of the best one] for the pairs of one partition."""
    rests: dict[tuple, dict[str, tuple[str, int]]] = {}  # a hash may hold several initial states: they are told apart here
    for m in members:
        word, lo, hi = m["word"], m["lo"], m["hi"] - (not m["longer"])
        rests.setdefault((m["size"], lo, m["hi"], word[:lo], word[hi:]), {})[word[lo:hi]] = (word, m["n"])
    found: dict[str, list] = {}

    def add(word: str, other: str, n: int) -> None:
        mine = found.setdefault(word, [0, 0, ""])
        mine[0] += 1
        if mine[0] == 1 or (-n, other) < (mine[1], mine[2]):
            mine[1], mine[2] = -n, other

    for (_, lo, hi, _, behind), of in rests.items():
        if len(of) > 1:
            for x, y in Acceptor([*of]).pairs(hi - lo, behind):
                (a, n_a), (b, n_b) = of[x], of[y]
                add(a, b, n_b)
                add(b, a, n_a)
    return found


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, near_n, near): number of words one edit away, and the one of largest n, for words that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 64):
            rows = [(w, *x) for members in b.column(0) for w, x in near_in(members.as_py()).items()]
            if rows:
                word, count, n, near = zip(*rows, strict=True)
                columns = [pa.array(word), pa.array(count, pa.int64()), pa.array(n, pa.int64()), pa.array(near)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "n", "near"])

    pairs = partitions(words, most).select("members").mapInArrow(run, "word string, n_near long, n long, near string")
    best = pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("n", "near")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.near").alias("near"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chains of (word, form) end. Each round doubles the step; n grows along a chain, so it ends."""
    chain = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = saved(chain.join(on, "root", "left").select("word", "root", "next"), "roots")
        if step.where("next IS NOT NULL").isEmpty():
            return chain
        chain = step.select("word", F.coalesce("next", "root").alias("root"))


def variants(docs: DataFrame, min_chars: int = 6, min_n: int = 5, factor: int = 5, most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of docs. See the module.

    form is the near word of largest n if it occurs at least `factor` (2 or more) times as often as the word.
    """
    words = saved(vocabulary(docs, min_chars, min_n), "vocabulary")
    out = words.join(near_words(words, most), "word", "left")
    has = F.col("near_n") >= factor * F.col("n")
    out = saved(
        out.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(has, F.col("near")).alias("form"),
            F.when(has, F.col("near_n")).alias("form_n"),
        ),
        "forms",
    )
    ends = roots(out.where("form IS NOT NULL"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
