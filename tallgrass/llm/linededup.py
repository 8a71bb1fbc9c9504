"""Line deduplication by a deletion-neighbourhood join.

A line (between line feeds) that is not blank is dropped if an earlier line, by (doc_id, text key, line number), equals
it; a line of at least MIN_CHARS characters also if an earlier one is within one edit (insertion, deletion or
substitution of a character) of it: one edit is a twentieth or less of such a line, but makes other words of short ones.
Whether the earlier line is dropped itself does not matter, so the result does not depend on the order of work.

1. Distinct lines: hash, earliest place, number of places and hashes of halves, by one aggregation without texts. Lines
   are the same where two 64-bit hashes of different seeds agree, as 128 bits would; a line's first place stands for it
   from there on. The text key of a place has 64 bits: it tells apart the texts of one doc_id only.
2. Half keys: of two lines within one edit, the first or the last half (of the shorter one's length) is equal. Each
   distinct line gives the hashes of these halves; only lines that share one with another line go on. This loses no
   pair and spares nearly all lines the neighbourhood.
3. Deletion neighbourhood: for each shared half, the hashes of all variants of the rest with one character deleted,
   and of the rest as it is, under the half's key. Lines with the same variant and the same deleted position are within
   one substitution of each other, all of them, so the earliest stands for all; a variant equal to a whole rest is an
   insertion or deletion. So links grow with the variants, and no pairs of a group are made.
4. Each link's edit distance is checked on the lines themselves (a hash might collide).
5. Dropped places are collected per document (numbers only) and cut out of the texts.

Hot lines and hot keys meet in partial aggregations; joins are plain equi-joins that Spark can split.

Defined cases: blank lines (white space only, of any length) always stay; a null text stays null; texts that are equal with an equal
doc_id are one document (both rows get the same result); a null doc_id comes first; an empty table gives an empty
result; extra columns pass through, output names that clash get a trailing underscore. Very long lines cost time in
proportion to their length: variant hashes come from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, saved

MIN_CHARS = 20
#: Two prime moduli and a base of the variants' polynomial hash; products of two residues fit 64 bits.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def line_keys(line: Column) -> list[Column]:
    """Two hashes of a line by different seeds (columns line_key and line_key2)."""
    return [F.xxhash64(line).alias("line_key"), F.xxhash64(F.lit(2), line).alias("line_key2")]


def places(docs: DataFrame, min_chars: int, equal_too: bool) -> DataFrame:
    """(doc_id, tkey, no, line) of every line that may be dropped: not blank, and of min_chars characters without `equal_too`."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    may = F.col("line").rlike(r"\S")
    return lines.where(may if equal_too else may & (F.length("line") >= min_chars))


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(line_key, line_key2, first place, number of places, halves): no text, so that little is shuffled and written."""
    rows = places(docs, min_chars, True).select(*line_keys(F.col("line")), F.struct("doc_id", "tkey", "no").alias("place"), *halves(F.col("line")))
    names = [c for c in rows.columns if c not in ("line_key", "line_key2", "place")]
    return rows.groupBy("line_key", "line_key2").agg(F.min("place").alias("first"), F.count("*").alias("n"), *(F.min(c).alias(c) for c in names))


def halves(line: Column) -> list[Column]:
    """Hashes of the first and the last half (columns first_a, last_a, and _b for a line one character shorter), and the length.

    The side and the length of a half are part of its hash.
    """
    n = F.length(line)
    out = [n.alias("chars")]
    for name, h in (("a", (n / 2).cast("int")), ("b", ((n - 1) / 2).cast("int"))):
        out.append(F.xxhash64(F.lit(0), h, F.substring(line, F.lit(1), h)).alias(f"first_{name}"))
        out.append(F.xxhash64(F.lit(1), h, F.substring(line, n - h + 1, h)).alias(f"last_{name}"))
    return out


def half_keys() -> Column:
    """The distinct halves of a line as structs (half, size, side: 0 where the first half is shared, 1 for the last)."""
    n = F.col("chars")
    keys = []
    for name, h in (("a", (n / 2).cast("int")), ("b", ((n - 1) / 2).cast("int"))):
        keys += [F.struct(F.col(f"{side}_{name}").alias("half"), h.alias("size"), F.lit(k).alias("side")) for k, side in enumerate(("first", "last"))]
    return F.array_distinct(F.array(*keys))


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Powers of the base and of its inverse by modulus, for at least n places."""
    for p in PRIMES:
        if p not in _tables or len(_tables[p][0]) < n:
            size, inverse = max(1024, 2 * n), pow(BASE, -1, p)
            up, down = np.ones(size, np.int64), np.ones(size, np.int64)
            done = 1
            while done < size:  # doubling: powers of the next block are the first block's times one power
                k = min(done, size - done)
                up[done : done + k] = up[:k] * pow(BASE, done, p) % p
                down[done : done + k] = down[:k] * pow(inverse, done, p) % p
                done += k
            _tables[p] = up, down
    return _tables


def variants(text: str) -> np.ndarray:
    """64-bit hashes of the text with each one of its characters deleted, and last of the text itself."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
    n, out = len(codes), np.zeros(len(codes) + 1, np.int64)
    for k, p in enumerate(PRIMES):
        up, down = _power_tables(n + 1)[p]
        term = codes * up[:n] % p
        before = np.concatenate([[0], np.cumsum(term) % p])
        total = before[-1]
        # characters behind a deleted one move one place to the front
        behind = (total - before[1:]) % p * down[1] % p
        h = np.append((before[:-1] + behind) % p, total)
        out ^= h << (31 * k)
    return out


def neighbourhood(lines: DataFrame) -> DataFrame:
    """Rows (half, variant, at, first) for lines (first, line, halves); at is -1 for a whole rest."""
    keep = lines.schema["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["half", "variant", "at", "first"]
        for b in batches:
            rows, n_rows = [], 0
            for i, (line, keys) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for key in keys:
                    h = key["size"]
                    rest = line[h:] if key["side"] == 0 else line[: len(line) - h]
                    v = variants(rest)
                    at = np.append(np.arange(len(v) - 1), -1)
                    rows.append((i, key["half"], v, at))
                    n_rows += len(v)
                if n_rows > 200_000:
                    yield built(b, rows, names)
                    rows, n_rows = [], 0
            if rows:
                yield built(b, rows, names)

    def built(b: pa.RecordBatch, rows: list, names: list[str]) -> pa.RecordBatch:
        sizes = [len(r[2]) for r in rows]
        take = pa.array(np.repeat([r[0] for r in rows], sizes))
        half = np.repeat(np.array([r[1] for r in rows], np.int64), sizes)
        v, at = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(half), pa.array(v), pa.array(at), b.column(0).take(take)], names=names)

    schema = T.StructType([
        T.StructField("half", T.LongType()), T.StructField("variant", T.LongType()), T.StructField("at", T.IntegerType()), keep,
    ])
    return lines.select("first", "line", "halves").mapInArrow(run, schema)


def near_lines(docs: DataFrame, lines: DataFrame, min_chars: int) -> DataFrame:
    """`first` of every distinct line that has an earlier line within one edit."""
    keyed = lines.select("line_key", F.explode(half_keys()).alias("h"))
    shared = keyed.groupBy("h.half").agg(F.min("line_key").alias("a"), F.max("line_key").alias("z")).where("a < z").select("half")
    chosen = keyed.select("line_key", "h", F.col("h.half").alias("half")).join(shared, "half", "left_semi")
    chosen = chosen.groupBy("line_key").agg(F.collect_set("h").alias("halves"))  # four halves of a line at most
    # two lines of one line_key would each get the halves of both, which makes links that the check throws out
    chosen = lines.select("line_key", "first").join(chosen, "line_key")
    # the text of a chosen line is read at its first place, which only one line has: a hot line is no hot key here
    at = places(docs, min_chars, False)
    same = at.doc_id.eqNullSafe(F.col("first.doc_id")) & (at.tkey == F.col("first.tkey")) & (at.no == F.col("first.no"))
    chosen = saved(at.join(chosen, same).select("first", "line", "halves").dropDuplicates(["first"]), "halves")
    near = saved(neighbourhood(chosen), "variants")
    # substitutions: the earliest line of each (variant, place) stands for all
    deleted = near.where("at >= 0")
    heads = deleted.groupBy("half", "variant", "at").agg(F.min("first").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    swapped = deleted.join(heads, ["half", "variant", "at"]).where("head < first").select("first", "head")
    # insertions and deletions: a variant is the whole rest of another line
    whole = near.where("at = -1").select("half", "variant", F.col("first").alias("head"))
    pairs = deleted.select("half", "variant", "first").join(whole, ["half", "variant"])
    added = pairs.select(F.greatest("head", "first").alias("first"), F.least("head", "first").alias("head"))
    links = swapped.unionByName(added).distinct()
    text = chosen.select("first", "line")
    checked = links.join(text, "first").join(text.select(F.col("first").alias("head"), F.col("line").alias("head_line")), "head")
    return checked.where(F.levenshtein("line", "head_line", 1).between(0, 1)).select("first").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, tkey, gone): line numbers that go, for documents that lose any."""
    lines = saved(distinct_lines(docs, min_chars), "lines")
    near = saved(near_lines(docs, lines.where(F.col("chars") >= min_chars), min_chars), "near")
    verdict = lines.join(near.withColumn("near", F.lit(True)), "first", "left").where("near OR n > 1")
    verdict = verdict.select("line_key", "line_key2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    at = places(docs, min_chars, True).select("doc_id", "tkey", "no", *line_keys(F.col("line"))).join(verdict, ["line_key", "line_key2"])
    gone = at.where(F.col("near") | (F.col("first") < F.struct("doc_id", "tkey", "no")))
    return gone.groupBy("doc_id", "tkey").agg(F.collect_set("no").alias("gone"))


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """docs with near-repeated lines cut out of the text, and columns n_lines and n_dropped. See the module."""
    total, lost = fresh(docs, "n_lines", "n_dropped")
    keyed = docs.withColumn("_tkey", text_key(F.col(text)))
    plain = docs.select("doc_id", F.col(text).alias("text"))
    gone = dropped_lines(plain, min_chars).select(F.col("doc_id").alias("_doc"), F.col("tkey").alias("_key"), F.col("gone").alias("_gone"))
    out = keyed.join(gone, keyed.doc_id.eqNullSafe(gone._doc) & (keyed._tkey == gone._key), "left")
    out = out.withColumn("_lines", F.split(text, "\n"))  # a column of its own: the lambda must not split again
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")
    return out.select(
        *(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).alias(total),
        F.coalesce(F.size("_gone"), F.lit(0)).alias(lost),
    )
