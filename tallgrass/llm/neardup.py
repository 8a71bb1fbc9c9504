"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

1. Texts are dealt to groups by hash. Document frequencies of five-word shingles are counted for every shingle at every
   size: documents send their shingles to ranges of the hash, each of which counts its own, and those of two documents
   or more come back to the groups of texts that have them. A shingle is known there by 40 bits of its hash besides its
   range (a million or so of shingles), so that one in a million is taken for another. A shingle's weight is its count
   times a damped idf, 1 + IDF_SHARE * idf / (largest idf): with a full idf a large group of near copies would be torn
   apart, since its common shingles would weigh little against edits.
2. One pass over the groups gives every text BANDS band keys of ROWS consistent weighted samples, and keeps the document
   frequencies of its shingles beside it. Equal texts are one node.
3. Within a bucket (equal band key) rounds of heads meet all members that are not in their component yet, one head at
   first and GROWTH times as many in each round, until all of a bucket is one component or every member was a head. So
   no link between two components is missed within a bucket, and a bucket of one component takes one round.
4. Texts that meet become a candidate pair only if their similarity may reach the bound: every text has a bit set of its
   shingles, and a bit that only one text has stands for a shingle of weight 1 or more that the other lacks. This upper
   bound of the similarity is exact (it loses no link) and is the join's condition, so that a bucket of many texts that
   are not similar gives comparisons of a few numbers, but hardly any pairs. Large buckets are dealt to salts.
5. Each candidate pair's weighted Jaccard similarity is computed on whole texts; 0.8 or more is a link. What was found
   is brought into the components before the next round.
6. Classes are the connected components of the links; class_id is the least doc_id of a class.

Text moves for candidates only. Nothing that grows with the documents is collected or broadcast. Banding is probabilistic: a pair at exactly 0.8 is missed with a probability of about 0.005.

Defined cases: a null text counts as empty; texts without words are one class; a text of fewer than five words is one
shingle; a null doc_id is allowed and sorts last in its class; equal rows share a class and one of them is kept; an
empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import stars
from .shingles import Sampler, mixed, shingles, weighted_jaccard

WIDTH, SIMILARITY, BANDS, ROWS, IDF_SHARE = 5, 0.8, 10, 4, 0.1
#: Documents, and shingles, whose shingles are sent together at most; characters of texts per group and per range of hashes;
#: bits of a hash within its range.
CHUNK_DOCS, CHUNK_SHINGLES, PER_GROUP, PER_RANGE, RANGE_BITS = 8192, 1 << 19, 1 << 22, 1 << 23, 40
#: How many times as many heads of a bucket a round has than the round before; members of a bucket that share a salt.
GROWTH, PER_SALT = 16, 1024
#: Bits of a shingle set: a power of two, BITS at least and BITS_PER shingle at least.
BITS, BITS_PER = 1024, 4


def with_key(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("node"), text.alias("text"))


class Frequencies(NamedTuple):
    """Sorted hashes of shingles of two documents or more, their documents, and the number of all documents.

    Hashes that were cut have lost their last `lost` bits.
    """

    keys: np.ndarray
    documents: np.ndarray
    total: int
    lost: int = 0


class Idf(NamedTuple):
    """Weights of such shingles by their sorted hashes, and the weight of all others."""

    keys: np.ndarray
    weights: np.ndarray
    rest: float


class Size(NamedTuple):
    """Documents, groups of texts, and bits of a hash that name its range."""

    total: int
    groups: int
    bits: int

    @property
    def lost(self) -> int:
        return 64 - RANGE_BITS - self.bits


def size_of(docs: DataFrame) -> Size:
    n = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    return Size(n.n, 1 + n.chars // PER_GROUP, min(64 - RANGE_BITS, (n.chars // PER_RANGE).bit_length()))


def grouped(docs: DataFrame, size: Size) -> DataFrame:
    """doc_id, node, text and the group of the text."""
    return with_key(docs).withColumn("part", F.pmod(F.xxhash64("node"), F.lit(size.groups)).cast("int"))


def packed(kind, *arrays: np.ndarray) -> list[pa.Array]:
    """Arrays as one binary value for each run of equal values of the first, after that value (of an Arrow type)."""
    at = np.flatnonzero(np.diff(arrays[0])) + 1
    runs = lambda x: [v.tobytes() for v in np.split(x, at)] if len(x) else []
    first = arrays[0][np.concatenate([[0], at])] if len(arrays[0]) else arrays[0]
    return [pa.array(first.tolist(), kind), *(pa.array(runs(x), pa.binary()) for x in arrays[1:])]


def unpacked(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def shared_shingles(texts: DataFrame, size: Size) -> DataFrame:
    """(part, keys, documents): shingles of two documents or more, for every group that has them, in packed rows.

    Each range of hashes is counted as one group of rows, of a bounded size: PER_RANGE characters make a million shingles.
    """

    def sent(keys: list[np.ndarray], parts: list[int]) -> pa.RecordBatch:
        key, part = np.concatenate(keys) >> np.uint64(size.lost), np.repeat(np.array(parts, np.int32), [len(k) for k in keys])
        span = (key >> np.uint64(RANGE_BITS)).astype(np.int64)
        order = np.lexsort((part, span))
        low = key[order].view(np.uint8).reshape(-1, 8)[:, : RANGE_BITS // 8]
        return pa.RecordBatch.from_arrays(packed(pa.int64(), span[order], part[order], low), names=["span", "parts", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, held = [], [], 0
        for b in batches:
            for part, text in zip(b.column(0), b.column(1), strict=True):
                s = shingles(text.as_py(), WIDTH)[0]
                if len(s):
                    keys.append(s)
                    parts.append(part.as_py())
                    held += len(s)
                if len(keys) == CHUNK_DOCS or held > CHUNK_SHINGLES:
                    yield sent(keys, parts)
                    keys, parts, held = [], [], 0
        if keys:
            yield sent(keys, parts)

    def counted(table: pa.Table) -> pa.Table:
        part, low = unpacked(table["parts"], np.int32), unpacked(table["keys"], np.uint8).reshape(-1, RANGE_BITS // 8)
        key = np.zeros((len(low), 8), np.uint8)
        key[:, : RANGE_BITS // 8] = low
        key = key.view(np.uint64).ravel()
        order = np.argsort(key)
        key, part = key[order], part[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.append(first, len(key)))
        documents, several = np.repeat(runs, runs), np.repeat(runs > 1, runs)
        part, key, documents = part[several], key[several], documents[several]
        order = np.lexsort((key, part))
        part, key, documents = part[order], key[order], documents[order]
        once = np.ones(len(key), bool)
        once[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        key = key + (np.uint64(table["span"][0].as_py()) << np.uint64(RANGE_BITS))
        out = packed(pa.int32(), part[once], key[once], np.minimum(documents[once], 2**32 - 1).astype(np.uint32))
        return pa.Table.from_arrays(out, names=["part", "keys", "documents"])

    rows = texts.select("part", "text").mapInArrow(run, "span long, parts binary, keys binary")
    return rows.groupBy("span").applyInArrow(counted, "part int, keys binary, documents binary")


def frequencies_of(table: pa.Table, size: Size) -> Frequencies:
    """Frequencies of packed rows, each key once."""
    keys, at = np.unique(unpacked(table["keys"], np.uint64), return_index=True)
    return Frequencies(keys, unpacked(table["documents"], np.uint32)[at].astype(np.int64), size.total, size.lost)


def document_frequencies(docs: DataFrame) -> Frequencies:
    """The frequencies as one table by whole hashes, for small tables (those of classes() stay dealt to groups)."""
    size = size_of(docs)
    size = size._replace(bits=64 - RANGE_BITS)
    return frequencies_of(shared_shingles(grouped(docs, size), size).toArrow(), size)


def documents_of(s: np.ndarray, f: Frequencies) -> np.ndarray:
    """The documents of shingles; those that are not known are in one."""
    out = np.ones(len(s), np.int64)
    if len(f.keys):
        s = s >> np.uint64(f.lost)
        at = np.minimum(np.searchsorted(f.keys, s), len(f.keys) - 1)
        known = f.keys[at] == s
        out[known] = f.documents[at[known]]
    return out


def weight_of(documents: np.ndarray | int, total: int) -> np.ndarray:
    """The damped idf of shingles in so many documents."""
    return 1 + IDF_SHARE * np.log((1 + max(total, 1)) / (1 + documents)) / max(np.log(1 + total), 1e-9)


def weights_of(f: Frequencies) -> Idf:
    """The damped idf of shingles of several documents and of those of one."""
    return Idf(f.keys, weight_of(f.documents, f.total), float(weight_of(1, f.total)))


def weighted(text: str, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    s, n = shingles(text, WIDTH)
    weights = np.full(len(s), idf.rest)
    if len(idf.keys):
        at = np.minimum(np.searchsorted(idf.keys, s), len(idf.keys) - 1)
        known = idf.keys[at] == s
        weights[known] = idf.weights[at[known]]
    return s, n * weights


def bit_set(s: np.ndarray) -> np.ndarray:
    """The shingles' places modulo a power of two, as 64-bit words."""
    size = max(BITS, 1 << int(BITS_PER * len(s) - 1).bit_length())
    out = np.zeros(size // 64, np.uint64)
    at = mixed(s) % np.uint64(size)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out.view(np.int64)


def may_reach(similarity: float) -> Column:
    """Whether node and other (columns total, bits, ones and other_total, ...) can be similar: false only if they are not."""
    count = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.bit_count(x))

    def bound(bits: Column, ones: Column, other_bits: Column, other_ones: Column) -> Column:
        common = count(F.zip_with(bits, other_bits, lambda x, y: x.bitwiseAND(y)))
        # the weight that both can have: each bit of only one text stands for a weight of 1 at least
        most = F.least(F.col("total") - ones + common, F.col("other_total") - other_ones + common)
        return most * (1 + similarity) >= similarity * (F.col("total") + F.col("other_total")) - 1e-6

    def folded(bits: Column) -> Column:
        half = (F.size(bits) / 2).cast("int")
        return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda x, y: x.bitwiseOR(y))

    mine, others = F.col("bits"), F.col("other_bits")
    near = F.least("total", "other_total") >= similarity * F.greatest("total", "other_total") - 1e-6
    return near & (
        F.when(F.size(mine) == F.size(others), bound(mine, F.col("ones"), others, F.col("other_ones")))
        .when(F.size(mine) == 2 * F.size(others), bound(folded(mine), count(folded(mine)), others, F.col("other_ones")))
        .when(2 * F.size(mine) == F.size(others), bound(mine, F.col("ones"), folded(others), count(folded(others))))
        .otherwise(F.lit(True))
    )


def signed(weights: tuple[np.ndarray, np.ndarray], sampler: Sampler, tags: np.ndarray) -> tuple:
    """Band keys, weight and bit set of a text's weighted shingles; nulls for a text without words."""
    s, w = weights
    if not len(s):
        return None, None, None
    drawn = sampler.samples(s, w).reshape(len(tags), -1)
    key = tags.copy()
    for k in range(drawn.shape[1]):
        key = mixed(key * np.uint64(31) + drawn[:, k])
    return key.view(np.int64), float(w.sum()), bit_set(s)


def drawing(bands: int, rows: int) -> tuple[Sampler, np.ndarray]:
    return Sampler(bands * rows), mixed(np.arange(1, bands + 1, dtype=np.uint64))


def signed_columns(rows: list[tuple]) -> list[pa.Array]:
    longs = pa.list_(pa.int64())
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((longs, pa.float64(), longs))]


def signatures(keyed: DataFrame, idf, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, node, keys, total, bits) of every row, by frequencies that are known."""
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws = drawing(bands, rows)
        for b in batches:
            out = [signed(weighted(x.as_py(), idf.value), *draws) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *signed_columns(out)], names=["doc_id", "node", "keys", "total", "bits"])

    return keyed.mapInArrow(run, f"doc_id {kind}, node binary, keys array<long>, total double, bits array<long>")


def signed_nodes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, int]:
    """(node, rep, n, keys, total, bits, known) of every distinct text, and the number of documents.

    known: the documents of each of its shingles, in the order of their hashes (32-bit integers).
    """
    size = size_of(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["part", "node", "rep", "n", "text"]

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies within a batch become one row."""
        for b in batches:
            t = pa.table({"node": b.column(0), "rep": b.column(1), "at": np.arange(b.num_rows)})
            t = t.group_by("node").aggregate([("rep", "min"), ("at", "min"), ("at", "count")])
            own = b.take(t["at_min"].combine_chunks())
            yield pa.RecordBatch.from_arrays([own.column(2), own.column(0), t["rep_min"].combine_chunks(), t["at_count"].combine_chunks(), own.column(3)], names=names)

    def run(own: pa.Table, shared: pa.Table) -> pa.Table:
        f, draws, said = frequencies_of(shared, size), drawing(bands, rows), []
        own = own.sort_by("node")
        t = own.append_column("at", pa.array(np.arange(own.num_rows))).group_by("node").aggregate([("rep", "min"), ("n", "sum"), ("at", "min")])
        for x in own["text"].take(t["at_min"].combine_chunks()):
            s, n = shingles(x.as_py(), WIDTH)
            documents = documents_of(s, f)
            said.append((*signed((s, n * weight_of(documents, size.total)), *draws), documents.astype(np.uint32).tobytes()))
        columns = [t["node"], t["rep_min"], t["n_sum"], *signed_columns(said), pa.array([r[3] for r in said], pa.binary())]
        return pa.Table.from_arrays(columns, names=["node", "rep", "n", "keys", "total", "bits", "known"])

    texts = grouped(docs, size)
    own = texts.select("node", "doc_id", "part", "text").mapInArrow(once, f"part int, node binary, rep {kind}, n long, text string")
    d = own.groupBy("part").cogroup(shared_shingles(texts, size).groupBy("part")).applyInArrow(
        run, f"node binary, rep {kind}, n long, keys array<long>, total double, bits array<long>, known binary"
    )
    return d, size.total


def headed(active: DataFrame, width: int) -> DataFrame:
    """Entries (bucket, node, comp, salts, ...) of buckets with more than one component, and whether they are heads: about width of a bucket."""
    order = F.xxhash64("node", F.lit(width))
    mixed_ones = active.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.struct(order, "node")).alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    d = active.join(mixed_ones.where("lo < hi").select("bucket", "n", "first"), "bucket")
    salts = (F.floor(F.col("n") / PER_SALT) + 1).cast("int")
    return d.select(*active.columns, salts.alias("salts"), ((F.col("node") == F.col("first")) | (F.pmod(order, F.col("n")) < width)).alias("is_head"))


def met(entries: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (head, node, head_comp, comp) of heads and other members of their bucket, in different components, that may be similar."""
    heads = entries.where("is_head").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *(F.col(c).alias(f"other_{c}") for c in ("comp", "total", "bits", "ones")), F.col("node").alias("other")
    )
    members = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    # two heads meet twice: once is enough
    fresh_pair = (F.col("comp") != F.col("other_comp")) & (~F.col("is_head") | (F.col("node") < F.col("other")))
    both = members.join(heads, ["bucket", "salt"]).where(fresh_pair & may_reach(similarity))
    low = F.col("node") < F.col("other")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return both.select(
        pick("node", "other").alias("head"), pick("other", "node").alias("node"), pick("comp", "other_comp").alias("head_comp"), pick("other_comp", "comp").alias("comp")
    ).distinct()


def verified(pairs: DataFrame, texts: DataFrame, total: int, similarity: float) -> DataFrame:
    """(head, node, similar) of distinct pairs (head, node); equal rows bring a text more than once."""

    def weighing(text: str, known: bytes) -> tuple[np.ndarray, np.ndarray]:
        s, n = shingles(text, WIDTH)
        return s, n * weight_of(np.frombuffer(known, np.uint32).astype(np.int64), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head = None, None
        for b in batches:
            said = []
            for h, x, x_known, y, y_known in zip(b.column(0), *b.columns[2:], strict=True):
                if h.as_py() != last:
                    last, head = h.as_py(), weighing(x.as_py(), x_known.as_py())
                said.append(weighted_jaccard(head, weighing(y.as_py(), y_known.as_py())) >= similarity)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.bool_())], names=["head", "node", "similar"])

    of = lambda side: texts.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text"), F.col("known").alias(f"{side}_known"))
    both = pairs.join(of("node"), "node").join(of("head"), "head")
    return both.select("head", "node", "head_text", "head_known", "node_text", "node_known").mapInArrow(run, "head binary, node binary, similar boolean").distinct()


def links(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes, and the nodes (node, rep: least doc_id, n: rows)."""
    keyed = with_key(docs)
    nodes, total = signed_nodes(docs, bands, rows)
    nodes = saved(nodes, "nodes")
    active = nodes.where("keys IS NOT NULL").select("node", F.explode("keys").alias("bucket"))
    shared = active.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    ones = F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))
    sets = nodes.select("node", "total", "bits", ones.alias("ones"))
    active = active.join(shared, "bucket", "left_semi").join(sets, "node")
    active = saved(active.select("bucket", "node", F.col("node").alias("comp"), "total", "bits", "ones"), "entries")
    reps = nodes.select("node", "rep", "known").join(active.select("node").distinct(), "node", "left_semi")
    texts = keyed.join(reps, (keyed.node == reps.node) & keyed.doc_id.eqNullSafe(reps.rep)).select(reps.node, "text", "known")
    texts = saved(texts, "texts")
    checked, width = None, 1
    while True:
        entries = saved(headed(active, width), "headed")
        if checked is not None and entries.isEmpty():
            break
        pairs = met(entries, similarity)
        if checked is not None:  # pairs that met in another bucket
            pairs = pairs.join(checked.select("head", "node"), ["head", "node"], "left_anti")
        pairs = saved(pairs, "pairs")
        now = saved(verified(pairs.select("head", "node"), texts, total, similarity), "checked")
        checked = now if checked is None else checked.unionByName(now)
        # a head has met all of its bucket; the others go on in the components that the links make
        active = entries.where("NOT is_head").drop("salts", "is_head")
        joined = pairs.join(now.where("similar").select("head", "node"), ["head", "node"], "left_semi")
        roots = stars(joined.select(F.col("head_comp").alias("a"), F.col("comp").alias("b"))).select(F.col("node").alias("comp"), "root")
        active = active.join(roots, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        width *= GROWTH
    found = saved(checked.where("similar").select(F.col("head").alias("a"), F.col("node").alias("b")), "links")
    return found, nodes.select("node", "rep", "n")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, rep, class_id, class_texts, class_links): every distinct text with the least doc_id of its class, the
    class's texts and the verified links between them."""
    found, nodes = links(docs, similarity, bands, rows)
    roots = saved(stars(found), "roots")
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = nodes.groupBy("root").agg(F.min("rep").alias("class_id"), F.count("*").alias("class_texts"))
    least = F.least("a", "b")
    linked = found.select(least.alias("node")).join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"))
    by = by.join(linked.groupBy("root").agg(F.count("*").alias("class_links")), "root", "left")
    return nodes.join(by, "root").select("node", "rep", "class_id", "class_texts", F.coalesce("class_links", F.lit(0)).alias("class_links"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_texts (distinct texts in the class), class_links (verified links
    between them; candidates that met no more, once in one class, are not counted), kept (the class's first)."""
    member = saved(classes(docs, similarity), "classes")
    rows = with_key(docs).select("doc_id", "node").join(member, "node")
    return rows.select("doc_id", "class_id", "class_texts", "class_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without all but one document of each class; all columns stay."""
    keep = saved(classes(docs, similarity).where("rep <=> class_id").select("node", "rep"), "keep")
    keep = keep.withColumnsRenamed({"node": "_node", "rep": "_rep"})
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = (F.col("_key") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_rep"))
    return keyed.join(keep, same, "left_semi").dropDuplicates(["_key", "doc_id"]).drop("_key")
