"""Identifiability of ambiguous sets and alternative choices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.core import guarded


def observational_groups(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths that lie in exactly the same patterns share a group, numbered by the group's first path (F1).

    patterns: gene_id, paths_key, paths ARRAY; paths: gene_id, path_id. Paths in no pattern form one group.
    """
    inside = patterns.select("gene_id", "paths_key", F.explode("paths").alias("path_id"))
    sig = inside.groupBy("gene_id", "path_id").agg(F.array_join(F.array_sort(F.collect_set("paths_key")), "|").alias("sig"))
    d = paths.select("gene_id", "path_id").join(sig, ["gene_id", "path_id"], "left").fillna({"sig": ""})
    first = F.min("path_id").over(Window.partitionBy("gene_id", "sig"))
    d = d.withColumn("first", first)
    number = F.dense_rank().over(Window.partitionBy("gene_id").orderBy("first")) - 1
    return d.select("gene_id", "path_id", F.concat("gene_id", F.lit(":"), F.lpad(number.cast("string"), 4, "0")).alias("group_id"))


def exclusive_support(patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """Mass of the patterns that lie within one group (F2); 0 for groups without any."""
    one = patterns.select("gene_id", "paths_key", "mass", F.explode("paths").alias("path_id")).join(groups, ["gene_id", "path_id"])
    whole = one.groupBy("gene_id", "paths_key", "mass").agg(F.count_distinct("group_id").alias("k"), F.min("group_id").alias("group_id")).where("k = 1")
    by = whole.groupBy("gene_id", "group_id").agg(F.sum("mass").alias("exclusive_mass"))
    return groups.groupBy("gene_id", "group_id").agg(F.count("*").alias("n_paths")).join(by, ["gene_id", "group_id"], "left").fillna({"exclusive_mass": 0})


def augmented_rank(patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """Rank over the groups of the pattern rows and a row of ones, per gene (F3); separable if it equals the groups.

    One small dense decomposition per gene, in as many tasks as there are partitions of genes.
    """
    rows = patterns.select("gene_id", "paths_key", F.explode("paths").alias("path_id")).join(groups, ["gene_id", "path_id"]).select("gene_id", "paths_key", "group_id").distinct()
    per = rows.groupBy("gene_id", "paths_key").agg(F.array_sort(F.collect_set("group_id")).alias("g"))
    every = groups.groupBy("gene_id").agg(F.array_sort(F.collect_set("group_id")).alias("axis")).join(per.groupBy("gene_id").agg(F.collect_list("g").alias("rows")), "gene_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for gene, axis, rows in zip(b["gene_id"], b["axis"], b["rows"], strict=True):
                place = {g: i for i, g in enumerate(axis)}
                m = np.zeros((1 + (0 if rows is None else len(rows)), len(axis)))
                m[0] = 1
                for k, r in enumerate([] if rows is None else rows, 1):
                    m[k, [place[g] for g in r]] = 1
                s = np.linalg.svd(m, compute_uv=False)
                out.append((gene, int((s > s[0] * max(m.shape) * np.finfo(float).eps * 8).sum()), len(axis)))
            yield pd.DataFrame(out, columns=["gene_id", "rank", "groups"])

    kind = every.schema["gene_id"].dataType.simpleString()
    return every.mapInPandas(run, f"gene_id {kind}, rank long, groups long").withColumn("separable", F.col("rank") == F.col("groups"))


def identifiability_index(patterns: DataFrame, paths: DataFrame, least: float = 1.0) -> DataFrame:
    """Per gene: paths, groups, patterns, rank, separability, groups with enough exclusive mass, and a tier."""
    groups = observational_groups(patterns, paths)
    own = exclusive_support(patterns, groups).groupBy("gene_id").agg(F.sum("n_paths").alias("paths"), F.count_if(F.col("exclusive_mass") >= least).alias("supported_groups"))
    n = patterns.groupBy("gene_id").agg(F.count("*").alias("patterns"))
    d = augmented_rank(patterns, groups).join(own, "gene_id").join(n, "gene_id", "left").fillna({"patterns": 0})
    tier = F.when(~F.col("separable"), "unidentifiable").when(F.col("supported_groups") == F.col("groups"), "supported").otherwise("separable")
    return d.withColumn("tier", tier)


def classify_heldout(ec: DataFrame, groups: DataFrame) -> DataFrame:
    """Held-out rows by what training groups can say (F5): whether a group lies partly in the row's set, or all are whole.

    ec: cell_id, gene_id, paths_key, paths, n_legal, split; training rows are an error.
    """
    held = ec.withColumn("error", F.when(F.col("split") == "train", F.raise_error(F.lit("training rows among the held-out ones"))))
    sizes = groups.groupBy("gene_id", "group_id").agg(F.count("*").alias("whole"))
    one = held.select("cell_id", "gene_id", "paths_key", "n_legal", F.size("paths").alias("k"), F.explode("paths").alias("path_id"), "error").where("error IS NULL")
    part = one.join(groups, ["gene_id", "path_id"]).groupBy("cell_id", "gene_id", "paths_key", "n_legal", "k", "group_id").agg(F.count("*").alias("own")).join(sizes, ["gene_id", "group_id"])
    d = part.groupBy("cell_id", "gene_id", "paths_key", "n_legal", "k").agg(F.count("*").alias("touched_groups"), F.count_if(F.col("own") < F.col("whole")).alias("split_groups"))
    kind = F.when(F.col("k") == F.col("n_legal"), "uninformative").when(F.col("split_groups") > 0, "novel_split").when(F.col("touched_groups") == 1, "group_constant").otherwise("informative")
    return d.select("cell_id", "gene_id", "paths_key", "touched_groups", "split_groups", kind.alias("kind"))


def matrix_ranks(rows: DataFrame) -> DataFrame:
    """(columns, rows, rank) of distinct 0/1 matrices with a row of ones; rows: columns, rows ARRAY of sorted ARRAYs of places.

    Equal matrices come once, however many cells have them; they are eliminated a batch at a time, exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = []
            for n, lists in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                m = np.zeros((1 + len(lists), n), np.int64)
                m[0] = 1
                for k, places in enumerate(lists, 1):
                    m[k, places] = 1
                every.append(m)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(exact.ranks(every), pa.int64())], names=["columns", "rows", "rank"])

    plain = rows.select(F.col("columns").cast("int").alias("columns"), F.col("rows").cast("array<array<int>>").alias("rows"))
    return plain.distinct().mapInArrow(run, "columns int, rows array<array<int>>, rank long")


def cell_support(ec: DataFrame, groups: DataFrame, index: DataFrame, least: float = 1.0) -> DataFrame:
    """What each held-out cell says about each gene's groups (F5): rank, direct support and one of three tiers.

    ec: split, cell_id, gene_id, paths, n_legal, mass; index: gene_id, separable, groups (of training, which stay as
    they are). A row counts if it has mass, is informative and splits no group. The rank is that of the distinct sets of
    whole groups in the cell's rows and a row of ones. `direct` needs a separable gene, full rank, and `least` mass in
    every group from rows that lie within it. Training rows, unknown genes and masses below 0 are errors.
    """
    sizes = groups.groupBy("gene_id", "group_id").agg(F.count("*").alias("whole"))
    number = F.row_number().over(Window.partitionBy("gene_id").orderBy("group_id")) - 1
    sizes = sizes.withColumn("place", number)
    bad = F.when(F.col("split") == "train", "training rows among the held-out ones").when(~(F.col("mass") >= 0) | F.col("mass").isNull() | ~(F.col("mass") < float("inf")), "masses must be finite and 0 or more").when(F.col("known").isNull(), "genes without a training index")
    d = ec.join(index.select("gene_id", "separable", "groups", F.lit(True).alias("known")), "gene_id", "left")
    d = d.where(guarded(bad))
    key = ["split", "cell_id", "gene_id"]
    cells = d.groupBy(*key).agg(F.first("separable").alias("separable"), F.first("groups").alias("groups"))
    inside = d.where((F.col("mass") > 0) & (F.size("paths") > 0) & (F.size("paths") < F.col("n_legal")))
    inside = inside.withColumn("row", F.array_sort("paths")).groupBy(*key, "row").agg(F.sum("mass").alias("mass"))
    part = inside.withColumn("path_id", F.explode(F.array_distinct("row"))).join(groups, ["gene_id", "path_id"])
    part = part.groupBy(*key, "row", "mass", "group_id").agg(F.count("*").alias("own")).join(sizes, ["gene_id", "group_id"])
    row = part.groupBy(*key, "row", "mass").agg(F.bool_or(F.col("own") < F.col("whole")).alias("splits"), F.array_sort(F.collect_list("place")).alias("places"))
    novel = row.groupBy(*key).agg(F.bool_or("splits").alias("novel_split"))
    valid = row.where("NOT splits")
    rows = valid.groupBy(*key).agg(F.array_sort(F.collect_set("places")).alias("rows"), F.sum("mass").alias("valid_mass"))
    own = valid.where(F.size("places") == 1).groupBy(*key, F.element_at("places", 1).alias("place")).agg(F.sum("mass").alias("mass"))
    own = own.groupBy(*key).agg(F.count_if(F.col("mass") >= least).alias("supported_groups"), F.sum("mass").alias("exclusive_mass"))
    every = cells.join(rows, key, "left").join(own, key, "left").join(novel, key, "left")
    none = F.array().cast("array<array<int>>")
    every = every.withColumns({"rows": F.coalesce(F.col("rows").cast("array<array<int>>"), none), "columns": F.col("groups").cast("int")})
    every = every.join(matrix_ranks(every), ["columns", "rows"]).fillna({"supported_groups": 0, "exclusive_mass": 0.0, "valid_mass": 0.0, "novel_split": False})
    direct = F.col("separable") & (F.col("rank") == F.col("groups")) & (F.col("supported_groups") == F.col("groups"))
    tier = F.when(direct, "direct").when(F.col("separable"), "cohort").otherwise("unidentifiable")
    return every.select(*key, "groups", F.size("rows").alias("patterns"), "rank", "supported_groups", "exclusive_mass", "valid_mass", "novel_split", tier.alias("tier"))


def endpoint_choices(paths: DataFrame, end: str) -> DataFrame:
    """Alternatives of genes with two or more different ends, with their paths."""
    w = Window.partitionBy("gene_id")
    alt = paths.groupBy("gene_id", end).agg(F.array_join(F.array_sort(F.collect_set("path_id")), ",").alias("paths"), F.count_distinct("path_id").alias("n_paths"))
    return alt.withColumn("alternatives", F.count("*").over(w)).where("alternatives >= 2")


def shared_context(paths: DataFrame, first_differs: bool = True) -> DataFrame:
    """The longest run of edges at the other end that a path shares with a path of another alternative.

    paths: gene_id, path_id, alternative, edges ARRAY. With first_differs the end that differs is the first, so that
    suffixes are compared, else prefixes. UNMATCHED is a length of 0. A run is the 128 bits of a hash chained along its
    edges, so that what is shuffled grows with the edges and not with the square of a path's length. NULL edges are equal.
    """
    order = F.reverse("edges") if first_differs else F.col("edges")
    edge = lambda e: F.coalesce(e.cast("string"), F.lit("\0null"))
    chain = F.aggregate(
        order, F.struct(F.lit("").alias("last"), F.array().cast("array<binary>").alias("all")),
        lambda s, e: F.struct(F.md5(F.concat(s["last"], F.lit("|"), edge(e))).alias("last"), F.array_append(s["all"], F.unhex(F.md5(F.concat(s["last"], F.lit("|"), edge(e))))).alias("all")),
        lambda s: s["all"],
    )
    d = paths.select("gene_id", "path_id", "alternative", F.posexplode(chain).alias("at", "run")).withColumn("length", F.col("at") + 1)
    by = d.groupBy("gene_id", "length", "run").agg((F.min("alternative") < F.max("alternative")).alias("several"))
    shared = d.join(by.where("several"), ["gene_id", "length", "run"]).groupBy("gene_id", "path_id").agg(F.max("length").alias("shared"))
    out = paths.select("gene_id", "path_id", "alternative").join(shared, ["gene_id", "path_id"], "left").fillna({"shared": 0})
    return out.withColumn("status", F.when(F.col("shared") > 0, "matched").otherwise("UNMATCHED"))


def contrasts(alternatives: DataFrame) -> DataFrame:
    """Unordered pairs of a choice's alternatives (F9). alternatives: gene_id, choice_id, alternative_id, mass."""
    a = alternatives.select("gene_id", "choice_id", F.col("alternative_id").alias("a"), F.col("mass").alias("mass_a"))
    b = alternatives.select("gene_id", "choice_id", F.col("alternative_id").alias("b"), F.col("mass").alias("mass_b"))
    return a.join(b, ["gene_id", "choice_id"]).where("a < b").withColumn("reportable", (F.col("mass_a") > 0) & (F.col("mass_b") > 0))


def subset_contrasts(alternatives: DataFrame, memberships: DataFrame) -> DataFrame:
    """Contrasts of a choice's alternatives as pairs of path sets: marginal ones, and one per context that both have.

    alternatives: gene_id, choice_id, alternative_id, paths ARRAY; memberships: choice_id, alternative_id, path_id,
    context, eligible. Rows: gene_id, choice_id, context (NULL if marginal), a, b, paths_a, paths_b.
    """
    at = memberships.where("eligible AND context IS NOT NULL").groupBy("choice_id", "alternative_id", "context").agg(F.array_sort(F.collect_set("path_id")).alias("paths"))
    local = alternatives.select("gene_id", "choice_id", "alternative_id").join(at, ["choice_id", "alternative_id"])
    every = alternatives.select("gene_id", "choice_id", F.lit(None).cast("string").alias("context"), "alternative_id", F.array_sort("paths").alias("paths"))
    every = every.unionByName(local.select("gene_id", "choice_id", F.col("context").cast("string").alias("context"), "alternative_id", "paths"))
    side = lambda x: every.select("gene_id", "choice_id", F.col("context"), F.col("alternative_id").alias(x), F.col("paths").alias(f"paths_{x}"))
    left, right = side("a"), side("b").withColumnsRenamed({"gene_id": "g", "choice_id": "c", "context": "k"})
    same = (left.gene_id == right.g) & (left.choice_id == right.c) & left.context.eqNullSafe(right.k) & (left.a < right.b)
    return left.join(right, same).drop("g", "c", "k")


def subset_status(subsets: DataFrame, patterns: DataFrame, groups: DataFrame) -> DataFrame:
    """For path sets (gene_id, paths): whether they are whole groups, estimable, and their exclusive training mass.

    A set that holds part of a group is not `defined`. It is estimable if its indicator over the groups lies in the row
    space of the gene's patterns and a row of ones. The echelon form of a gene is made once for all of its sets; the
    test is exact. Exclusive mass is that of the patterns within the set.
    """
    subsets = subsets.select("gene_id", "paths").distinct()
    sizes = groups.groupBy("gene_id", "group_id").agg(F.count("*").alias("whole"))
    sizes = sizes.withColumns({"place": F.row_number().over(Window.partitionBy("gene_id").orderBy("group_id")) - 1, "columns": F.count("*").over(Window.partitionBy("gene_id"))})
    one = subsets.withColumn("path_id", F.explode("paths")).join(groups, ["gene_id", "path_id"])
    part = one.groupBy("gene_id", "paths", "group_id").agg(F.count("*").alias("own")).join(sizes, ["gene_id", "group_id"])
    crossing = F.array_sort(F.collect_list(F.when(F.col("own") < F.col("whole"), F.col("group_id"))))
    per = part.groupBy("gene_id", "paths").agg(crossing.alias("crossing"), F.array_sort(F.collect_list(F.when(F.col("own") == F.col("whole"), F.col("place")))).alias("places"))
    rows = patterns.select("gene_id", "paths_key", F.explode("paths").alias("path_id")).join(groups, ["gene_id", "path_id"]).join(sizes.select("gene_id", "group_id", "place"), ["gene_id", "group_id"])
    rows = rows.groupBy("gene_id", "paths_key").agg(F.array_sort(F.collect_set("place")).alias("row")).groupBy("gene_id").agg(F.collect_set("row").alias("rows"))
    asked = per.groupBy("gene_id").agg(F.collect_set("places").alias("sets"))
    every = asked.join(sizes.select("gene_id", "columns").distinct(), "gene_id").join(rows, "gene_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            genes, places, held = [], [], []
            for gene, sets, n, rows in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                m = np.zeros((1 + len(rows or []), n), np.int64)
                m[0] = 1
                for k, row in enumerate(rows or [], 1):
                    m[k, row] = 1
                asked = np.zeros((len(sets), n), np.int64)
                for k, of in enumerate(sets):
                    asked[k, of] = 1
                genes += [gene] * len(sets)
                places += sets
                held += exact.RowSpace(m).holds(asked).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(genes, b.schema.field(0).type), pa.array(places, pa.list_(pa.int32())), pa.array(held, pa.bool_())], names=["gene_id", "places", "in_space"])

    kind = every.schema["gene_id"].dataType.simpleString()
    tested = every.select("gene_id", F.col("sets").cast("array<array<int>>").alias("sets"), F.col("columns").cast("int").alias("columns"), F.col("rows").cast("array<array<int>>").alias("rows"))
    tested = tested.mapInArrow(run, f"gene_id {kind}, places array<int>, in_space boolean")
    mass = subsets.join(patterns.select("gene_id", F.col("paths").alias("inner"), "mass"), "gene_id").where(F.size(F.array_except("inner", "paths")) == 0)
    mass = mass.groupBy("gene_id", "paths").agg(F.sum("mass").alias("exclusive_mass"))
    out = per.withColumn("places", F.col("places").cast("array<int>")).join(tested, ["gene_id", "places"]).join(mass, ["gene_id", "paths"], "left")
    defined = F.size("crossing") == 0
    return out.select("gene_id", "paths", "crossing", defined.alias("defined"), (defined & F.col("in_space")).alias("estimable"), F.coalesce("exclusive_mass", F.lit(0)).alias("exclusive_mass"))


def estimable_contrasts(pairs: DataFrame, patterns: DataFrame, groups: DataFrame, least: float = 1.0) -> DataFrame:
    """Contrasts of subset_contrasts with the status of both sides (F9): separable if both are estimable, reportable if
    both have `least` exclusive mass as well."""
    sides = pairs.select("gene_id", F.col("paths_a").alias("paths")).unionByName(pairs.select("gene_id", F.col("paths_b").alias("paths")))
    status = subset_status(sides, patterns, groups)
    of = lambda x: status.select("gene_id", F.col("paths").alias(f"paths_{x}"), F.col("crossing").alias(f"crossing_{x}"), F.col("estimable").alias(f"estimable_{x}"), F.col("exclusive_mass").alias(f"mass_{x}"))
    d = pairs.join(of("a"), ["gene_id", "paths_a"]).join(of("b"), ["gene_id", "paths_b"])
    separable = F.col("estimable_a") & F.col("estimable_b")
    reportable = separable & (F.col("mass_a") >= least) & (F.col("mass_b") >= least)
    crossing = F.array_sort(F.array_union("crossing_a", "crossing_b"))
    return d.select("gene_id", "choice_id", "context", "a", "b", "paths_a", "paths_b", crossing.alias("crossing"), "estimable_a", "estimable_b", "mass_a", "mass_b", separable.alias("separable"), reportable.alias("reportable"))


def heldout_contrast_support(cells: DataFrame, pairs: DataFrame, mass: DataFrame) -> DataFrame:
    """Every held-out cell with every contrast of its gene, masses 0 where absent, and a tier.

    cells: cell_id, gene_id; pairs: gene_id, choice_id, a, b; mass: cell_id, gene_id, alternative_id, mass (once each).
    Masses of a cell and gene meet it in one row, before it is multiplied by the pairs of its gene, a vocabulary.
    """
    own = mass.where("alternative_id IS NOT NULL").groupBy("cell_id", "gene_id").agg(F.map_from_entries(F.collect_list(F.struct("alternative_id", "mass"))).alias("own"))
    d = cells.join(own, ["cell_id", "gene_id"], "left").join(F.broadcast(pairs.select("gene_id", "choice_id", "a", "b")), "gene_id")
    of = lambda side: F.coalesce(F.try_element_at("own", F.col(side)), F.lit(0).cast(mass.schema["mass"].dataType))
    d = d.withColumns({"mass_a": of("a"), "mass_b": of("b")}).drop("own")
    tier = F.when((F.col("mass_a") > 0) & (F.col("mass_b") > 0), "both").when((F.col("mass_a") > 0) | (F.col("mass_b") > 0), "one").otherwise("none")
    return d.withColumn("tier", tier)


def coverage_tables(records: DataFrame, scopes: list[str]) -> DataFrame:
    """Waterfall of contrast records by scope and split, over the full grid (F11). records: scope, split, tier."""
    splits = records.select("split").distinct()
    grid = splits.crossJoin(F.broadcast(records.sparkSession.createDataFrame([(s,) for s in ["all", *scopes]], "scope string")))
    long = records.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("scope"))))
    own = long.groupBy("scope", "split").agg(F.count("*").alias("eligible"), F.count_if(F.col("tier") != "none").alias("touched"), F.count_if(F.col("tier") == "both").alias("estimable"))
    return grid.join(own, ["scope", "split"], "left").fillna({"eligible": 0, "touched": 0, "estimable": 0})


#: Steps of whole genes that a task works on at once, and rows that it takes on at a time.
CHUNK_STEPS, SLICE = 1 << 16, 1 << 11


def _ranks(*columns: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
    """The place of every value among the sorted distinct ones (-1 for NULL), for columns of one type, and those values."""
    coded = pa.concat_arrays(columns).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    at = rank[pc.fill_null(coded.indices, len(order)).to_numpy(zero_copy_only=False)]
    return np.split(at, np.cumsum([len(c) for c in columns])[:-1]), coded.dictionary.take(pa.array(order))


def _numbered(*parts: np.ndarray) -> np.ndarray:
    """Equal tuples get equal numbers, from 0."""
    at = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        at = np.unique(at * (p.max(initial=0) + 2) + p + 1, return_inverse=True)[1]
    return at


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs first, first + 1, ... of n each: the number of the run, and the places."""
    run = np.repeat(np.arange(len(n)), n)
    return run, first[run] + np.arange(len(run)) - (np.cumsum(n) - n)[run]


def _choices(t: pa.Table) -> pa.RecordBatch:
    """Choices of whole genes: gene_id, entry, exit and alternatives (edges, paths). t: gene_id, path_id, edge, src, dst."""
    col = {c: t.column(c).combine_chunks() for c in t.column_names}
    size = pc.fill_null(pc.list_value_length(col["src"]), 0).to_numpy(zero_copy_only=False)
    (gene,), _ = _ranks(col["gene_id"])
    (path,), _ = _ranks(col["path_id"])
    row = np.repeat(np.arange(len(size)), size)
    end = np.cumsum(size)[row]  # of the step's path
    edge, src, dst = (col[c].flatten() for c in ("edge", "src", "dst"))
    (s, d), nodes = _ranks(src, dst)
    (kind,), _ = _ranks(edge)
    g = gene[row]
    e = _numbered(g, kind, s, d)
    place = _numbered(np.concatenate([g, g]), np.concatenate([s, d]))
    entry, into = np.split(place, 2)
    n = place.max(initial=-1) + 1
    # entries that branch, and the nearest node that all their paths meet again
    live = (path[row] >= 0) & (s >= 0)
    k = np.bincount(entry[live], minlength=n)
    low, high = np.full(n, len(e)), np.full(n, -1)
    np.minimum.at(low, entry[live], e[live])
    np.maximum.at(high, entry[live], e[live])
    start = np.flatnonzero(live & (low < high)[entry])
    run, to = _spread(start, end[start] - start)
    ok = live[to] & (d[to] >= 0)
    a, b = start[run[ok]], to[ok]
    key, pair, seen = np.unique(entry[a] * n + into[b], return_inverse=True, return_counts=True)
    far, total, name = np.zeros(len(key), np.int64), np.bincount(pair, b - a + 1, minlength=len(key)), np.zeros(len(key), np.int64)
    np.maximum.at(far, pair, b - a + 1)
    name[pair] = d[b]
    met = np.flatnonzero(seen == k[key // n]) if len(key) else np.zeros(0, np.int64)
    met = met[np.lexsort((name[met], total[met], far[met], key[met] // n))]
    met = met[np.unique(key[met] // n, return_index=True)[1]] if len(met) else met
    exits = np.full(n, -1)
    exits[key[met] // n] = key[met] % n
    # alternatives: runs of edges from entry to exit
    ok = into[b] == exits[entry[a]]
    a, b = a[ok], b[ok]
    alt = _numbered(entry[a], pd.factorize(np.array([e[i : j + 1].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)] + [b""], object))[0][:-1])
    one = np.unique(alt, return_index=True)[1]
    of = entry[a[one]]  # the entry of each alternative
    good = np.bincount(of, minlength=n) >= 2
    # inner nodes: one edge in, one edge out, and in one alternative only
    each = np.unique(e, return_index=True)[1]
    out, inn = np.bincount(entry[each], minlength=n), np.bincount(into[each], minlength=n)
    run, at = _spread(a[one], b[one] - a[one])
    inner = np.unique(np.stack([of[run], into[at], run])[:, d[at] >= 0], axis=1)
    shared = np.unique(inner[:2], axis=1, return_counts=True)
    for where, bad in ((inner[:2], (out[inner[1]] != 1) | (inn[inner[1]] != 1)), (shared[0], shared[1] > 1)):
        good[where[0][bad]] = False
    # choices that have an edge in common all go
    run, at = _spread(a[one], b[one] - a[one] + 1)
    used = np.unique(np.stack([e[at], of[run]])[:, good[of[run]]], axis=1)
    clash = np.bincount(used[0], minlength=len(e) + 1) > 1
    good[used[1][clash[used[0]]]] = False
    kept = np.flatnonzero(good[of])
    kept = kept[np.argsort(of[kept], kind="stable")]
    mine = np.flatnonzero(good[entry[a]])
    mine = mine[np.lexsort((path[row[a[mine]]], alt[mine], entry[a[mine]]))]
    lists = lambda counts, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
    _, steps = _spread(a[one[kept]], (b - a)[one[kept]] + 1)
    edges = pa.StructArray.from_arrays([x.take(pa.array(steps)) for x in (edge, src, dst)], ["edge", "src", "dst"])
    again = np.bincount(alt[mine], minlength=len(one))[kept]
    alts = pa.StructArray.from_arrays([lists((b - a)[one[kept]] + 1, edges), lists(again, col["path_id"].take(pa.array(row[a[mine]])))], ["edges", "paths"])
    who, head, many = np.unique(of[kept], return_index=True, return_counts=True)
    head = one[kept[head]]
    columns = [col["gene_id"].take(pa.array(row[a[head]])), src.take(pa.array(a[head])), dst.take(pa.array(b[head])), lists(many, alts)]
    return pa.RecordBatch.from_arrays(columns, names=["gene_id", "entry", "exit", "alternatives"])


def path_choices(paths: DataFrame) -> DataFrame:
    """Choices of paths that are a row each (F8): gene_id, entry, exit, alternatives ARRAY of (edges, paths).

    paths: gene_id, path_id, and arrays edge, src and dst of its steps in order; an edge is known by all three. The exit
    has the least (greatest distance, sum of distances, node). Rows are moved once, to their gene; a task works on the
    steps of some whole genes at a time, and pairs of a path's nodes stay there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, steps, last = [], 0, None
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                b = whole.slice(at, SLICE)
                gene = b.column(0)
                if steps >= CHUNK_STEPS and gene[-1].as_py() != last:
                    cut = pc.index(pc.not_equal(gene, pa.scalar(last, gene.type)), True).as_py()
                    yield _choices(pa.Table.from_batches([*held, b.slice(0, cut)]))
                    b, held, steps = b.slice(cut), [], 0
                held.append(b)
                steps, last = steps + len(b.column(3).flatten()), gene[-1].as_py()
        if held:
            yield _choices(pa.Table.from_batches(held))

    kind = lambda c: paths.schema[c].dataType.simpleString()
    edge, src = (kind(c)[len("array<") : -1] for c in ("edge", "src"))
    out = f"gene_id {kind('gene_id')}, entry {src}, exit {src}, alternatives array<struct<edges:array<struct<edge:{edge},src:{src},dst:{src}>>,paths:array<{kind('path_id')}>>>"
    dealt = paths.where("gene_id IS NOT NULL").select("gene_id", "path_id", "edge", "src", "dst")
    return dealt.repartition("gene_id").sortWithinPartitions("gene_id").mapInArrow(run, out)


def named_choices(choices: DataFrame, node, edge) -> DataFrame:
    """gene_id, choice_id, alternative_id, edges, paths from rows of path_choices; node and edge make names of their columns (F8)."""
    named = F.transform("alternatives", lambda a: F.struct(F.transform(a.edges, edge).alias("edges"), a.paths.alias("paths")))
    ordered = F.array_sort(F.transform(named, lambda a: F.struct(F.array_join(a.edges, "\0").alias("k"), a.edges.alias("edges"), a.paths.alias("paths"))))
    choice = F.concat(F.lit("choice:"), F.col("gene_id").cast("string"), F.lit(":"), node(F.col("entry")), F.lit("->"), node(F.col("exit")))
    d = choices.select("gene_id", choice.alias("choice_id"), F.posexplode(ordered).alias("number", "a"))
    number = F.lpad(F.col("number").cast("string"), 3, "0")
    return d.select("gene_id", "choice_id", F.concat("choice_id", F.lit(":alt:"), number).alias("alternative_id"), "a.edges", "a.paths")


def internal_choices(path_edges: DataFrame) -> DataFrame:
    """Alternatives between a branch node and the nearest node where all its paths meet again (F8).

    path_edges: gene_id, path_id, edge_order (from 0), edge_id, src, dst. The exit has the least (greatest distance, sum
    of distances, id). Alternatives must be at least two, linear inside (no further branch or merge) and share no inner
    node; choices that have an edge in common all go. Rows: gene_id, choice_id, alternative_id, edges, paths.
    """
    steps = F.array_sort(F.collect_list(F.struct("edge_order", "edge_id", "src", "dst")))
    paths = path_edges.groupBy("gene_id", F.col("path_id").cast("string").alias("path_id")).agg(steps.alias("s"))
    paths = paths.select("gene_id", "path_id", F.col("s.edge_id").alias("edge"), "s.src", "s.dst")
    return named_choices(path_choices(paths), lambda v: v, lambda v: v.edge)
