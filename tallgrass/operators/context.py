"""Cell context: normalised activity, stratified neighbours, mapped accessibility, gates and feature scaling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.core import effective_size, reasons, weighted_mean
from ..sources.shared import cut
from .audit import exact_quantiles, weighted_quantile


def cp10k_log1p(counts: DataFrame, cell: str = "cell_id") -> DataFrame:
    """log1p(10,000 x / library), the library being the cell's sum over the full axis; 0 and invalid where it is 0."""
    library = F.sum("n").over(Window.partitionBy(cell))
    d = counts.withColumn("library", library)
    return d.withColumn("value", F.when(F.col("library") > 0, F.log1p(1e4 * F.col("n") / F.col("library"))).otherwise(0.0)).withColumn("valid", F.col("library") > 0)


def entity_activity(counts: DataFrame, members: DataFrame, cells: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """Activity of entities: raw counts of the members are summed, then one log1p.

    Every (cell, entity) has a row: observed zeros stay 0; cells without a library are unobserved with NULL. `library`
    (cell_id, library) replaces the sums of counts, as when a perturbation holds the denominator fixed.
    """
    if library is None:
        library = counts.groupBy("cell_id").agg(F.sum("n").alias("library"))
    own = counts.join(members, "gene_id").groupBy("cell_id", "entity_id").agg(F.sum("n").alias("raw"))
    grid = cells.select("cell_id").distinct().crossJoin(members.select("entity_id").distinct())  # Spark broadcasts by size
    d = grid.join(own, ["cell_id", "entity_id"], "left").join(library, "cell_id", "left").fillna({"raw": 0, "library": 0})
    observed = F.col("library") > 0
    return d.select("cell_id", "entity_id", "raw", F.when(observed, F.log1p(1e4 * F.col("raw") / F.col("library"))).alias("activity"), observed.alias("observed"))


#: Pivots of a stratum, and parts of a pivot's rows by their distance to it.
PIVOTS, RINGS = 6, 16


def _distance(a: Column, b: Column) -> Column:
    square = lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))
    return F.sqrt(F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x))


def _pivots(a: DataFrame) -> DataFrame:
    """(stratum, pivots): vectors of the atlas rows of least hash, one per shard of ids."""
    drawn = a.groupBy("stratum", F.pmod(F.xxhash64("neighbor_id"), F.lit(PIVOTS)).alias("shard")).agg(F.min_by("v", F.xxhash64(F.lit(7), "neighbor_id")).alias("v"))
    return drawn.groupBy("stratum").agg(F.collect_list("v").alias("pivots"))


def knn_blocks(rows: DataFrame, key: str, pivots: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks of about `block`, and a table of blocks with their rows and their range of distances to every pivot.

    pivots: stratum, pivots ARRAY of vectors. A block has rows of one nearest pivot, of like distance to it.
    """
    d = rows.join(pivots, "stratum").withColumn("_to", F.transform("pivots", lambda p: _distance(F.col("v"), p))).drop("pivots")
    d = d.withColumn("_near", F.array_min("_to")).withColumn("_cell", F.array_position("_to", F.col("_near")))
    cell = ["stratum", "_cell"]
    cuts = d.groupBy(*cell).agg(F.percentile_approx("_near", [i / RINGS for i in range(1, RINGS)], F.lit(1000)).alias("_cuts"))
    d = d.join(cuts, cell).withColumn("_ring", F.size(F.filter("_cuts", lambda c: c < F.col("_near")))).drop("_cuts")
    ring = [*cell, "_ring"]
    parts = d.groupBy(*ring).agg(F.ceil(F.count("*") / block).alias("_parts"))
    d = d.join(parts, ring).withColumn("block", F.concat_ws("|", "_cell", "_ring", F.pmod(F.xxhash64(key), F.col("_parts"))))
    at = d.select("stratum", "block", F.posexplode("_to").alias("p", "x")).groupBy("stratum", "block", "p").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    table = at.groupBy("stratum", "block").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("p", "lo", "hi"))).alias("box"))
    return d.select(key, "stratum", "v", "block"), table


def block_pairs(q: DataFrame, a: DataFrame, k: int) -> DataFrame:
    """Pairs of query and atlas blocks that may hold neighbours: stratum, q_block, a_block, rows of both, and `kept`.

    By the triangle inequality no atlas row of a block is nearer than the gap between the two ranges of distances to any
    pivot, and none is farther than the sum of their upper ends. The least such sum that covers k atlas rows bounds the
    k-th distance of every query of the block; pairs whose gap is beyond it can hold no neighbour, not even a tied one.
    """
    both = q.select("stratum", F.col("block").alias("q_block"), F.col("n").alias("q_rows"), F.col("box").alias("qb")).join(a.select("stratum", F.col("block").alias("a_block"), F.col("n").alias("a_rows"), F.col("box").alias("ab")), "stratum")
    gap = F.array_max(F.zip_with("qb", "ab", lambda x, y: F.greatest(x.lo - y.hi, y.lo - x.hi, F.lit(0.0))))
    far = F.array_min(F.zip_with("qb", "ab", lambda x, y: x.hi + y.hi))
    both = both.select("stratum", "q_block", "a_block", "q_rows", "a_rows", gap.alias("gap"), far.alias("far"))
    w = Window.partitionBy("stratum", "q_block").orderBy("far", "a_block")
    covered = F.sum("a_rows").over(w.rowsBetween(Window.unboundedPreceding, 0))
    limit = F.min(F.when(F.col("_covered") >= k, F.col("far"))).over(Window.partitionBy("stratum", "q_block"))
    d = both.withColumn("_covered", covered).withColumn("_limit", limit)
    # with a margin for the rounding of distances
    return d.select("stratum", "q_block", "a_block", "q_rows", "a_rows", F.coalesce(F.col("gap") <= F.col("_limit") * (1 + 1e-9) + 1e-9, F.lit(True)).alias("kept"))


def _sides(queries: DataFrame, atlas: DataFrame, block: int):
    q, a = (d.where("stratum IS NOT NULL AND v IS NOT NULL") for d in (queries.select("query_id", "stratum", "v"), atlas.select("neighbor_id", "stratum", "v")))
    a = a.select(*(F.col(c).alias(c) for c in a.columns))  # own columns, where both sides come from one table
    drawn = cut(_pivots(a))  # one set of pivots for both sides
    return (*knn_blocks(q, "query_id", drawn, block), *knn_blocks(a, "neighbor_id", drawn, block))


def knn_pruning(queries: DataFrame, atlas: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Per stratum: pairs of blocks, and how many of them and of their pairs of rows are left out unseen."""
    _, qt, _, at = _sides(queries, atlas, block)
    work = F.col("q_rows") * F.col("a_rows")
    return block_pairs(qt, at, k).groupBy("stratum").agg(F.count("*").alias("block_pairs"), F.count_if(~F.col("kept")).alias("skipped"), (F.sum(F.when(~F.col("kept"), work).otherwise(0)) / F.sum(work)).alias("share_of_rows"))


def knn_strata(queries: DataFrame, atlas: DataFrame, k: int) -> DataFrame:
    """Every stratum of the queries with its rows on both sides, and the reason against mapping it."""
    q = queries.groupBy("stratum").agg(F.count("*").alias("queries"), F.count("v").alias("with_vector"))
    a = atlas.where("v IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("atlas_rows"))
    d = q.join(a, "stratum", "left").fillna({"atlas_rows": 0})
    why = F.when(F.col("stratum").isNull(), "no_stratum").when(F.col("atlas_rows") < k, "fewer_atlas_rows_than_k").when(F.col("with_vector") < F.col("queries"), "queries_without_vector")
    return d.select("stratum", "queries", "atlas_rows", why.alias("reason"))


def knn_map(queries: DataFrame, atlas: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Exact Euclidean nearest atlas rows of every query within its stratum (X3): query_id, stratum, neighbor_id, distance, rank.

    Both sides are dealt to blocks of rows that lie alike to a stratum's pivots. Pairs of blocks that can't hold a
    neighbour are never built; the others meet as two small matrices, of which k rows per query leave before the blocks'
    winners meet. No pair of rows is shuffled and no task sees a stratum whole. Ties go to the least id. Strata with fewer
    than k atlas rows have no neighbours, as have rows without a stratum or a vector; `knn_strata` gives the reasons.
    """
    enough = atlas.where("v IS NOT NULL").groupBy("stratum").agg(F.count("*").alias("_n")).where(F.col("_n") >= k)
    q, qt, a, at = _sides(queries.join(enough, "stratum", "left_semi"), atlas, block)
    pairs = cut(block_pairs(qt, at, k).where("kept").select("stratum", "q_block", "a_block"))
    q = q.withColumnRenamed("block", "q_block").join(pairs, ["stratum", "q_block"])
    a = a.withColumnRenamed("block", "a_block").join(pairs, ["stratum", "a_block"])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("neighbor_id", kind="stable")
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": left["query_id"][:0], "stratum": left["stratum"][:0], "neighbor_id": right["neighbor_id"][:0], "distance": np.zeros(0)})
        x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (left, right))
        total = np.zeros((len(x), len(y)))
        for i in range(x.shape[1]):
            total += (x[:, i, None] - y[None, :, i]) ** 2
        at = np.argsort(total, axis=1, kind="stable")[:, :k]
        ids = np.repeat(np.arange(len(x)), at.shape[1])
        return pd.DataFrame({
            "query_id": left["query_id"].to_numpy()[ids], "stratum": left["stratum"].to_numpy()[ids],
            "neighbor_id": right["neighbor_id"].to_numpy()[at.ravel()], "distance": np.sqrt(np.take_along_axis(total, at, 1)).ravel(),
        })

    keys = ["stratum", "q_block", "a_block"]
    kind = T.StructType([queries.schema["query_id"], queries.schema["stratum"], atlas.schema["neighbor_id"], T.StructField("distance", T.DoubleType())])
    near = q.groupBy(*keys).cogroup(a.groupBy(*keys)).applyInPandas(nearest, kind)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))).where(F.col("rank") <= k)


def knn_threshold(neighbors: DataFrame, split: DataFrame, q: float = 0.99, floor: float = 1e-6) -> DataFrame:
    """Per stratum over training queries: the q quantile and the median (at least `floor`) of nearest distances."""
    d = neighbors.where("rank = 1").join(split.where("split = 'train'"), "query_id", "left_semi")
    d = exact_quantiles(d, ["stratum"], "distance", {"q": q, "half": 0.5})
    return d.select("stratum", F.col("q.linear").alias("limit"), F.greatest("half.linear", F.lit(floor)).alias("temperature"))


def admit_weights(neighbors: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Neighbours within the limit, weighted by exp(-distance / temperature) and normalised after filtering."""
    d = neighbors.join(thresholds, "stratum").where("distance <= limit").withColumn("w", F.exp(-F.col("distance") / F.col("temperature")))
    return d.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("query_id"))).drop("w", "limit", "temperature")


def mapping_audit(queries: DataFrame, weights: DataFrame, k: int, most: float) -> DataFrame:
    """Every query with its neighbours, effective size, evenness, coverage of k, distances and ordered reasons against it.

    A query is valid without reasons: none or more than k neighbours, one of them twice, weights that are negative, not
    finite or do not sum to 1, any distance beyond `most`, and, where weights has the columns query_qc, neighbor_qc and
    paired (booleans) and consistency (text), a row that fails one of them or rows that differ in consistency.
    """
    has = lambda c: c in weights.columns
    bad = F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))
    flags = {c: F.max(~F.coalesce(c, F.lit(False))) if has(c) else F.lit(False) for c in ("query_qc", "neighbor_qc", "paired")}
    total = F.sum("weight")
    by = weights.groupBy("query_id").agg(
        F.count("*").alias("neighbors"), F.try_divide(total * total, F.sum(F.col("weight") * F.col("weight"))).alias("ess"), F.try_divide(F.max("weight"), total).alias("max_weight"),
        F.min("distance").alias("nearest"), F.try_divide(F.sum(F.col("weight") * F.col("distance")), total).alias("weighted_distance"),
        (F.count_distinct("neighbor_id") < F.count("*")).alias("_twice"), (F.max(bad) | (F.abs(total - 1) > 1e-8)).alias("_weights"), F.max(F.col("distance").isNull() | F.isnan("distance") | (F.col("distance") > most)).alias("_far"),
        *(c.alias(f"_{k}") for k, c in flags.items()),
        (F.when(F.min("consistency").eqNullSafe(F.max("consistency")), F.min("consistency")).otherwise("inconsistent") if has("consistency") else F.lit("pass")).alias("consistency"),
    )
    d = queries.select("query_id").join(by, "query_id", "left").fillna({"neighbors": 0})
    alone = (F.col("neighbors") == 1) & (F.col("consistency") == "not_estimable")
    why = reasons(
        (F.col("neighbors") == 0, "no_neighbors"), (F.col("neighbors") > k, "too_many_neighbors"), (F.col("_twice"), "duplicate_neighbor"), (F.col("_weights"), "bad_weights"), (F.col("_far"), "far"),
        (F.col("_query_qc"), "query_qc"), (F.col("_neighbor_qc"), "neighbor_qc"), (F.col("_paired"), "not_paired"), ((F.col("consistency") != "pass") & ~alone, "inconsistent"),
    )
    d = d.withColumns({"evenness": F.col("ess") / F.col("neighbors"), "coverage": F.col("neighbors") / k, "reasons": F.array_join(why, ",")})
    return d.drop("_twice", "_weights", "_far", *(f"_{k}" for k in flags)).withColumn("valid", F.col("reasons") == "")


def map_access(weights: DataFrame, normalised: DataFrame) -> DataFrame:
    """Weighted sum over neighbours of values that are normalised first (X7). normalised: neighbor_id, peak_id, value."""
    return weights.join(normalised, "neighbor_id").groupBy("query_id", "peak_id").agg(F.sum(F.col("weight") * F.col("value")).alias("access"))


def stage_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """The one value of each key; NULL where it has several."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values"), F.min(value).alias("v")).select(key, "n_values", F.when(F.col("n_values") == 1, F.col("v")).alias(value))


def raw_gates(keys: DataFrame, activity: DataFrame, access: DataFrame) -> DataFrame:
    """Raw gate values (X9): RNA is activity, OPEN accessibility, DNA their product before any centring; observed is AND.

    keys: gate_key_id, channel, entity_id, peak_id; activity: cell_id, entity_id, activity, observed; access: cell_id, peak_id, access.
    """
    act = activity.select("cell_id", "entity_id", F.when(F.col("observed"), F.col("activity")).alias("a"))
    acc = access.select("cell_id", "peak_id", F.col("access").alias("o"))
    one = lambda d, v: d.select("gate_key_id", "cell_id", v.alias("raw"))
    rna = one(keys.where("channel = 'RNA'").join(act, "entity_id"), F.col("a"))
    opened = one(keys.where("channel = 'OPEN'").join(acc, "peak_id"), F.col("o"))
    dna = one(keys.where("channel = 'DNA'").join(act, "entity_id").join(acc, ["cell_id", "peak_id"]), F.col("a") * F.col("o"))
    return rna.unionByName(opened).unionByName(dna).withColumn("observed", F.col("raw").isNotNull())


def fit_gates(raw: DataFrame, mass: DataFrame, split: DataFrame, least_n: float = 10.0, least_sd: float = 1e-3, least_cells: int = 1, least_mass: float = 0.0) -> DataFrame:
    """Training moments of every gate weighted by mass, its range and 5/95 % quantiles, reasons against it.

    A gate is active without reasons: too few cells, effective cells or molecules, or a deviation of at most least_sd
    (1e-8 where that is less). A gate without training observations has counts of 0 and NULL moments.
    """
    d = raw.where("observed").join(mass.where("mass > 0"), "cell_id").join(split.where("split = 'train'"), "cell_id", "left_semi")
    mean = d.groupBy("gate_key_id").agg(weighted_mean(F.col("raw"), F.col("mass")).alias("mean"))
    d2 = d.join(mean, "gate_key_id")
    m = d2.groupBy("gate_key_id").agg(
        F.first("mean").alias("mean"), F.sqrt(weighted_mean(F.pow(F.col("raw") - F.col("mean"), F.lit(2)), F.col("mass"))).alias("sd"), effective_size(F.col("mass")).alias("n_eff"),
        F.count("*").alias("n_valid"), F.sum(F.col("mass").cast("double")).alias("informative"), F.min("raw").alias("lo"), F.max("raw").alias("hi"),
    )
    for name, q in (("q05", 0.05), ("q95", 0.95)):
        m = m.join(weighted_quantile(d, ["gate_key_id"], "raw", "mass", q).withColumnRenamed("quantile", name), "gate_key_id", "left")
    m = raw.select("gate_key_id").distinct().join(m, "gate_key_id", "left").fillna({"n_valid": 0, "n_eff": 0.0, "informative": 0.0})
    flat = F.col("sd").isNull() | F.isnan("sd") | (F.col("sd") <= max(least_sd, 1e-8))
    why = reasons(
        (F.col("mean").isNull(), "never_observed"), (F.col("n_valid") < least_cells, "few_cells"), (F.col("n_eff") < least_n, "few_effective_cells"),
        (F.col("informative") < least_mass, "few_molecules"), (flat, "no_variance"),
    )
    return m.withColumn("reasons", F.array_join(why, ",")).withColumn("active", F.col("reasons") == "")


def apply_gates(raw: DataFrame, manifest: DataFrame, floor: float = 1e-8) -> DataFrame:
    """z of active observed gates, 0 otherwise, never clipped; flags for values out of range and of the quantiles (X11)."""
    d = raw.join(manifest.select("gate_key_id", "mean", "sd", "lo", "hi", "q05", "q95", "active"), "gate_key_id")
    on = F.col("active") & F.col("observed")
    z = F.when(on, (F.col("raw") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(floor))).otherwise(0.0)
    out = lambda a, b: F.coalesce(on & ((F.col("raw") < F.col(a)) | (F.col("raw") > F.col(b))), F.lit(False))
    return d.select("gate_key_id", "cell_id", z.alias("gate"), "observed", out("lo", "hi").alias("out_of_range"), out("q05", "q95").alias("out_of_quantiles"))


def gate_collinearity(raw: DataFrame, keys: DataFrame, mass: DataFrame, split: DataFrame, near: float = 0.95) -> DataFrame:
    """Weighted Pearson correlation of every pair of a gene's active gates on training cells that have both.

    keys: gate_key_id, gene_id, active; split: cell_id, split. Values are taken from their gate's mean first, so that sums
    of squares keep their digits at large means.
    """
    keys = keys.where("active")
    seen = raw.where("observed").join(split.where("split = 'train'"), "cell_id", "left_semi").join(keys, "gate_key_id", "left_semi")
    mean = seen.groupBy("gate_key_id").agg(F.avg("raw").alias("_mean"))
    d = seen.join(mean, "gate_key_id").withColumn("raw", F.col("raw") - F.col("_mean")).drop("_mean")
    d = d.join(keys.select("gate_key_id", "gene_id"), "gate_key_id").join(mass.where("mass > 0"), "cell_id")
    b = d.select("gene_id", "cell_id", F.col("gate_key_id").alias("gate_b"), F.col("raw").alias("y"))
    p = d.select("gene_id", "cell_id", F.col("gate_key_id").alias("gate_a"), F.col("raw").alias("x"), F.col("mass").cast("double").alias("w")).join(b, ["gene_id", "cell_id"]).where("gate_a < gate_b")
    s = lambda c: F.sum(F.col("w") * c)
    x, y = F.col("x"), F.col("y")
    m = p.groupBy("gene_id", "gate_a", "gate_b").agg(F.sum("w").alias("sw"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"), effective_size(F.col("w")).alias("n_eff"))
    vx, vy, c = (F.col(a) / F.col("sw") - F.col(b) * F.col(d2) / F.col("sw") / F.col("sw") for a, b, d2 in (("sxx", "sx", "sx"), ("syy", "sy", "sy"), ("sxy", "sx", "sy")))
    r = F.when((vx > 1e-12) & (vy > 1e-12), c / F.sqrt(vx * vy))
    status = F.when(r.isNull(), "zero_variance").when(F.abs(r) > 1 - 1e-9, "perfect").when(F.abs(r) >= near, "near").otherwise("distinct")
    return m.select("gene_id", "gate_a", "gate_b", "n_eff", r.alias("r"), status.alias("status"))


def overridden(values: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Values with those of a perturbation in their place (X15); rows of unknown keys are ignored."""
    c = changes.select(*keys, F.col(column).alias("_new"))
    return values.join(c, keys, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def perturbed_gates(changes: DataFrame, keys: DataFrame, activity: DataFrame, access: DataFrame, manifest: DataFrame) -> DataFrame:
    """Only the gates that perturbations of a cell's sources touch, computed anew, with flags and a status.

    changes: change_id, cell_id, kind (activity or access), source_id, value. Gates are found from their sources, the
    other factor of a product comes from the cell's own values, and what was not observed stays so. The support of a
    change is model_extrapolation if any of its gates leaves the training range or quantiles, missing_context if one is
    not observed or not active, else supported. A change is an error if no cell or gate has its source, or if its value is
    not a finite number of 0 or more.
    """
    long = keys.select("gate_key_id", "channel", F.lit("activity").alias("kind"), F.col("entity_id").cast("string").alias("source_id"), F.col("peak_id").alias("other_peak"), F.lit(None).cast("string").alias("other_entity"))
    long = long.unionByName(keys.select("gate_key_id", "channel", F.lit("access").alias("kind"), F.col("peak_id").cast("string").alias("source_id"), F.lit(None).cast(keys.schema["peak_id"].dataType).alias("other_peak"), F.col("entity_id").alias("other_entity")))
    touched = long.where("source_id IS NOT NULL").where("(kind = 'activity' AND channel <> 'OPEN') OR (kind = 'access' AND channel <> 'RNA')")
    known = activity.select("cell_id", F.lit("activity").alias("kind"), F.col("entity_id").cast("string").alias("source_id"), F.col("observed").alias("seen")).unionByName(
        access.select("cell_id", F.lit("access").alias("kind"), F.col("peak_id").cast("string").alias("source_id"), F.lit(True).alias("seen"))
    )
    bad = F.coalesce(~(F.col("value") >= 0) | F.isnan("value") | (F.col("value") == float("inf")), F.lit(True))
    d = changes.select("change_id", "cell_id", "kind", F.col("source_id").cast("string").alias("source_id"), F.col("value").cast("double").alias("value"))
    d = d.join(known, ["cell_id", "kind", "source_id"], "left").join(touched, ["kind", "source_id"], "left")
    fault = F.when(bad, "a source's value must be finite and 0 or more").when(F.col("seen").isNull(), "a cell lacks the source").when(F.col("gate_key_id").isNull(), "a source has no gate")
    d = d.withColumn("value", F.when(fault.isNotNull(), F.raise_error(fault).cast("double")).otherwise(F.col("value")))
    act = activity.select("cell_id", F.col("entity_id").alias("other_entity"), F.when(F.col("observed"), F.col("activity")).alias("_a"))
    acc = access.select("cell_id", F.col("peak_id").alias("other_peak"), F.col("access").alias("_o"))
    d = d.join(act, ["cell_id", "other_entity"], "left").join(acc, ["cell_id", "other_peak"], "left")
    own = F.when(F.col("seen"), F.col("value"))
    raw = F.when(F.col("channel") == "DNA", own * F.when(F.col("kind") == "activity", F.col("_o")).otherwise(F.col("_a"))).otherwise(own)
    m = manifest.select("gate_key_id", "mean", "sd", "lo", "hi", "q05", "q95", "active")
    d = d.select("change_id", "cell_id", "gate_key_id", raw.alias("raw"), raw.isNotNull().alias("observed")).join(m, "gate_key_id", "left")
    on = F.coalesce(F.col("active"), F.raise_error(F.concat(F.lit("no training moments of gate "), F.col("gate_key_id"))).cast("boolean")) & F.col("observed")
    z = F.when(on, (F.col("raw") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1e-8))).otherwise(0.0)
    out = lambda a, b: F.coalesce(on & ((F.col("raw") < F.col(a)) | (F.col("raw") > F.col(b))), F.lit(False))
    d = d.select("change_id", "cell_id", "gate_key_id", "raw", z.alias("gate"), "observed", "active", out("lo", "hi").alias("out_of_range"), out("q05", "q95").alias("out_of_quantiles"))
    w = Window.partitionBy("change_id")
    support = F.when(F.bool_or(F.col("out_of_range") | F.col("out_of_quantiles")).over(w), "model_extrapolation").when(F.bool_or(~F.col("observed") | ~F.col("active")).over(w), "missing_context").otherwise("supported")
    return d.withColumn("support", support)


def merged_gates(gates: DataFrame, perturbed: DataFrame) -> DataFrame:
    """Gates of all cells with those of one change in their place (X15): gate_key_id, cell_id, gate."""
    new = perturbed.select("gate_key_id", "cell_id", F.col("gate").alias("_new"))
    return gates.select("gate_key_id", "cell_id", "gate").join(new, ["gate_key_id", "cell_id"], "left").select("gate_key_id", "cell_id", F.coalesce("_new", "gate").alias("gate"))


def response_curve(points: DataFrame, predictions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Predictions per point beside the manifest of outputs: missing, extra or out of bounds ones have a status."""
    want = points.select("point_id").distinct().crossJoin(manifest.select("output_id").distinct())  # Spark broadcasts by size
    d = want.withColumn("wanted", F.lit(True)).join(predictions, ["point_id", "output_id"], "full")
    status = F.when(F.col("wanted").isNull(), "extra").when(F.col("p").isNull(), "missing").when(~F.col("p").between(0, 1), "out_of_bounds").otherwise("ok")
    return d.select("point_id", "output_id", "p", status.alias("status"))


def cis_table(edges: DataFrame, scores: DataFrame, kinds: list[str]) -> DataFrame:
    """Edges with scores, one-hot kinds, and 0 with a mask where a score does not apply."""
    d = edges.join(scores, "edge_id", "left")
    applies = F.col("kind").isin(kinds[:1]) & F.col("score").isNotNull()
    return d.select("edge_id", *(F.when(F.col("kind") == k, 1).otherwise(0).alias(f"is_{k}") for k in kinds), F.when(applies, F.col("score")).otherwise(0.0).alias("score"), applies.alias("available"))


def fit_norm(features: DataFrame) -> DataFrame:
    """Mean and population sd of every feature over available training edges; constant ones are dropped.

    features: edge_id, feature, value, available, split.
    """
    d = features.where("available AND split = 'train'").select("edge_id", "feature", "value").distinct()
    return d.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n")).withColumn("kept", F.col("sd") > 0)


def apply_norm(features: DataFrame, norm: DataFrame) -> DataFrame:
    """(x - mean) / sd of kept features where available, else 0."""
    d = features.join(norm.where("kept").select("feature", "mean", "sd"), "feature")
    return d.select("edge_id", "feature", F.when(F.col("available"), (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))
