"""Queries of sources, sinks and the stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import contracts
from ..sources import tables as tb
from ..sources.shared import folder
from ..streaming import positional as ps
from .bindings import BINDINGS, ORACLES, QUERIES, bind, oracle, query


def shared(spark: SparkSession) -> str:
    return folder(spark, "tables")


def registered(name: str, sql: str | None = None):
    """Registers a query that takes (spark, sf_dir) itself."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add


@registered("s1_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipmode_ IN ('A', 'N')".replace("l_shipmode_", "l_returnflag"))
def s1(spark, sf_dir):
    return tb.read_pruned(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"], "l_returnflag", ["A", "N"]).drop("l_returnflag")


@registered("s2_read_ec", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('F')")
def s2(spark, sf_dir):
    return tb.read_pruned(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_orderstatus"], "o_orderstatus", ["F"]).drop("o_orderstatus")


@query("s3_read_split", "customer", """WITH c AS (SELECT CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS cell_id, CASE WHEN c_custkey % 7 = 0 THEN 'other' ELSE 'train' END AS split FROM customer)
SELECT cell_id, split, CASE WHEN count(*) OVER (PARTITION BY cell_id) > 1 THEN 'collision' WHEN split = 'other' THEN 'unknown_label' END AS error FROM c""")
def s3(customer):
    k = F.col("c_custkey")
    cell = F.when(k % 10 == 0, F.concat(F.lit("RNA__"), k + 1)).otherwise(k.cast("string"))
    return tb.read_split(customer.select(cell.alias("cell_id"), F.when(k % 7 == 0, "other").otherwise("train").alias("split")))


@registered("s4_read_gtf", """WITH p AS (SELECT p_partkey, p_size, 'chr' || p_size % 20 AS chrom, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM part)
SELECT chrom, 'transcript' AS feature, CAST(p_partkey * 10 AS BIGINT) AS s, CAST(p_partkey * 10 + 500 AS BIGINT) AS e, strand, 'G' || p_size AS gene_id, 'T' || p_partkey AS tx_id, CASE WHEN p_size % 2 = 0 THEN 'sym' || p_size END AS symbol FROM p
UNION ALL SELECT chrom, 'exon', p_partkey * 10 + 200 * x, p_partkey * 10 + 200 * x + 100, strand, 'G' || p_size, 'T' || p_partkey, CASE WHEN p_size % 2 = 0 THEN 'sym' || p_size END FROM p, (VALUES (0), (1)) v(x)""")
def s4(spark, sf_dir):
    """Writes parts as transcripts with two exons each, with other features and comments between, and reads them back."""
    p = bind(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("g"))
    name = F.when(F.col("g") % 2 == 0, F.concat(F.lit(' gene_name "sym'), "g", F.lit('";'))).otherwise("")
    tags = F.concat(F.lit('gene_id "G'), "g", F.lit('.3"; transcript_id "T'), "k", F.lit('.12";'), name)
    line = lambda feature, s, e: F.concat_ws("\t", F.concat(F.lit("chr"), F.col("g") % 20), F.lit("src"), F.lit(feature), s + 1, e, F.lit("."), F.when(F.col("k") % 2 == 0, "+").otherwise("-"), F.lit("."), tags)
    s = F.col("k") * 10
    rows = F.array(F.lit("# a comment"), line("transcript", s, s + 500), line("exon", s, s + 100), line("CDS", s, s + 100), line("exon", s + 200, s + 300))
    path = shared(spark)
    p.select(F.explode(rows).alias("value")).write.text(path)
    return tb.read_gtf(spark, path)


@registered("s6_read_peaks", "SELECT 'chr' || l_suppkey % 20 AS chrom, CAST(l_partkey AS BIGINT) AS s, CAST(l_partkey + l_quantity AS BIGINT) AS e, 'chr' || l_suppkey % 20 || ':' || l_partkey || '-' || CAST(l_partkey + l_quantity AS BIGINT) AS peak_id FROM lineitem")
def s6(spark, sf_dir):
    """Writes line items as a peak file and reads it back."""
    x = bind(spark, sf_dir, "lineitem")
    path = shared(spark)
    x.select(F.concat(F.lit("chr"), F.col("l_suppkey") % 20), "l_partkey", (F.col("l_partkey") + F.col("l_quantity")).cast("long")).write.csv(path, sep="\t")
    return tb.read_peaks(spark, path)


@registered("s5_read_triplets", "SELECT l_suppkey - 1 AS row_id, l_partkey - 1 AS col_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2")
def s5(spark, sf_dir):
    """Writes the counts as coordinate files, one for each of eight shards of suppliers, and reads them back."""
    x = bind(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").cast("long").alias("n"))
    path = shared(spark)
    body = x.select((F.col("l_suppkey") % 8).alias("shard"), F.lit(2).alias("k"), F.concat_ws(" ", "l_suppkey", "l_partkey", "n").alias("value"))
    heads = F.array(F.struct(F.lit(0).alias("k"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("value")), F.struct(F.lit(1).alias("k"), F.lit("0 0 0").alias("value")))
    head = body.select("shard").distinct().select("shard", F.explode(heads).alias("h")).select("shard", "h.k", "h.value")
    rows = head.unionByName(body).repartition("shard").sortWithinPartitions("shard", "k", "value")
    rows.select("shard", "value").write.partitionBy("shard").text(path)
    return tb.read_triplets(spark, f"{path}/*").where("NOT is_size").drop("is_size")


@registered("s7_read_delimited", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s7(spark, sf_dir):
    path = shared(spark)
    bind(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.option("sep", "\t").option("header", True).csv(path)
    return tb.read_delimited(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@registered("s8_write_dataset", "SELECT l_returnflag, l_orderkey, l_quantity FROM lineitem")
def s8(spark, sf_dir):
    path = shared(spark)
    tb.write_dataset(bind(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity"), path, "l_returnflag", ["l_orderkey"])
    return spark.read.parquet(path)


@query("s9_merge_shards", "orders", "SELECT o_custkey, count(*) AS rows FROM orders GROUP BY 1")
def s9(orders):
    merged, twice = tb.merge_shards([orders.where(F.col("o_custkey") % 3 == k) for k in range(3)], "o_custkey")
    return merged.join(twice.select("o_custkey"), "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("rows"))


@query("s10_prepared_features", "paths counts ec", """WITH c AS (SELECT gene_id, count(DISTINCT cell_id) AS cells, CAST(sum(n) AS BIGINT) AS count_mass FROM {counts} GROUP BY 1), e AS (SELECT gene_id, count(*) AS evidence, CAST(sum(mass) AS BIGINT) AS evidence_mass FROM {ec} GROUP BY 1)
SELECT p.gene_id, string_agg(path_id, ',' ORDER BY path_id) AS paths, max(cells) AS cells, max(evidence) AS evidence, max(count_mass) AS count_mass, max(evidence_mass) AS evidence_mass FROM {paths} p LEFT JOIN c ON c.gene_id = p.gene_id LEFT JOIN e ON e.gene_id = p.gene_id GROUP BY 1""")
def s10(paths, counts, ec):
    d = tb.prepared_features(paths, counts, ec)
    return d.select("gene_id", F.array_join("paths", ",").alias("paths"), F.size("cells").cast("long").alias("cells"), F.size("evidence").cast("long").alias("evidence"), "count_mass", "evidence_mass")


@query("s11_manifest", "lineitem", """WITH m AS (SELECT '{"checksum":' || CAST(sum(l_orderkey) AS BIGINT) || ',"name":"lineitem","rows":' || count(*) || '}' AS manifest FROM lineitem) SELECT manifest, sha256(manifest) AS sha256 FROM m""")
def s11(lineitem):
    return tb.manifest(lineitem.agg(F.count("*").alias("rows"), F.sum("l_orderkey").alias("checksum"), F.first(F.lit("lineitem")).alias("name")), ["rows", "name", "checksum"])


@query("q11_provenance", "cell_split counts", """WITH a AS (SELECT count(DISTINCT cell_id) AS cells FROM {counts}), b AS (SELECT count(*) AS cells FROM {cell_split}), n AS (SELECT count(DISTINCT c.cell_id) AS k FROM {counts} c JOIN {cell_split} s ON s.cell_id = c.cell_id)
SELECT a.cells = b.cells AS same_cells, a.cells = k + (a.cells - k) AS matrix_closes, b.cells - k AS compat_only, CASE WHEN a.cells = b.cells THEN 'ADMITTED' ELSE 'PENDING' END AS status FROM a, b, n""")
def q11(split, counts):
    a = counts.agg(F.count_distinct("cell_id").alias("cells"))
    overlap = counts.select("cell_id").distinct().join(split, "cell_id", "left_semi").agg(F.count("*").alias("overlap"))
    d = contracts.provenance(a, split.agg(F.count("*").alias("cells")), overlap)
    return d.select("same_cells", "matrix_closes", "compat_only", "status")


@query("q12_dtu_provenance", "part", """WITH m AS (SELECT p_brand AS gene_id, CASE WHEN count(*) % 2 = 0 THEN 'train_only' ELSE 'all' END AS scope, CASE WHEN min(p_size) > 1 THEN NULL ELSE 'r' END AS source FROM part GROUP BY 1)
SELECT gene_id, concat_ws(',', CASE WHEN scope <> 'train_only' THEN 'scope' END, CASE WHEN source IS NULL THEN 'no_source' END) AS reasons FROM m WHERE scope <> 'train_only' OR source IS NULL""")
def q12(part):
    m = part.groupBy(F.col("p_brand").alias("gene_id")).agg(F.when(F.count("*") % 2 == 0, "train_only").otherwise("all").alias("scope"), F.when(F.min("p_size") <= 1, "r").alias("source"))
    return contracts.dtu_provenance(m)


@query("q10_validate_dataset", "dealt_counts paths cell_split dealt_ec", """SELECT 'counts_without_path' AS check_, count(*) FILTER (path_id NOT IN (SELECT path_id FROM {paths})) AS violations FROM {counts} UNION ALL SELECT 'counts_without_cell', count(*) FILTER (cell_id NOT IN (SELECT cell_id FROM {cell_split})) FROM {counts}
UNION ALL SELECT 'paths_repeated', 0 UNION ALL SELECT 'cells_repeated', 0 UNION ALL SELECT 'bad_split', 0 UNION ALL SELECT 'mass_not_positive', count(*) FILTER (mass <= 0) FROM {ec}""")
def q10(counts, paths, split, ec):
    return contracts.validate_dataset(counts, paths, split, ec)


@registered("st1_positional_aggregate", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS rows, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def st1(spark, sf_dir):
    """The stream over all that there is, closed by one row far ahead, equals the batch over the same rows.

    No row is late, whatever order the files come in: the delay spans the whole table.
    """
    events = bind(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    source, out, check = shared(spark), shared(spark), shared(spark)
    events.write.parquet(source)
    last = events.agg((F.max("ts") + F.expr("INTERVAL 40000 DAYS")).alias("ts")).where("ts IS NOT NULL").select("ts", F.lit("end").alias("event_type"), F.lit(0.0).alias("value"))
    last.write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    ps.run_available(ps.window_counts(stream, "ts", ["event_type"], "1 hour", "30000 days"), out, check)
    done = spark.read.schema("start timestamp, event_type string, rows long, value double").parquet(out).where("event_type <> 'end'")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "rows", F.round("value", 4).alias("value"))


SIX_HOURS = 6 * 3_600_000_000
BINDINGS["arrivals"] = f"""SELECT event_type || '|' || CAST(s - s % {SIX_HOURS} AS VARCHAR(20)) AS group_id, CAST(user_id AS VARCHAR(20)) AS member, CAST(floor(e / 1000) AS BIGINT) AS position,
  CAST(floor((s - s % {SIX_HOURS} + {SIX_HOURS}) / 1000) AS BIGINT) AS stop, CAST(floor(value * 100) AS BIGINT) AS value FROM {{intervals}}"""
#: Micro-batches of the stream; each is a run of its own that starts from the checkpoint.
RUNS = 4


@registered("st1_late_rows", f"""WITH b AS (SELECT *, least({RUNS - 1}, CAST(floor((position - min(position) OVER ()) * {RUNS} / (max(position) OVER () - min(position) OVER () + 1)) AS INTEGER)) AS batch FROM {{arrivals}}),
c AS (SELECT batch, max(last) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS now FROM (SELECT batch, max(position) AS last FROM b GROUP BY 1)),
l AS (SELECT b.*, coalesce(stop <= now, false) AS late FROM b JOIN c ON b.batch = c.batch),
k AS (SELECT *, CASE WHEN late THEN 'late' WHEN row_number() OVER (PARTITION BY group_id, member, late ORDER BY batch, position, value) > 1 THEN 'repeated' ELSE 'group' END AS kind FROM l)
SELECT kind, group_id, CASE WHEN kind <> 'group' THEN member END AS member, CASE WHEN kind = 'group' THEN stop ELSE position END AS position, count(*) AS n, CAST(sum(value) AS BIGINT) AS value FROM k GROUP BY 1, 2, 3, 4""")
def st1_late(spark, sf_dir):
    """Events come in the order of their ends, in several runs; a window of six hours closes once a position has passed it."""
    rows = bind(spark, sf_dir, "arrivals").withColumnRenamed("stop", "end")
    source, out, check = shared(spark), shared(spark), shared(spark)
    first, last = rows.agg(F.min("position"), F.max("position")).first()
    run = F.least(F.lit(RUNS - 1), F.floor((F.col("position") - F.lit(first)) * RUNS / F.lit((last or 0) - (first or 0) + 1)).cast("int"))
    end = spark.range(1).select(F.lit("close").alias("group_id"), F.lit("").alias("member"), F.lit((last or 0) + 10**10).alias("position"), F.lit((last or 0) + 2 * 10**10).alias("end"), F.lit(0).cast("long").alias("value"))
    for k in range(RUNS + 1):
        (rows.where(run == k) if k < RUNS else end).write.mode("append").parquet(source)
        ps.run_available(ps.positional_aggregate(spark.readStream.schema(rows.schema).parquet(source)), out, check)
    return ps.totals(spark.read.schema(ps.OUT).parquet(out))
