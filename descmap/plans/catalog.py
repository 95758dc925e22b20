"""The library's queries over the tables at hand, each over whole tables.

Embeddings are samples (vec_id, embedding, label); orders are frames whose lineitems are atoms; events are time series by
type. Numbers are rounded, since sums differ in their last digits by the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.functions import cell as C
from descmap.functions import kernels as K
from descmap.functions import vectors as V
from descmap.operators import cluster, density, descriptors, fit, frames, reduce, sampling, series
from descmap.operators.blocks import nearest, pair_blocks, row_sums, samples, squared_distances
from descmap.operators.graph import numbered

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), V.doubles("embedding").alias("x"), "label")


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda v: v::DOUBLE) AS x, label FROM embeddings)"
#: Ten landmarks: the sequential subset, a fixed number of rows.
LAND = "l AS (SELECT id AS j, x AS y FROM e ORDER BY id LIMIT 10)"
DOT, DIST = "list_dot_product(x, y)", "sqrt(list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
COS = f"({DOT} / sqrt(list_dot_product(x, x) * list_dot_product(y, y)))"


def _landmarks(df: DataFrame) -> DataFrame:
    return F.broadcast(sampling.sequential(df, 10).select(F.col("sample_id").alias("j"), F.col("x").alias("y")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["nearest_landmark"](spark, sf_dir)


@query(f"WITH {E}, {LAND} SELECT id AS sample_id, arg_max(j, (round({COS}, 9), -j)) AS landmark, round(max({COS}), 6) AS similarity FROM e, l GROUP BY id")
def nearest_landmark(spark, sf_dir):
    """The landmark of largest cosine, ties to the smaller id."""
    e = emb(spark, sf_dir)
    k = F.round(V.cosine(F.col("x"), F.col("y")), 9)
    best = e.crossJoin(_landmarks(e)).groupBy("sample_id").agg(F.max(F.struct(k.alias("k"), (-F.col("j")).alias("m"))).alias("b"))
    return best.select("sample_id", (-F.col("b.m")).alias("landmark"), r("b.k").alias("similarity"))


@query(f"WITH {E}, u AS (SELECT id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS d FROM e), s AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM u GROUP BY d) SELECT id AS sample_id, d::INT AS dim, round((v - m) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) + 0.0 AS z FROM u JOIN s USING (d)")
def zscore(spark, sf_dir):
    e = emb(spark, sf_dir)
    made = reduce.Scale().fit(e).transform(e)
    return made.select("sample_id", F.posexplode("z").alias("dim", "z")).select("sample_id", "dim", r("z").alias("z"))


def _row_sums(e: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, digits: int = 6) -> DataFrame:
    """Sums over all rows of what fn makes of each row and all rows, block by block."""
    rows = samples(e)
    some = pair_blocks(rows, rows, lambda a, b: pa.table({"id": a.ids, "s": row_sums(a, b, fn)}), "id bigint, s double")
    return some.groupBy("id").agg(F.sum("s").alias("s")).select(F.col("id").alias("sample_id"), r("s", digits).alias(name))


#: All pairs of vectors.
PAIRS = "p AS (SELECT a.id, b.id AS other, a.x, b.x AS y FROM e a, e b)"


@query(f"WITH {E}, {PAIRS} SELECT id AS sample_id, round(sum({DOT}), 5) + 0.0 AS k FROM p GROUP BY id")
def kernel_linear(spark, sf_dir):
    """Each row's kernel with all rows, summed."""
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.matrix({"k": {"type": "linear"}}, a, b), "k", 5)


@query(f"WITH {E}, {PAIRS} SELECT id AS sample_id, round(sum(power({DOT}, 3)), 5) + 0.0 AS k FROM p GROUP BY id")
def kernel_polynomial(spark, sf_dir):
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.matrix({"k": {"type": "polynomial", "d": 3}}, a, b), "k", 5)


@query(f"WITH {E}, {PAIRS} SELECT id AS sample_id, round(sum({COS}), 5) + 0.0 AS k FROM p GROUP BY id")
def kernel_cosine(spark, sf_dir):
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.matrix({"k": {"type": "cosine"}}, a, b), "k", 5)


@query(f"WITH {E}, {PAIRS} SELECT id AS sample_id, round(sum({DOT} + power({DOT}, 2)), 5) + 0.0 AS k FROM p GROUP BY id")
def kernel_sum(spark, sf_dir):
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.matrix({"a": {"type": "linear"}, "b": {"type": "polynomial", "d": 2}}, a, b), "k", 5)


@query(
    """WITH g AS (SELECT least(l_partkey % 40, l_suppkey % 40) AS i, greatest(l_partkey % 40, l_suppkey % 40) AS j, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), f AS (SELECT i, j, q FROM g UNION ALL SELECT j, i, q FROM g WHERE i < j), d AS (SELECT i, 2000 + sum(q) AS s FROM f GROUP BY i),
k AS (SELECT f.i, f.j, least(1.0, CASE WHEN f.i = f.j THEN a.s ELSE q END / sqrt(a.s * b.s)) AS k FROM f JOIN d a ON a.i = f.i JOIN d b ON b.i = f.j) SELECT i, j, round(k, 6) + 0.0 AS k, round(sqrt(greatest(2 - 2 * round(k, 9), 0)), 6) AS distance, round(greatest(1 - k, 0), 6) AS linear_distance FROM k"""
)
def kernel_distance(spark, sf_dir):
    """A kernel table from sums over all lineitems, normalised by its diagonal, and its distances."""
    a, b = F.col("l_partkey") % 40, F.col("l_suppkey") % 40
    l = load(spark, sf_dir, "lineitem").groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.sum("l_quantity").alias("q"))
    both = l.unionByName(l.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), "q"))
    d = both.groupBy("i").agg((2000 + F.sum("q")).alias("s"))
    k = both.join(d, "i").join(d.select(F.col("i").alias("j"), F.col("s").alias("t")), "j")
    k = k.select("i", "j", K.normalised(F.when(F.col("i") == F.col("j"), F.col("s")).otherwise(F.col("q")), F.col("s"), F.col("t")).alias("k"))
    return k.select("i", "j", r("k").alias("k"), r(K.to_distance(F.round("k", 9))).alias("distance"), r(K.to_linear_distance(F.col("k"))).alias("linear_distance"))


@query(f"WITH {E} SELECT a.id AS sample_id, round(sum(exp((list_dot_product(a.x, b.x) - 1) / 0.2)), 6) AS rho FROM e a, e b GROUP BY a.id")
def kernel_rho(spark, sf_dir):
    """Row sums over all pairs, block by block."""
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.rho_of_kernel(K.matrix({"k": {"type": "linear"}}, a, b), 0.2), "rho")


@query(f"WITH {E}, p AS (SELECT a.id, a.x, b.x AS y FROM e a, e b) SELECT id AS sample_id, round(sum(exp(-{DIST} / 0.2)), 4) AS rho FROM p GROUP BY id")
def distance_rho(spark, sf_dir):
    return _row_sums(emb(spark, sf_dir), lambda a, b: K.rho_of_distance(np.sqrt(squared_distances(a, b)), 0.2), "rho", 4)


@query(f"WITH {E}, p AS (SELECT a.id, b.id AS other, a.x, b.x AS y FROM e a, e b), d AS (SELECT id, other, CASE WHEN id = other THEN 0 ELSE {DIST} END AS d FROM p) SELECT id AS sample_id, (row_number() OVER (PARTITION BY id ORDER BY d, other) - 1)::INT AS rank, round(d, 5) AS distance FROM d QUALIFY rank < 5")
def knn(spark, sf_dir):
    rows = samples(emb(spark, sf_dir))
    return nearest(rows, rows, 5).select(F.col("id").alias("sample_id"), "rank", r("distance", 5).alias("distance"))


_DB = f"""WITH RECURSIVE {E}, p AS (SELECT a.id, b.id AS other, a.x, b.x AS y FROM e a, e b), near AS (SELECT id, other FROM p WHERE id = other OR {DIST} <= 0.8),
core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 5), edge AS (SELECT id AS a, other AS b FROM near WHERE id IN (SELECT id FROM core) AND other IN (SELECT id FROM core)),
reach AS (SELECT id AS v, id AS r FROM core UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.v), root AS (SELECT v AS id, min(r) AS r FROM reach GROUP BY v),
number AS (SELECT id, dense_rank() OVER (ORDER BY r) - 1 AS n FROM root)
SELECT e.id AS sample_id, coalesce((SELECT min(n) FROM number WHERE number.id = e.id), (SELECT min(n) FROM near JOIN number ON near.other = number.id WHERE near.id = e.id), -1)::INT AS cluster_label FROM e"""


@query(_DB)
def dbscan(spark, sf_dir):
    return cluster.dbscan(emb(spark, sf_dir), 0.8, 5)


@query(_DB.replace("<= 0.8)", "<= 1.15)"))
def dbscan_wide(spark, sf_dir):
    """At this radius the tables have core rows; at that of `dbscan` all rows are noise."""
    return cluster.dbscan(emb(spark, sf_dir), 1.15, 5)


@query(
    f"WITH {E}, q AS (SELECT id, x FROM e ORDER BY ('0x' || substr(md5('0:' || id), 1, 13))::BIGINT, id LIMIT 50), p AS (SELECT q.x, e.x AS y, q.id = e.id AS same FROM q, e), d AS (SELECT CASE WHEN same THEN 0 ELSE {DIST} END AS d FROM p), o AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS k, (count(*) OVER () - 1) * 10.0 / (SELECT count(*) FROM e) AS place FROM d) SELECT round(max(d) FILTER (k = floor(place)) + any_value(place - floor(place)) * (max(d) FILTER (k = ceil(place)) - max(d) FILTER (k = floor(place))), 5) AS eps FROM o"
)
def dbscan_auto_eps(spark, sf_dir):
    """The number of probes, 50, is the operator's own."""
    return spark.createDataFrame([(round(cluster.auto_eps(emb(spark, sf_dir)), 5),)], "eps double")


@query()
def density_peaks(spark, sf_dir):
    got = cluster.DensityPeaks(2.0).fit(emb(spark, sf_dir))
    return got.select("sample_id", "rho", r("delta", 5).alias("delta"), "cluster", "cluster_label")


@query(
    f"""WITH {E}, p AS (SELECT a.id, a.label AS l, b.label AS m, b.id AS o, a.x, b.x AS y FROM e a, e b), d AS (SELECT id, l, m, sum(CASE WHEN id = o THEN 0 ELSE {DIST} END) AS s, count(*) AS n FROM p GROUP BY ALL),
t AS (SELECT id, max(CASE WHEN l = m THEN n END) AS n, max(CASE WHEN l = m AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN l <> m THEN s / n END) AS b FROM d GROUP BY id)
SELECT id AS sample_id, round(CASE WHEN n = 1 OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END, 5) + 0.0 AS silhouette FROM t"""
)
def silhouette(spark, sf_dir):
    return cluster.silhouette(emb(spark, sf_dir), "label").select("sample_id", r("silhouette", 5).alias("silhouette"))


def _kde(name: str, inner: str, h: float) -> None:
    d = 64
    norm = density.log_normaliser(name, h, d)
    sql = f"""WITH {E}, p AS (SELECT a.id, {"CASE WHEN a.id = b.id THEN 0 ELSE " + DIST.replace("(x, y)", "(a.x, b.x)") + " END"} / {h} AS t FROM e a, e b), s AS (SELECT id, sum({inner}) AS s, count(*) AS n FROM p GROUP BY id)
    SELECT id AS sample_id, round(ln(s / n) - ({norm!r}), 5) + 0.0 AS log_density FROM s"""

    def fn(spark, sf_dir):
        return density.kde(emb(spark, sf_dir), h, name).select("sample_id", r("log_density", 5).alias("log_density"))

    fn.__name__ = f"kde_{name}"
    query(sql)(fn)


_kde("gaussian", "exp(-0.5 * t * t)", 0.5)
_kde("exponential", "exp(-t)", 0.5)
_kde("tophat", "CASE WHEN t < 1 THEN 1 ELSE 0 END", 1.2)
_kde("epanechnikov", "CASE WHEN t < 1 THEN 1 - t * t ELSE 0 END", 1.2)
_kde("linear", "CASE WHEN t < 1 THEN 1 - t ELSE 0 END", 1.2)
_kde("cosine", "CASE WHEN t < 1 THEN cos(pi() * t / 2) ELSE 0 END", 1.2)


@query(
    f"""WITH {E}, q AS (SELECT id, x[1] AS a, x[2] AS b FROM e), m AS (SELECT count(*) AS n, var_samp(a) * power(count(*), -1.0 / 3) AS va, var_samp(b) * power(count(*), -1.0 / 3) AS vb, covar_samp(a, b) * power(count(*), -1.0 / 3) AS c FROM q),
p AS (SELECT u.id, exp(-0.5 * (vb * (u.a - v.a) * (u.a - v.a) - 2 * c * (u.a - v.a) * (u.b - v.b) + va * (u.b - v.b) * (u.b - v.b)) / (va * vb - c * c)) AS k FROM q u, q v, m)
SELECT id AS sample_id, round(ln(sum(k) / any_value(n)) - ln(2 * pi()) - 0.5 * ln(any_value(va * vb - c * c)), 5) + 0.0 AS log_density FROM p, m GROUP BY id"""
)
def kde_scott(spark, sf_dir):
    """Full covariance, over the leading two components."""
    e = emb(spark, sf_dir).withColumn("x", V.leading(F.col("x"), 2))
    return density.kde_full(e).select("sample_id", r("log_density", 5).alias("log_density"))


@query()
def kde_best_bandwidth(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("x", V.leading(F.col("x"), 2))
    return density.BestBandwidth().fit(e).evaluate().select("sample_id", r("log_density", 4).alias("log_density"))


@query(
    f"""WITH RECURSIVE {E}, step AS (SELECT 0 AS k, id, x, 1e300::DOUBLE AS d FROM e UNION ALL
SELECT k + 1, s.id, s.x, least(s.d, list_sum(list_transform(list_zip(s.x, b.y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) FROM (SELECT *, CASE WHEN k = 0 THEN min(id) OVER () ELSE first_value(id) OVER (ORDER BY d DESC, id) END AS pick, FROM step WHERE k < 10) s JOIN (SELECT id AS bid, x AS y FROM e) b ON b.bid = s.pick)
SELECT (k + 1)::INT AS place, CASE WHEN k = 0 THEN min(id) ELSE arg_max(id, (d, -id)) END AS sample_id, CASE WHEN k = 0 THEN NULL ELSE round(max(d), 6) END AS gap FROM step WHERE k < 10 GROUP BY k"""
)
def farthest_points(spark, sf_dir):
    """Ten points, a number the operator is given."""
    got = sampling.farthest_points(emb(spark, sf_dir), 10)
    rows = [(k + 1, i, None if math.isinf(d) else round(d, 6)) for k, (i, d) in enumerate(got)]
    return spark.createDataFrame(rows, "place int, sample_id bigint, gap double")


@query()
def cur_rows(spark, sf_dir):
    got = sampling.cur_rows(emb(spark, sf_dir), 10)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(got)], "place int, sample_id bigint")


@query()
def cur_columns(spark, sf_dir):
    got = sampling.cur_columns(emb(spark, sf_dir), 10)
    return spark.createDataFrame([(k + 1, i) for k, i in enumerate(got)], "place int, col int")


def DRAW(c: str, seed="0") -> str:
    return f"('0x' || substr(md5('{seed}:' || {c}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0"


@query(f"SELECT vec_id AS sample_id FROM embeddings WHERE {DRAW('vec_id')} < 0.1")
def random_subset(spark, sf_dir):
    return sampling.random(emb(spark, sf_dir), 0.1).select("sample_id")


@query("SELECT vec_id AS sample_id FROM embeddings ORDER BY vec_id LIMIT 25")
def sequential_subset(spark, sf_dir):
    """The first 25, a number the operator is given."""
    return sampling.sequential(emb(spark, sf_dir), 25).select("sample_id")


@query(f"WITH d AS (SELECT vec_id, embedding[1]::DOUBLE AS l FROM embeddings), w AS (SELECT vec_id, exp(l / 2 - l) AS w FROM d) SELECT vec_id AS sample_id FROM w WHERE {DRAW('vec_id')} < w * 50 / (SELECT sum(w) FROM w)")
def reweighted_subset(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("logd", F.get("x", F.lit(0)))
    return sampling.reweight(e, "logd", 50, 2.0).select("sample_id")


@query(f"SELECT l_orderkey, l_linenumber, {DRAW('(l_orderkey * 8 + l_linenumber)', 42)} < 0.05 AS is_test FROM lineitem")
def split_random(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"))
    return sampling.random_split(l, 0.05, seed=42).select("l_orderkey", "l_linenumber", "is_test")


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey AS sample_id, (CASE WHEN k < (n % 5) * (n // 5 + 1) THEN k // (n // 5 + 1) ELSE (k - (n % 5) * (n // 5 + 1)) // (n // 5) + n % 5 END)::INT AS fold FROM n")
def split_folds(spark, sf_dir):
    return sampling.k_fold(load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id")), 5)


@query(f"SELECT split::INT AS split, vec_id AS sample_id, {DRAW('split || chr(58) || vec_id')} < 0.2 AS is_test FROM embeddings, range(3) t(split)")
def split_shuffled(spark, sf_dir):
    return sampling.shuffle_split(emb(spark, sf_dir), 3, 0.2).select("split", "sample_id", "is_test")


@query(
    " UNION ALL ".join(f"SELECT {s} AS size, {q} AS repeat, id FROM (SELECT vec_id AS id FROM embeddings ORDER BY {DRAW('vec_id', f'0/{q}')}, vec_id LIMIT {s})" for s in (20, 60) for q in (0, 1))
)
def split_learning_curve(spark, sf_dir):
    return sampling.learning_curve_split(emb(spark, sf_dir), [20, 60], 2).select("size", "repeat", "id")


@query("SELECT (k + 1)::INT AS place, CASE WHEN k = 0 THEN 20 WHEN k = 7 THEN n ELSE trunc(exp(ln(20) + k * (ln(n) - ln(20)) / 7))::BIGINT END AS size FROM range(8) t(k), (SELECT count(*) AS n FROM orders)")
def split_sizes(spark, sf_dir):
    got = sampling.exponential_split(20, load(spark, sf_dir, "orders").count(), 8)
    return spark.createDataFrame(list(enumerate(got, 1)), "place int, size bigint")


@query("SELECT o_orderpriority, count(*) AS size FROM orders GROUP BY 1")
def cluster_sizes(spark, sf_dir):
    return cluster.sizes(load(spark, sf_dir, "orders"), "o_orderpriority")


@query("WITH m AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), o AS (SELECT l_returnflag, arg_max(l_quantity, (n, -l_quantity)) AS md FROM m GROUP BY 1) SELECT l_returnflag, round(avg(l_extendedprice), 4) AS mean, round(sum(l_quantity), 2) AS sum, min(l_tax) AS min, max(l_discount) AS max, any_value(md) AS mode FROM lineitem JOIN o USING (l_returnflag) GROUP BY 1")
def cluster_properties(spark, sf_dir):
    l, k = load(spark, sf_dir, "lineitem"), "l_returnflag"
    parts = [cluster.properties(l, c, how, k).withColumnRenamed(c, how) for c, how in (("l_extendedprice", "mean"), ("l_quantity", "sum"), ("l_tax", "min"), ("l_discount", "max"), ("l_quantity", "mode"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, k)
    return out.select(k, r("mean", 4).alias("mean"), r("sum", 2).alias("sum"), "min", "max", "mode")


@query("SELECT c_nationkey, round(sum(c_acctbal * c_custkey) / sum(c_custkey), 4) AS c_acctbal FROM customer GROUP BY 1")
def cluster_weighted(spark, sf_dir):
    return cluster.weighted_average(load(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", "c_nationkey").select("c_nationkey", r("c_acctbal", 4).alias("c_acctbal"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS lo, quantile_cont(o_totalprice, 0.95) AS hi FROM orders) SELECT o_orderkey, o_totalprice FROM orders, q WHERE o_totalprice <= lo OR o_totalprice >= hi")
def outliers(spark, sf_dir):
    return frames.outer_rows(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.05)


@query(
    """WITH v AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), k AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM v)
SELECT round(avg(abs(p - y)), 4) AS MAE, round(sqrt(avg((p - y) * (p - y))), 4) AS RMSE, round(max(abs(p - y)), 4) AS SUP, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS R2, round(corr(y, p), 6) AS CORR, round(corr(ry, rp), 6) AS SPEARMAN FROM k"""
)
def fit_metrics(spark, sf_dir):
    m = fit.metrics(load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("y_pred")))
    return m.select(*[r(c, 4).alias(c) for c in ("MAE", "RMSE", "SUP")], *[r(c, 6).alias(c) for c in ("R2", "CORR", "SPEARMAN")])


@query(
    """WITH s AS (SELECT sum(l_quantity * l_quantity) + 0.01 AS a, sum(l_quantity) AS b, count(*) + 0.01 AS d, sum(l_quantity * l_extendedprice) AS u, sum(l_extendedprice) AS v FROM lineitem)
SELECT 0 AS k, round((d * u - b * v) / (a * d - b * b), 4) AS w FROM s UNION ALL SELECT 1, round((a * v - b * u) / (a * d - b * b), 4) FROM s"""
)
def fit_ridge(spark, sf_dir):
    """Price by quantity and a bias, both penalised."""
    l = load(spark, sf_dir, "lineitem").select(F.array("l_quantity", F.lit(1.0)).alias("x"), F.col("l_extendedprice").alias("y"))
    w = fit.Ridge(0.01).fit(l).weights
    return spark.createDataFrame([(k, round(float(v), 4)) for k, v in enumerate(w)], "k int, w double")


def _priced(spark, sf_dir) -> DataFrame:
    l = load(spark, sf_dir, "lineitem")
    return l.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_id"), F.array("l_quantity", "l_discount", "l_tax", F.col("l_linenumber").cast("double")).alias("x"), F.col("l_extendedprice").alias("y"))


@query()
def fit_ridge_curve(spark, sf_dir):
    """Learning curve of ridge on lineitem."""
    d = fit.DesignMatrix(_priced(spark, sf_dir), test_ratio=0.1)
    got = d.learning_curve(fit.Ridge(1e-4), points=3, repeats=2)
    return spark.createDataFrame([(g["size"], round(g["MAE"], 4), round(g["RMSE"], 4), round(g["R2"], 6)) for g in got], "size bigint, mae double, rmse double, r2 double")


@query()
def fit_sparse_kernel_ridge(spark, sf_dir):
    e = emb(spark, sf_dir).withColumn("y", F.col("label").cast("double"))
    m = fit.SparseKernelRidge(n_sparse=32, kernel={"k": {"type": "polynomial", "d": 2}}).fit(e)
    return m.predict(e).select("sample_id", r("y_pred", 4).alias("y_pred"))


@query()
def pca(spark, sf_dir):
    e = emb(spark, sf_dir)
    return reduce.PCA(10).fit(e).transform(e).select("sample_id", F.transform("pca", lambda v: F.round(v, 5)).alias("pca"))


@query()
def sparse_kernel_pca(spark, sf_dir):
    e = emb(spark, sf_dir)
    return reduce.SparseKernelPCA(4, 50, kernel={"k": {"type": "polynomial", "d": 2}}).fit(e).transform(e).select("sample_id", F.transform("skpca", lambda v: F.round(v, 4)).alias("skpca"))


@query()
def reducer_pipeline(spark, sf_dir):
    spec = {"pre": {"type": "SCALE"}, "skpca": {"type": "SPARSE_KPCA", "parameter": {"n_components": 5, "n_sparse": 50}}}
    return reduce.Pipeline(spec).fit_transform(emb(spark, sf_dir)).select("sample_id", F.transform("reduced", lambda v: F.round(v, 4)).alias("reduced"))


@query(f"WITH {E}, u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS d FROM e) SELECT label, d::INT AS dim, round(avg(v), 6) + 0.0 AS average, round(sum(v), 5) + 0.0 AS total, round(avg(v * v), 6) AS moment FROM u GROUP BY ALL")
def reducers(spark, sf_dir):
    """Average, sum and second moment of each group's vectors."""
    e = emb(spark, sf_dir)
    width = e.select(F.max(F.size("x"))).first()[0]
    a, s, m = (frames.reduce_rows(e, "label", "x", width, kind, 2.0, name) for kind, name in (("average", "a"), ("sum", "s"), ("moment_average", "m")))
    both = a.join(s, "label").join(m, "label").select("label", F.posexplode(F.arrays_zip("a", "s", "m")).alias("dim", "v"))
    return both.select("label", "dim", r("v.a").alias("average"), r("v.s", 5).alias("total"), r("v.m").alias("moment"))


def order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as frames, their lineitems as atoms (seven at most)."""
    l = load(spark, sf_dir, "lineitem")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")

    def atom(a: Column, k: Column) -> Column:
        arrays = F.create_map(F.lit("charge"), F.array(a["l_tax"]), F.lit("vector"), F.array(a["l_discount"], a["l_tax"], a["l_quantity"]))
        pos = F.array(a["l_extendedprice"] / 1000, a["l_discount"] * 100, a["l_tax"] * 100 + a["l_linenumber"])
        return F.struct(k.alias("idx"), a["l_returnflag"].alias("symbol"), (a["l_quantity"].cast("int") % 5 + 1).alias("z"), pos.alias("pos"), arrays.alias("arrays"))

    rows = l.select("l_orderkey", row.alias("a")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("a")).alias("rows"))
    atoms = rows.select("l_orderkey", F.transform("rows", atom).alias("atoms"))
    o = load(spark, sf_dir, "orders").join(atoms, F.col("o_orderkey") == F.col("l_orderkey"))
    edge = F.col("o_totalprice") / 1000 + 1
    cell = F.array(F.array(edge, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), edge, F.lit(0.0)), F.array(F.lit(0.25), F.lit(0.5), edge))
    return o.select(
        F.col("o_orderkey").alias("frame_id"), F.lit("orders").alias("source"), F.col("o_orderkey").alias("ordinal"), F.size("atoms").alias("natoms"), cell.alias("cell"), F.array(*[F.lit(False)] * 3).alias("pbc"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("info"), F.create_map(F.lit("total"), F.col("o_totalprice")).alias("props"), F.create_map(F.lit("pca-d-2"), F.array(F.col("o_totalprice"), F.col("o_custkey").cast("double"))).alias("desc"), "atoms",
    )


_ATOMS = "a AS (SELECT l_orderkey AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS i, (l_quantity::INT % 5 + 1) AS z, l_extendedprice / 1000 AS x, l_discount * 100 AS y, l_tax * 100 + l_linenumber AS w, l_tax, l_discount, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


@query(f"WITH {_ATOMS}, c AS (SELECT f, count(*) AS n FROM a GROUP BY f) SELECT (SELECT count(*) FROM c) AS nframes, (SELECT sum(n)::BIGINT FROM c) AS total_natoms, (SELECT max(n)::INT FROM c) AS max_atoms, (SELECT array_to_string(list_sort(list(DISTINCT z)), ',') FROM a) AS global_species")
def frame_counters(spark, sf_dir):
    c = frames.counters(order_frames(spark, sf_dir))
    return c.select("nframes", "total_natoms", "max_atoms", F.array_join(F.transform("global_species", lambda z: z.cast("string")), ",").alias("global_species"))


@query(f"WITH {_ATOMS} SELECT f AS frame_id, count(*) FILTER (z = 3)::INT AS n FROM a GROUP BY f")
def species_counts(spark, sf_dir):
    return order_frames(spark, sf_dir).select("frame_id", frames.species_count(3).alias("n"))


@query(f"WITH {_ATOMS}, c AS (SELECT f, count(*) AS n, sum(l_tax) AS t FROM a GROUP BY f) SELECT f AS frame_id, round(power(o_totalprice / 1000 + 1, 3) / n, 4) AS volume, n::DOUBLE AS size, round(o_totalprice / n, 6) AS total, round(t / n, 6) AS charge FROM c JOIN orders ON f = o_orderkey")
def frame_properties(spark, sf_dir):
    """Volume for each atom, size, an extensive number of the frame, and the mean of the atoms' array."""
    f = order_frames(spark, sf_dir)
    get = lambda key, name, ext=False: frames.property_of(f, key, ext).select(F.col("sample_id").alias("frame_id"), F.col("y").alias(name))
    out = get("volume", "volume").join(get("size", "size"), "frame_id").join(get("total", "total", True), "frame_id").join(get("charge", "charge"), "frame_id")
    return out.select("frame_id", r("volume", 4).alias("volume"), "size", r("total").alias("total"), r("charge").alias("charge"))


@query("SELECT o_orderkey AS sample_id, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def descriptor_selection(spark, sf_dir):
    return frames.design_matrix(order_frames(spark, sf_dir), ["pca*"]).select("sample_id", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))


@query(f"WITH {_ATOMS} SELECT a.f AS frame_id, a.i::INT AS i, b.i::INT AS j, round(CASE WHEN a.i = b.i THEN 0.5 * power(a.z, 2.4) ELSE a.z * b.z / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.w - b.w) * (a.w - b.w)) END, 6) AS m FROM a JOIN a b ON a.f = b.f")
def coulomb_matrix(spark, sf_dir):
    a = frames.atoms(order_frames(spark, sf_dir)).select("frame_id", F.col("atom_idx").alias("idx"), "z", F.col("pos")[0].alias("x"), F.col("pos")[1].alias("y"), F.col("pos")[2].alias("zpos"))
    return descriptors.coulomb_sql(a).select("frame_id", "i", "j", r("m").alias("m"))


@query(
    f"""WITH {_ATOMS}, p AS (SELECT a.f, a.i, b.z, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.w - b.w) * (a.w - b.w)) AS d FROM a JOIN a b ON a.f = b.f AND a.i <> b.i),
g AS (SELECT f, i, z, sum(exp(-0.1 * (d - 2) * (d - 2)) * 0.5 * (cos(pi() * d / 12) + 1)) AS g FROM p WHERE d < 12 GROUP BY ALL)
SELECT a.f AS frame_id, a.i::INT AS atom_idx, s::INT AS z, round(coalesce(g.g, 0), 6) AS g2 FROM a CROSS JOIN range(1, 6) t(s) LEFT JOIN g ON g.f = a.f AND g.i = a.i AND g.z = s"""
)
def symmetry_functions(spark, sf_dir):
    """The radial function (eta 0.1, Rs 2) of every atom and species."""
    rows = descriptors.atomic_rows(order_frames(spark, sf_dir), {"a": {"type": "ACSF", "cutoff": 12.0, "species": [1, 2, 3, 4, 5], "g2_params": [[0.1, 2.0]]}})
    rows = rows.select("frame_id", "atom_idx", F.posexplode("x").alias("k", "v")).where("k % 2 = 1")
    return rows.select("frame_id", "atom_idx", (F.floor(F.col("k") / 2) + 1).cast("int").alias("z"), r("v").alias("g2"))


@query()
def soap_average(spark, sf_dir):
    """Mean power spectrum of every frame."""
    f = order_frames(spark, sf_dir)
    made = descriptors.frame_rows(f, {"a": {"type": "SOAP", "species": [1, 2, 3, 4, 5], "cutoff": 6.0, "n": 3, "l": 2, "sigma": 0.8}})
    return made.select("frame_id", F.transform("x", lambda v: F.round(v, 4)).alias("soap"))


@query(f"WITH {_ATOMS} SELECT f AS frame_id, s::INT AS z, round(coalesce(avg(l_quantity) FILTER (z = s), 0), 6) AS quantity FROM a CROSS JOIN range(1, 6) t(s) GROUP BY f, s")
def reducer_by_species(spark, sf_dir):
    """Element-wise average of the atoms' vectors (its third component), zeros for absent species."""
    f = frames.reduce_atoms(order_frames(spark, sf_dir), "vector", {"type": "average", "element_wise": True}, [1, 2, 3, 4, 5])
    rows = f.select("frame_id", F.posexplode(F.col("desc")["vector-e"]).alias("k", "v")).where("k % 3 = 2")
    return rows.select("frame_id", (F.floor(F.col("k") / 3) + 1).cast("int").alias("z"), r("v").alias("quantity"))


@query(
    """WITH c AS (SELECT o_orderkey AS id, o_totalprice / 1000 + 1 AS a, o_custkey % 90 + 10.0 AS b, 20.0 AS c, radians(60 + o_orderkey % 30) AS al, radians(90.0) AS be, radians(70 + o_custkey % 40) AS ga FROM orders),
h AS (SELECT id, a, b * cos(ga) AS bx, b * sin(ga) AS bz, c * cos(be) AS cx, (b * c * cos(al) - b * cos(ga) * c * cos(be)) / (b * sin(ga)) AS cy, c FROM c)
SELECT id AS frame_id, round(bx, 6) + 0.0 AS bx, round(cy, 6) + 0.0 AS cy, round(sqrt(c * c - cx * cx - cy * cy), 6) AS cz, round(a * bz * sqrt(c * c - cx * cx - cy * cy), 3) AS volume FROM h"""
)
def cell_from_lengths(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    h = C.from_lengths(F.col("o_totalprice") / 1000 + 1, F.col("o_custkey") % 90 + F.lit(10.0), F.lit(20.0), 60 + F.col("o_orderkey") % 30, F.lit(90.0), 70 + F.col("o_custkey") % 40, degrees=True)
    return o.select(F.col("o_orderkey").alias("frame_id"), h.alias("h")).select("frame_id", r(F.col("h")[0][1]).alias("bx"), r(F.col("h")[1][2]).alias("cy"), r(F.col("h")[2][2]).alias("cz"), r(C.volume(F.col("h")), 3).alias("volume"))


@query(
    """WITH e AS (SELECT o_orderkey AS id, o_totalprice / 1000 + 1 AS e FROM orders), n AS (SELECT id, e AS a, sqrt(0.25 + e * e) AS b, sqrt(0.0625 + 0.25 + e * e) AS c, 0.125 + 0.5 * e AS bc, 0.25 * e AS ac, 0.5 * e AS ab FROM e)
SELECT id AS frame_id, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(degrees(acos(bc / (b * c))), 5) AS alpha, round(degrees(acos(ac / (a * c))), 5) AS beta, round(degrees(acos(ab / (a * b))), 5) AS gamma FROM n"""
)
def cell_lengths_angles(spark, sf_dir):
    edge = F.col("o_totalprice") / 1000 + 1
    h = F.array(F.array(edge, F.lit(0.0), F.lit(0.0)), F.array(F.lit(0.5), edge, F.lit(0.0)), F.array(F.lit(0.25), F.lit(0.5), edge))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("frame_id"), h.alias("h"))
    return o.select("frame_id", *[r(c).alias(n) for n, c in zip("abc", C.lengths(F.col("h")), strict=True)], *[r(c, 5).alias(n) for n, c in zip(("alpha", "beta", "gamma"), C.angles(F.col("h"), True), strict=True)])


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("event_id").cast("double").alias("t"), F.col("value").alias("x"), (F.col("user_id") % 7).cast("double").alias("y"))


_S = "s AS (SELECT event_type AS series_id, event_id::DOUBLE AS t, value AS x, (user_id % 7)::DOUBLE AS y, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events)"


@query(f"WITH {_S} SELECT series_id, t, round(sum(x) OVER (PARTITION BY series_id ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) + 0.0 AS x FROM s")
def series_smooth(spark, sf_dir):
    return series.smooth(events_series(spark, sf_dir), 10).select("series_id", "t", r("x").alias("x"))


@query(f"WITH {_S}, v AS (SELECT series_id, t, x - avg(x) OVER (PARTITION BY series_id) AS x, lag(x) OVER w AS a, lead(x) OVER w AS b, lag(t) OVER w AS c, lead(t) OVER w AS d FROM s WINDOW w AS (PARTITION BY series_id ORDER BY n)) SELECT series_id, t, round(x, 6) + 0.0 AS x, round((b - a) / (d - c), 6) + 0.0 AS v_x FROM v WHERE c IS NOT NULL AND d IS NOT NULL")
def series_velocity(spark, sf_dir):
    return series.velocities(events_series(spark, sf_dir)).select("series_id", "t", r("x").alias("x"), r("v_x").alias("v_x"))


_L = 51
_DFT = f"""WITH {_S}, z AS (SELECT series_id, count(*) // {_L} AS pieces FROM s GROUP BY 1), p AS (SELECT s.*, n // {_L} AS p, n % {_L} AS m FROM s JOIN z USING (series_id) WHERE n // {_L} < pieces),
f AS (SELECT series_id, p, k, sum(x * cos(2 * pi() * k * m / {_L})) AS re, -sum(x * sin(2 * pi() * k * m / {_L})) AS im FROM p, range({{top}}) t(k) GROUP BY ALL)"""


@query(_DFT.format(top=_L) + f" SELECT series_id, k::INT AS k, round(CASE WHEN k <= {_L // 2} THEN k ELSE k - {_L} END * 2 * pi() / {_L - 1}, 6) + 0.0 AS omega, round(avg(re), 5) + 0.0 AS re, round(avg(im), 5) + 0.0 AS im FROM f GROUP BY series_id, k")
def series_spectrum(spark, sf_dir):
    return series.spectrum(events_series(spark, sf_dir), _L + 1, dt=1.0).select("series_id", "k", r("omega").alias("omega"), r("re", 5).alias("re"), r("im", 5).alias("im"))


@query(_DFT.format(top=_L // 2 + 1) + f" SELECT series_id, k::INT AS k, round(k * 2 * pi() / {_L - 1}, 6) + 0.0 AS omega, round(avg(re), 5) + 0.0 AS re, round(avg(im), 5) + 0.0 AS im FROM f GROUP BY series_id, k")
def series_spectrum_one_sided(spark, sf_dir):
    return series.spectrum(events_series(spark, sf_dir), _L, True, dt=1.0).select("series_id", "k", r("omega").alias("omega"), r("re", 5).alias("re"), r("im", 5).alias("im"))


@query(
    f"""WITH {_S}, z AS (SELECT series_id, count(*) // {_L} AS pieces FROM s GROUP BY 1), p AS (SELECT s.*, n // {_L} AS p, n % {_L} AS m, 0 AS h FROM s JOIN z USING (series_id) WHERE n // {_L} < pieces
UNION ALL SELECT s.*, (n - {_L // 2}) // {_L} AS p, (n - {_L // 2}) % {_L} AS m, 1 AS h FROM s JOIN z USING (series_id) WHERE n >= {_L // 2} AND (n - {_L // 2}) // {_L} < pieces - 1),
f AS (SELECT series_id, p, h, k, sum(x * cos(2 * pi() * k * m / {_L})) AS xr, -sum(x * sin(2 * pi() * k * m / {_L})) AS xi, sum(y * cos(2 * pi() * k * m / {_L})) AS yr, -sum(y * sin(2 * pi() * k * m / {_L})) AS yi FROM p, range({_L}) t(k) GROUP BY ALL)
SELECT series_id, k::INT AS k, round(avg(xr * yr + xi * yi) / {_L}, 5) + 0.0 AS re, round(avg(xr * yi - xi * yr) / {_L}, 5) + 0.0 AS im FROM f GROUP BY series_id, k"""
)
def series_cross_spectrum(spark, sf_dir):
    return series.spectrum(events_series(spark, sf_dir), _L, cross="y", dt=1.0).select("series_id", "k", r("re", 5).alias("re"), r("im", 5).alias("im"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS number FROM supplier")
def row_numbers(spark, sf_dir):
    """The place of each row without a single sort of all."""
    return numbered(load(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").select("s_suppkey", "number")
