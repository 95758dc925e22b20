"""Connected components by smallest vertex, with rounds written to the checkpoint folder."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all machines share. Only a local master, as in tests, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, prefix: str = "work") -> str:
    """A new path below the shared folder."""
    return f"{shared_base(spark)}/{prefix}-{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder that `work_dir` named, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared folder."""
    shared_base(df.sparkSession)
    return df.checkpoint(eager=True)


def follow(parents: DataFrame, vertex: str = "id", parent: str = "parent") -> DataFrame:
    """(vertex, root): each vertex's last ancestor; roots are their own parents. Paths halve every round."""
    now = written(parents.select(F.col(vertex).alias("v"), F.col(parent).alias("p")))
    while True:
        up = now.select(F.col("v").alias("p"), F.col("p").alias("g"))
        new = written(now.join(up, "p", "left").select("v", F.col("p").alias("was"), F.coalesce("g", "p").alias("p")))
        if not new.where("p <> was").limit(1).count():
            return new.select(F.col("v").alias(vertex), F.col("p").alias("root"))
        now = new.select("v", "p")


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for the vertices of edges (a, b)."""
    both = written(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"))))
    roots = written(both.groupBy("v").agg(F.least("v", F.min("w")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("v").alias("w"), F.col("root").alias("r")), "w").groupBy("v").agg(F.min("r").alias("r"))
        lower = roots.join(near, "v").select("v", F.col("root").alias("was"), F.least("root", "r").alias("root"))
        jump = roots.select(F.col("v").alias("root"), F.col("root").alias("up"))
        new = written(lower.join(jump, "root", "left").select("v", "was", F.least("root", F.coalesce("up", "root")).alias("root")))
        if not new.where("was <> root").limit(1).count():
            return new.select("v", "root")
        roots = new.select("v", "root")


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """df with the 0-based place of each row by `order`: ranges are sorted apart, and only their sizes meet."""
    dealt = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r["_p"], r["n"]) for r in dealt.groupBy("_p").agg(F.count("*").alias("n")).collect())
    start, rows = 0, []
    for p, n in sizes:
        rows.append((p, start))
        start += n
    before = df.sparkSession.createDataFrame(rows, "_p int, _s bigint")
    return dealt.join(F.broadcast(before), "_p").withColumn(name, F.col("_s") + F.col("_k")).drop("_p", "_k", "_s")


def counted(df: DataFrame, col: str) -> DataFrame:
    """Each different value with its number of rows n and the number _before of rows with smaller ones: counts of values are sorted, by ranges, not rows."""
    parts = written(df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).repartitionByRange(col).sortWithinPartitions(col).withColumn("_p", F.spark_partition_id()))
    start, rows = 0, []
    for p, t in sorted((r["_p"], r["t"]) for r in parts.groupBy("_p").agg(F.sum("n").alias("t")).collect()):
        rows.append((p, start))
        start += t
    before = df.sparkSession.createDataFrame(rows, "_p int, _s bigint")
    own = F.sum("n").over(Window.partitionBy("_p").orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_c", own).join(F.broadcast(before), "_p").select(col, "n", (F.col("_s") + F.col("_c") - F.col("n")).alias("_before"))


def quantiles(df: DataFrame, col: str, shares: list[float]) -> list[float] | None:
    """Exact quantiles with linear interpolation, without all values in one task; None without values."""
    rows = written(counted(df, col))
    n = rows.agg(F.sum("n")).first()[0]
    if not n:
        return None
    places = [(n - 1) * s for s in shares]
    want = sorted({k for p in places for k in (math.floor(p), math.ceil(p))})
    hit = F.lit(False)
    for k in want:
        hit = hit | ((F.col("_before") <= k) & (F.col("_before") + F.col("n") > k))
    got = rows.where(hit).collect()
    at = {k: float(r[col]) for k in want for r in got if r["_before"] <= k < r["_before"] + r["n"]}
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]
