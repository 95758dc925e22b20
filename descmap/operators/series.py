"""Time series (series_id, t, x): smoothing, velocities, spectra and cross spectra.

Rows are numbered by (series, time); windows look at runs of `BUCKET` neighbours, each with a halo of the rows
next to it, so a series of any length is dealt over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from descmap.operators.graph import numbered, written

BUCKET = 10_000


def placed(series: DataFrame) -> DataFrame:
    """series with n, the place of each row in its series."""
    rows = written(numbered(series, "series_id", "t", name="_place"))
    low = rows.groupBy("series_id").agg(F.min("_place").alias("_l"))
    return rows.join(low, "series_id").withColumn("n", F.col("_place") - F.col("_l")).drop("_place", "_l")


def _halo(rows: DataFrame, before: int, after: int) -> DataFrame:
    """rows (with n) in buckets; own is false for rows that only stand at a bucket's edge for its windows."""
    lo, hi = F.floor((F.col("n") - after) / BUCKET), F.floor((F.col("n") + before) / BUCKET)
    own = F.floor(F.col("n") / BUCKET)
    return rows.withColumn("bucket", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi))).withColumn("own", F.col("bucket") == own)


def smooth(series: DataFrame, box: int) -> DataFrame:
    """series_id, t and the boxcar mean of x; beyond the ends x is zero. Even boxes reach one further back than ahead."""
    before, after = box // 2, (box - 1) // 2
    w = Window.partitionBy("series_id", "bucket").orderBy("n").rowsBetween(-before, after)
    made = _halo(placed(series), before, after).withColumn("s", F.sum("x").over(w) / box)
    return made.where("own").select("series_id", "t", F.col("s").alias("x"))


def velocities(series: DataFrame, dt: float = 1.0, columns: tuple[str, ...] = ("x",)) -> DataFrame:
    """Without the ends: t * dt, each column less its series' mean, and its central difference v_{column}."""
    rows = placed(series)
    means = series.groupBy("series_id").agg(*[F.avg(c).alias(f"_m{c}") for c in columns])
    w = Window.partitionBy("series_id", "bucket").orderBy("n")
    both = _halo(rows, 1, 1)
    for c in ("t", *columns):
        both = both.withColumn(f"_a{c}", F.lag(c).over(w)).withColumn(f"_b{c}", F.lead(c).over(w))
    inner = both.where(F.col("own") & F.col("_at").isNotNull() & F.col("_bt").isNotNull()).join(means, "series_id")
    gap = (F.col("_bt") - F.col("_at")) * dt
    return inner.select("series_id", (F.col("t") * dt).alias("t"), *[(F.col(c) - F.col(f"_m{c}")).alias(c) for c in columns], *[((F.col(f"_b{c}") - F.col(f"_a{c}")) / gap).alias(f"v_{c}") for c in columns])


def spectrum(series: DataFrame, length: int, one_sided: bool = False, cross: str | None = None, dt: float | None = None) -> DataFrame:
    """series_id, k, omega, re and im: the mean Fourier transform (times dt) of consecutive pieces of an odd length; what is
    left at the end is not used. cross: another column y; then conj(X) Y / length * dt over pieces and half-shifted pieces.
    dt: the step of t, else that of each series' first two rows."""
    length -= length % 2 == 0
    half = length // 2
    rows = placed(series)
    step = rows.where("n < 2").groupBy("series_id").agg((F.max("t") - F.min("t")).alias("dt"))
    sizes = rows.groupBy("series_id").agg((F.floor((F.max("n") + 1) / length)).alias("pieces"))
    facts = sizes.join(step, "series_id").where("pieces > 0")
    facts = facts.withColumn("dt", F.lit(float(dt))) if dt is not None else facts
    kept = rows.join(facts, "series_id")
    piece = F.floor(F.col("n") / length)
    shifted = F.floor((F.col("n") - half) / length)
    which = F.filter(F.array(F.struct(piece.alias("p"), F.lit(0).alias("h")), F.struct(shifted.alias("p"), F.lit(1).alias("h"))) if cross else F.array(F.struct(piece.alias("p"), F.lit(0).alias("h"))), lambda s: (s["p"] >= 0) & (s["p"] < F.col("pieces") - s["h"]))
    cols = ["x", *([cross] if cross else [])]
    dealt = kept.select("series_id", "n", "pieces", "dt", *cols, F.inline(which))

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("n").to_numpy())
        a = np.fft.fft(t.column("x").to_numpy().astype(float)[order])
        if cross:
            a = np.conjugate(a) * np.fft.fft(t.column(cross).to_numpy().astype(float)[order]) / length
        a = a * t.column("dt")[0].as_py()
        a = a[: half + 1] if one_sided else a
        return pa.table({"series_id": t.column("series_id")[:1], "re": [a.real], "im": [a.imag]})

    kind = dict(series.dtypes)["series_id"]
    parts = dealt.groupBy("series_id", "p", "h").applyInArrow(lambda t: run(t), f"series_id {kind}, re array<double>, im array<double>")
    long = parts.select("series_id", F.posexplode(F.arrays_zip("re", "im")).alias("k", "v"))
    mean = long.groupBy("series_id", "k").agg(F.avg("v.re").alias("re"), F.avg("v.im").alias("im"))
    w = 2 * math.pi / (length - 1) / F.col("dt")
    omega = F.col("k") * w if one_sided else F.when(F.col("k") <= half, F.col("k") * w).otherwise(-(length - F.col("k")) * w)
    return mean.join(facts.select("series_id", "dt"), "series_id").select("series_id", "k", omega.alias("omega"), "re", "im")


def inverse(spectra: DataFrame, one_sided: bool = False, length: int | None = None) -> DataFrame:
    """series_id, k and x (re and im) of the inverse transform of spectra (series_id, k, re, im), without any dt."""

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("k").to_numpy())
        a = (t.column("re").to_numpy() + 1j * t.column("im").to_numpy())[order]
        x = np.fft.irfft(a, length or 2 * len(a) - 1) + 0j if one_sided else np.fft.ifft(a)
        return pa.table({"series_id": pa.concat_arrays([t.column("series_id")[:1].combine_chunks()] * len(x)), "k": np.arange(len(x)), "re": x.real, "im": x.imag})

    kind = dict(spectra.dtypes)["series_id"]
    return spectra.select("series_id", "k", "re", "im").groupBy("series_id").applyInArrow(lambda t: run(t), f"series_id {kind}, k bigint, re double, im double")


def derivative(spectra: DataFrame) -> DataFrame:
    """A spectrum times i omega: that of the series' derivative."""
    return spectra.withColumn("_r", -F.col("omega") * F.col("im")).withColumn("im", F.col("omega") * F.col("re")).withColumn("re", F.col("_r")).drop("_r")
