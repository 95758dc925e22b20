"""Six verbs over frames: gen_desc, map, cluster, fit, kde, select.

    python -m descmap.cli select --fxyz 'data/*.xyz' --dm 'SOAP*' --algorithm fps --nkeep 100 --prefix out

Every verb reads frames (or a text matrix), works on DataFrames, and writes below a prefix.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap import hypers
from descmap.functions import kernels
from descmap.operators import cluster, density, descriptors, fit, frames, reduce, sampling
from descmap.operators.colours import colours
from descmap.operators.graph import numbered
from descmap.sources import extxyz, tables


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="descmap", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.add_argument("--fxyz", help="file or glob of frames")
        v.add_argument("--matrix", help="text matrix instead of descriptors of frames")
        v.add_argument("--dm", nargs="+", default=["*"], help="descriptors: names, X* or *")
        v.add_argument("--stride", type=int, default=1)
        v.add_argument("--no-periodic", action="store_true")
        v.add_argument("--format", default="extxyz", choices=["extxyz", "xyz"], help="of the frames")
        v.add_argument("--use-atomic", action="store_true", help="samples are atoms, with their own descriptors")
        v.add_argument("--species", type=int, help="atoms of this atomic number only")
        v.add_argument("--prefix", default="descmap")
        return v

    g = verb("gen_desc")
    g.add_argument("kind", choices=["soap", "acsf", "cm", "run"])
    g.add_argument("--cutoff", type=float)
    g.add_argument("--nmax", type=int)
    g.add_argument("--lmax", type=int)
    g.add_argument("--sigma", type=float, default=0.5)
    g.add_argument("--crossover", action="store_true")
    g.add_argument("--preset", choices=sorted(hypers.PRESETS))
    g.add_argument("--reducer", default="average", choices=sorted(frames.REDUCERS))
    g.add_argument("--element-wise", action="store_true")
    g.add_argument("--zeta", type=float)
    g.add_argument("--peratom", action="store_true")
    g.add_argument("--spec", help="JSON of specs, for run")
    m = verb("map")
    m.add_argument("method", choices=["raw", "pca", "skpca", "umap", "tsne"])
    m.add_argument("--dimension", type=int, default=10)
    m.add_argument("--scale", action="store_true")
    m.add_argument("--n-sparse", type=int)
    m.add_argument("--sparse-mode", default="fps")
    m.add_argument("--kernel", default="linear")
    m.add_argument("--degree", type=float, default=2.0)
    m.add_argument("--output", default="xyz", choices=["xyz", "matrix", "none", "chemiscope"])
    m.add_argument("--peratom", action="store_true", help="atoms' own descriptors are projected as well")
    m.add_argument("--axes", type=int, nargs=2, default=[0, 1], help="components of the points written")
    m.add_argument("--color", help="index, a property, or a text file of numbers")
    m.add_argument("--color-column", type=int, default=0)
    m.add_argument("--color-from-zero", action="store_true")
    m.add_argument("--extensive", action="store_true", help="the property is divided by the number of atoms")
    m.add_argument("--annotate", help="text file with a tag for each sample")
    m.add_argument("--extra-properties", help="CSV file, row by row of frames")
    c = verb("cluster")
    c.add_argument("--kernel-matrix", help="text file of a kernel; samples are the rows of its distances")
    c.add_argument("method", choices=["fdb", "dbscan"])
    c.add_argument("--eps", type=float)
    c.add_argument("--min-samples", type=int, default=5)
    c.add_argument("--percent", type=float, default=2.0)
    k = verb("kde")
    k.add_argument("method", choices=["internal", "scipy", "sklearn"])
    k.add_argument("--bandwidth", default=None)
    k.add_argument("--kernel", default="gaussian")
    k.add_argument("--dimension", type=int)
    f = verb("fit")
    f.add_argument("method", choices=["ridge", "kernelridge"])
    f.add_argument("--y", required=True, help="a property, or a text column")
    f.add_argument("--extensive", action="store_true")
    f.add_argument("--sigma", type=float, default=1e-4)
    f.add_argument("--test-ratio", type=float, default=0.05)
    f.add_argument("--lc-points", type=int, default=0)
    f.add_argument("--lc-repeats", type=int, default=8)
    f.add_argument("--n-sparse", type=int, default=100)
    f.add_argument("--kernel", default="linear")
    f.add_argument("--degree", type=float, default=2.0)
    s = verb("select")
    s.add_argument("--algorithm", default="fps", choices=["fps", "cur", "random", "sequential"])
    s.add_argument("--nkeep", type=float, required=True, help="a count, or a share below or equal to 1")
    s.add_argument("--savetxt", action="store_true")
    return p


def _kernel(a) -> dict:
    return {"k0": {"type": a.kernel, "d": a.degree}}


def _read(spark: SparkSession, a) -> DataFrame:
    return extxyz.read(spark, a.fxyz, a.stride, not a.no_periodic, a.format)


def _samples(spark: SparkSession, a) -> tuple[DataFrame | None, DataFrame]:
    """Frames, if there are any, and samples; of atoms with frame_id and atom_idx."""
    f = _read(spark, a) if a.fxyz else None
    if getattr(a, "kernel_matrix", None):
        return f, tables.read_matrix(spark, a.kernel_matrix).select("sample_id", F.transform("x", kernels.to_distance).alias("x"))
    if a.matrix:
        return f, tables.read_matrix(spark, a.matrix)
    if f is None:
        raise SystemExit("frames or a matrix are needed")
    if a.use_atomic:
        return f, numbered(frames.atomic_matrix(f, a.dm, a.species), "frame_id", "atom_idx", name="sample_id")
    return f, frames.design_matrix(f, a.dm)


def _points(spark: SparkSession, a, f: DataFrame | None, made: DataFrame) -> None:
    """The map's points with colour and tag, as a table."""
    rows = made.select("sample_id", *[F.get("reduced", F.lit(k)).alias(n) for k, n in zip(a.axes, "xy", strict=True)], *[c for c in ("frame_id", "atom_idx") if c in made.columns])
    if a.color or a.color_from_zero:
        by = a.color
        if by and os.path.isfile(by):
            by = tables.read_column(spark, by, a.color_column)
        if f is None:
            colour = by.select("sample_id", F.col("y").alias("colour")) if isinstance(by, DataFrame) else rows.select("sample_id", F.col("sample_id").cast("double").alias("colour"))
        else:
            colour = colours(f, by, a.use_atomic, a.species, a.extensive, a.color_from_zero)
        rows = rows.join(colour, ["frame_id", "atom_idx"] if "atom_idx" in colour.columns else "sample_id", "left")
    if a.annotate:
        rows = rows.join(tables.read_tags(spark, a.annotate), "sample_id", "left")
    tables.write_points(rows, f"{a.prefix}-points")


def _specs(a, f: DataFrame) -> dict:
    if a.kind == "run":
        with open(a.spec) as s:
            return tables.read_state(s.read())
    counted = frames.counters(f).first()
    species = list(counted.global_species)
    if a.kind == "cm":
        return {"cm": {"type": "CM", "max_atoms": counted.max_atoms}}
    given = [v is not None for v in (a.cutoff, a.nmax, a.lmax)]
    if a.kind == "acsf":
        inner = hypers.acsf(species, cutoff=a.cutoff)
    elif all(given):
        inner = {"soap1": {"type": "SOAP", "cutoff": a.cutoff, "n": a.nmax, "l": a.lmax, "sigma": a.sigma, "crossover": a.crossover}}
    elif any(given):
        raise SystemExit("cutoff, nmax and lmax go together")
    else:
        inner = hypers.soap(species, a.preset)
    inner = {t: {**s, "species": species} for t, s in inner.items()}
    if a.peratom:
        return inner
    reducer = {"type": a.reducer, "element_wise": a.element_wise} | ({"zeta": a.zeta} if a.zeta is not None else {})
    return {"global": {"atomic_descriptor": inner, "reducer_function": {"r": reducer}}}


def _acronyms(specs: dict) -> dict:
    """The descriptor each spec makes; of global ones from atomic ones, those of the atoms."""
    flat = {t: s for t, s in specs.items() if "type" in s} | {f"{t}/{u}": v for t, s in specs.items() for u, v in s.get("atomic_descriptor", {}).items()}
    return {t: descriptors.acronym(s) for t, s in flat.items()}


def _run(spark: SparkSession, a) -> DataFrame | dict:
    if a.verb == "gen_desc":
        f = _read(spark, a)
        specs = _specs(a, f)
        out = (descriptors.compute_atomic if a.peratom else descriptors.compute_global)(f, specs)
        extxyz.write(out, f"{a.prefix}.xyz")
        tables.write_state(spark, f"{a.prefix}-state.json", {"specs": specs, "acronyms": _acronyms(specs)})
        return out
    f, x = _samples(spark, a)
    if a.verb == "select":
        kept = sampling.sparsify(x, a.algorithm, int(a.nkeep) if a.nkeep > 1 else a.nkeep)
        if a.savetxt or f is None:
            tables.write_index(x, kept, f"{a.prefix}.index")
        if f is not None:
            extxyz.write(f.join(kept.select(F.col("sample_id").alias("frame_id")), "frame_id", "left_semi"), f"{a.prefix}.xyz")
        return kept
    if a.verb == "map":
        if a.extra_properties and f is not None:
            f = tables.load_properties(f, a.extra_properties)
        kinds = {"raw": "RAW", "pca": "PCA", "skpca": "SPARSE_KPCA", "umap": "UMAP", "tsne": "TSNE"}
        p = {"n_components": a.dimension, "scalecenter": a.scale, "n_sparse": a.n_sparse, "sparse_mode": a.sparse_mode, "kernel": _kernel(a)}
        spec = ({"pre": {"type": "SCALE"}} if a.scale and a.method != "pca" else {}) | {a.method: {"type": kinds[a.method], "parameter": p}}
        model = reduce.Pipeline(spec)
        made = model.fit_transform(x)
        name = f"{a.method}-d-{a.dimension}"
        atoms = None
        if a.peratom and f is not None and not a.use_atomic:
            atoms = model.transform(frames.atomic_matrix(f, a.dm, a.species)).select("frame_id", "atom_idx", F.col("reduced").alias("x"))
        elif a.use_atomic and f is not None:
            atoms = made.select("frame_id", "atom_idx", F.col("reduced").alias("x"))
        if a.output == "matrix" or f is None and a.output != "none":
            tables.write_matrix(made, f"{a.prefix}.coord", "reduced", comment=name)
            if atoms is not None:
                tables.write_atomic_matrix(atoms, f"{a.prefix}.atomic-coord", comment=name)
        elif a.output in ("xyz", "chemiscope"):
            with_map = f if a.use_atomic else frames.set_descriptor(f, made.select("sample_id", F.col("reduced").alias("x")), name)
            with_map = with_map if atoms is None else frames.set_atomic(with_map, atoms, name)
            (extxyz.write if a.output == "xyz" else tables.chemiscope)(with_map, f"{a.prefix}.{'xyz' if a.output == 'xyz' else 'json'}")
        if a.color or a.annotate or a.color_from_zero:
            _points(spark, a, f, made)
        return made
    if a.verb == "cluster":
        if a.method == "dbscan":
            eps = a.eps if a.eps is not None else cluster.auto_eps(x)
            out, params = cluster.dbscan(x, eps, a.min_samples), {"eps": eps, "min_samples": a.min_samples}
        else:
            model = cluster.DensityPeaks(a.percent)
            out = model.fit(x)
            params = model.state()
        tables.write_labels(out, f"{a.prefix}-{a.method}.dat")
        cluster.save_state(f"{a.prefix}-{a.method}.json", a.method, params, out)
        return out
    if a.verb == "kde":
        d = a.dimension or {"internal": 8, "scipy": 50, "sklearn": 50}[a.method]
        x = x.withColumn("x", F.slice("x", 1, d))
        if a.method == "internal":
            out = density.BestBandwidth(a.kernel, bandwidth=float(a.bandwidth) if a.bandwidth else None).fit(x).evaluate()
        elif a.method == "scipy":
            out = density.kde_full(x, a.bandwidth if a.bandwidth in (None, "scott", "silverman") and a.bandwidth else float(a.bandwidth) if a.bandwidth else "scott")
        else:
            out = density.kde(x, float(a.bandwidth or 1.0), a.kernel)
        tables.write_density(out, f"{a.prefix}-kde.dat")
        return out
    y = frames.property_of(f, a.y, a.extensive) if f is not None else tables.read_column(spark, a.y)
    d = fit.DesignMatrix(x.join(y, "sample_id"), test_ratio=a.test_ratio)
    learner = fit.Ridge(a.sigma) if a.method == "ridge" else fit.SparseKernelRidge(a.sigma, n_sparse=a.n_sparse, kernel=_kernel(a))
    d.compute_fit(learner)
    if a.lc_points:
        d.learning_curve(learner, a.lc_points, a.lc_repeats)
    return d.results


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | dict:
    a = _parser().parse_args(argv)
    out = _run(spark or SparkSession.builder.appName("descmap").getOrCreate(), a)
    if isinstance(out, dict):
        print(json.dumps(out, cls=tables.NumbersEncoder))
    return out


if __name__ == "__main__":
    main()
