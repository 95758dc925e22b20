"""Operators on frames (see sources.extxyz for the columns): counters, selection of descriptors, properties, reducers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from descmap.functions import cell as C
from descmap.operators.graph import quantiles

#: Prefixes that the pattern * stands for.
PREFIXES = ("SOAP", "ACSF", "LMBTR", "FCHL19", "CM", "pca", "skpca", "umap", "tsne")


def counters(frames: DataFrame) -> DataFrame:
    """One row: nframes, total_natoms, max_atoms and global_species."""
    return frames.agg(
        F.count("*").alias("nframes"), F.sum("natoms").alias("total_natoms"), F.max("natoms").alias("max_atoms"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(F.transform("atoms", lambda a: a["z"])))))).alias("global_species"),
    )


def atoms(frames: DataFrame) -> DataFrame:
    """frame_id, atom_idx, symbol, z, pos and arrays of every atom."""
    return frames.select("frame_id", F.explode("atoms").alias("a")).select("frame_id", F.col("a.idx").alias("atom_idx"), F.col("a.symbol").alias("symbol"), F.col("a.z").alias("z"), F.col("a.pos").alias("pos"), F.col("a.arrays").alias("arrays"))


def species_count(z: int) -> Column:
    return F.size(F.filter("atoms", lambda a: a["z"] == z))


def descriptor_names(frames: DataFrame) -> list[str]:
    """Names over all frames, not the first alone."""
    return sorted(r[0] for r in frames.select(F.explode(F.map_keys("desc"))).distinct().collect())


def atomic_names(frames: DataFrame) -> list[str]:
    return sorted(r[0] for r in atoms(frames).select(F.explode(F.map_keys("arrays"))).distinct().collect())


def resolve(wanted: list[str], there: list[str]) -> list[str]:
    """Names that the patterns stand for, each once, in their order: * is all with a known prefix, X* what has X and more after it."""
    out: list[str] = []
    for w in wanted:
        if w == "*":
            got = [t for p in PREFIXES for t in there if re.match(re.escape(p) + ".+", t)]
        elif w.endswith("*"):
            got = [t for t in there if re.search(re.escape(w[:-1]) + ".+", t)]
        else:
            got = [w] if w in there else []
            if not got:
                raise KeyError(f"no descriptor {w!r}; there are {there}")
        out += [g for g in got if g not in out]
    return out


def _needed(m: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(name)), F.raise_error(F.lit(f"a row has no {name}")).cast("array<double>"))


def design_matrix(frames: DataFrame, wanted: list[str]) -> DataFrame:
    """sample_id and x: the named descriptors of each frame, one after another."""
    names = resolve(wanted, descriptor_names(frames))
    if not names:
        raise KeyError(f"no descriptor fits {wanted}")
    return frames.select(F.col("frame_id").alias("sample_id"), F.concat(*[_needed(F.col("desc"), n) for n in names]).alias("x"))


def atomic_matrix(frames: DataFrame, wanted: list[str], species: int | None = None) -> DataFrame:
    """frame_id, atom_idx and x of atoms (of one species)."""
    names = resolve(wanted, atomic_names(frames))
    if not names:
        raise KeyError(f"no atomic descriptor fits {wanted}")
    rows = atoms(frames)
    rows = rows if species is None else rows.where(F.col("z") == species)
    return rows.select("frame_id", "atom_idx", F.concat(*[_needed(F.col("arrays"), n) for n in names]).alias("x"))


def property_of(frames: DataFrame, key: str | int | None = None, extensive: bool = False) -> DataFrame:
    """sample_id and y. index (or None), volume (for each atom), size, the count of a species by number, else a number
    of the frame (extensive: for each atom), else the atoms' array of that name, averaged (extensive: summed)."""
    if key is None or key == "index":
        y: Column = F.col("frame_id").cast("double")
    elif key == "volume":
        y = C.volume(F.col("cell")) / F.col("natoms")
    elif key == "size":
        y = F.col("natoms").cast("double")
    elif isinstance(key, int) or str(key).isdigit():
        y = species_count(int(key)).cast("double")
    else:
        own = F.try_element_at("props", F.lit(key))
        values = F.transform("atoms", lambda a: F.get(F.try_element_at(a["arrays"], F.lit(key)), F.lit(0)))
        total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        y = F.coalesce(own / F.col("natoms") if extensive else own, total if extensive else total / F.col("natoms"))
    return frames.select(F.col("frame_id").alias("sample_id"), y.alias("y"))


def atomic_property(frames: DataFrame, key: str, extensive: bool = False, species: int | None = None) -> DataFrame:
    """frame_id, atom_idx and y: the atoms' own array, else the frame's number."""
    rows = frames.select("frame_id", "natoms", F.try_element_at("props", F.lit(key)).alias("p"), F.explode("atoms").alias("a"))
    rows = rows if species is None else rows.where(F.col("a.z") == species)
    own = F.get(F.try_element_at(F.col("a.arrays"), F.lit(key)), F.lit(0))
    return rows.select("frame_id", F.col("a.idx").alias("atom_idx"), F.coalesce(own, F.col("p") / F.col("natoms") if extensive else F.col("p")).alias("y"))


def set_descriptor(frames: DataFrame, made: DataFrame, name: str, x_col: str = "x") -> DataFrame:
    """frames with a descriptor from rows (sample_id, x); frames without a row keep what they have."""
    new = made.select(F.col("sample_id").alias("frame_id"), F.col(x_col).alias("_x"))
    rest = F.map_filter("desc", lambda k, _: k != name)
    return frames.join(new, "frame_id", "left").withColumn("desc", F.when(F.col("_x").isNull(), F.col("desc")).otherwise(F.map_concat(rest, F.create_map(F.lit(name), F.col("_x"))))).drop("_x")


def set_atomic(frames: DataFrame, made: DataFrame, name: str, x_col: str = "x") -> DataFrame:
    """frames whose atoms have an array from rows (frame_id, atom_idx, x); other atoms have a null."""
    got = made.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("atom_idx", F.col(x_col)))).alias("_m"))
    new = F.transform("atoms", lambda a: a.withField("arrays", F.map_concat(F.map_filter(a["arrays"], lambda k, _: k != name), F.create_map(F.lit(name), F.try_element_at("_m", a["idx"])))))
    return frames.join(got, "frame_id", "left").withColumn("atoms", F.when(F.col("_m").isNull(), F.col("atoms")).otherwise(new)).drop("_m")


def remove_descriptors(frames: DataFrame, wanted: list[str]) -> DataFrame:
    """frames without the named descriptors; names that aren't there are passed over."""
    there = descriptor_names(frames)
    gone = [g for w in wanted for g in (resolve([w], there) if w in there or w.endswith("*") else [])]
    return frames.withColumn("desc", F.map_filter("desc", lambda k, _: ~k.isin(gone))) if gone else frames


def remove_atomic(frames: DataFrame, wanted: list[str]) -> DataFrame:
    there = atomic_names(frames)
    gone = [g for w in wanted for g in (resolve([w], there) if w in there or w.endswith("*") else [])]
    if not gone:
        return frames
    return frames.withColumn("atoms", F.transform("atoms", lambda a: a.withField("arrays", F.map_filter(a["arrays"], lambda k, _: ~k.isin(gone)))))


REDUCERS = {"average": ("", 1.0, True), "sum": ("-sum", 1.0, False), "moment_average": ("-z-", None, True), "moment_sum": ("-z-", None, False)}


def reducer_suffix(spec: dict) -> str:
    """What a reducer adds to an acronym: nothing for the average, -sum, -z-{zeta}, -z-{zeta}-sum, and -e if by element."""
    kind = spec.get("type", spec.get("reducer_type", "average"))
    suffix, _, mean = REDUCERS[kind]
    if suffix == "-z-":
        suffix = f"-z-{spec['zeta']}" + ("" if mean else "-sum")
    return suffix + ("-e" if spec.get("element_wise") else "")


def _reduced(vectors: Column, kind: str, zeta: float | None) -> Column:
    """An array of vectors as one, without leaving the row."""
    _, power, mean = REDUCERS[kind]
    if power is None:
        if zeta is None:
            raise ValueError(f"{kind} needs zeta")
        vectors = F.transform(vectors, lambda v: F.transform(v, lambda u: F.pow(u, F.lit(float(zeta)))))
    width = F.size(F.get(vectors, F.lit(0)))
    total = F.aggregate(vectors, F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.transform(total, lambda u: u / F.size(vectors)) if mean else total


def reduce_atoms(frames: DataFrame, name: str, spec: dict, species: list[int] | None = None) -> DataFrame:
    """frames with the descriptor {name}{suffix} that a reducer makes of the atoms' arrays; element-wise: of each species in turn,
    zeros where a frame has none of it (sums and means alike)."""
    kind, zeta = spec.get("type", spec.get("reducer_type", "average")), spec.get("zeta")
    vector = lambda a: F.try_element_at(a["arrays"], F.lit(name))
    if spec.get("element_wise"):
        species = species or counters(frames).first().global_species
        width = F.size(vector(F.get("atoms", F.lit(0))))

        def part(z: int) -> Column:
            mine = F.transform(F.filter("atoms", lambda a: a["z"] == z), vector)
            return F.when(F.size(mine) > 0, _reduced(mine, kind, zeta)).otherwise(F.array_repeat(F.lit(0.0), width))

        made = F.concat(*map(part, species))
    else:
        made = _reduced(F.transform("atoms", vector), kind, zeta)
    new = name + reducer_suffix(spec)
    return frames.withColumn("desc", F.map_concat(F.map_filter("desc", lambda k, _: k != new), F.create_map(F.lit(new), made)))


def reduce_rows(df: DataFrame, key: str, x_col: str, width: int, kind: str = "average", zeta: float | None = None, out: str = "v") -> DataFrame:
    """The same over rows of a table grouped by key: one aggregate for each component, partly summed before the shuffle."""
    _, power, mean = REDUCERS[kind]
    p = power if power is not None else float(zeta)
    at = lambda k: F.get(x_col, F.lit(k)).cast("double")
    one = lambda k: at(k) if p == 1.0 else F.pow(at(k), F.lit(p))
    cols = [(F.avg if mean else F.sum)(one(k)).alias(f"_{k}") for k in range(width)]
    return df.groupBy(key).agg(*cols).select(key, F.array(*[F.col(f"_{k}") for k in range(width)]).alias(out))


def outer_rows(df: DataFrame, prop: str, share: float = 0.05, id_col: str = "sample_id") -> DataFrame:
    """Rows of the lowest and highest `share` of a property (exact quantiles)."""
    q = quantiles(df, prop, [share, 1 - share])
    return df.where((F.col(prop) <= q[0]) | (F.col(prop) >= q[1])) if q else df


def union(*sets: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets)
