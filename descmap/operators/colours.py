"""The numbers by which samples are coloured: a property of frames or atoms, a column of a file, or the sample's place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from descmap.operators import frames as fr
from descmap.operators.graph import numbered


def colours(frames: DataFrame, by: str | DataFrame | None = None, per_atom: bool = False, species: int | None = None, extensive: bool = False, from_zero: bool = False) -> DataFrame:
    """sample_id and colour of every frame; per_atom: frame_id, atom_idx and colour of every atom (of one species).

    by: None or "index" (the frame's place), the name of a property, or rows (sample_id, y) as `tables.read_column` gives, whose
    ids are places of frames, or of atoms if there are as many rows as atoms. from_zero: the smallest colour of frames is taken off.
    """
    placed = numbered(frames.select("frame_id"), "frame_id", name="colour")
    if by is None or (isinstance(by, str) and by.lower() in ("none", "index")):
        own = placed.select(F.col("frame_id").alias("sample_id"), F.col("colour").cast("double").alias("colour"))
    elif isinstance(by, str):
        own = fr.property_of(frames, by, extensive).select("sample_id", F.col("y").alias("colour"))
    else:
        rows, n = by.count(), frames.count()
        if rows == n:
            own = placed.join(by.select(F.col("sample_id").alias("colour"), "y"), "colour").select(F.col("frame_id").alias("sample_id"), F.col("y").alias("colour"))
        elif per_atom and rows == frames.agg(F.sum("natoms")).first()[0]:
            at = numbered(fr.atoms(frames), "frame_id", "atom_idx", name="sample_id")
            own = at.join(by, "sample_id").select("frame_id", "atom_idx", "z", F.col("y").alias("colour"))
            own = own if species is None else own.where(F.col("z") == species)
            return _from_zero(own.drop("z"), own, from_zero)
        else:
            raise ValueError(f"{rows} colours for {n} frames")
    if not per_atom:
        return _from_zero(own, own, from_zero)
    if isinstance(by, str) and by.lower() not in ("none", "index"):
        made = fr.atomic_property(frames, by, extensive, species).select("frame_id", "atom_idx", F.col("y").alias("colour"))
    else:
        some = fr.atoms(frames) if species is None else fr.atoms(frames).where(F.col("z") == species)
        made = some.select("frame_id", "atom_idx").join(own.withColumnRenamed("sample_id", "frame_id"), "frame_id")
    return _from_zero(made, own, from_zero)


def _from_zero(made: DataFrame, own: DataFrame, on: bool) -> DataFrame:
    if not on:
        return made
    low = own.agg(F.min("colour")).first()[0]
    return made if low is None else made.withColumn("colour", F.col("colour") - F.lit(low))
