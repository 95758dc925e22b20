"""Text matrices, label and colour files, CSV properties, chemiscope JSON, state files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.operators.graph import numbered


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("k"), F.trim(F.split("value", "#").getItem(0)).alias("v")).where("v <> ''")
    return numbered(lines, "f", "k", name="sample_id")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """sample_id (place of the row) and x of a text of numbers; what follows # is left out."""
    return _numbered_lines(spark, path).select("sample_id", F.transform(F.split("v", r"[\s,]+"), lambda s: s.cast("double")).alias("x"))


def read_column(spark: SparkSession, path: str, column: int = 0) -> DataFrame:
    """sample_id and y, one column of a text of numbers (labels, colours)."""
    return read_matrix(spark, path).select("sample_id", F.get("x", F.lit(column)).alias("y"))


def read_kernel(spark: SparkSession, path: str) -> DataFrame:
    """i, j, k of a square text matrix."""
    return read_matrix(spark, path).select(F.col("sample_id").alias("i"), F.posexplode("x").alias("j", "k"))


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return _numbered_lines(spark, path).select("sample_id", F.col("v").alias("tag"))


def load_properties(frames: DataFrame, path: str, header: bool = True, prefix: str = "X") -> DataFrame:
    """frames with the columns of a CSV file among info and props, row by row in order of frame_id, as far as both go."""
    spark = frames.sparkSession
    csv = spark.read.csv(path, header=header, inferSchema=False)
    if not header:
        csv = csv.toDF(*[f"{prefix}{k}" for k in range(len(csv.columns))])
    names = [c for c in csv.columns if not c.startswith("_c")] if header else csv.columns
    kept = csv.select([F.col(f"`{c}`") for c in names]).withColumn("_o", F.monotonically_increasing_id())
    rows = numbered(kept, "_o", name="_n").drop("_o")
    flat = F.map_filter(F.create_map(*[x for c in names for x in (F.lit(c), F.col(f"`{c}`"))]), lambda _, v: v.isNotNull())
    got = rows.select("_n", flat.alias("_info"))
    numbers = F.map_filter(F.transform_values("_info", lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())
    placed = numbered(frames, "frame_id", name="_n")
    both = placed.join(got, "_n", "left")
    new = lambda old, more: F.when(F.col("_info").isNull(), F.col(old)).otherwise(F.map_concat(F.map_filter(F.col(old), lambda k, _: ~F.array_contains(F.map_keys(more), k)), more))
    return both.withColumn("props", new("props", numbers)).withColumn("info", new("info", F.col("_info"))).drop("_n", "_info")


def write_matrix(df: DataFrame, path: str, x_col: str = "x", id_col: str = "sample_id", comment: str = "") -> None:
    """Rows in order of id as lines of numbers with eight decimals, in one file."""
    lines = df.orderBy(id_col).select(F.array_join(F.transform(x_col, lambda v: F.format_string("%.8f", v.cast("double"))), " ").alias("value"))
    if comment:
        head = df.sparkSession.createDataFrame([(0, f"# {comment}")], "o int, value string")
        lines = head.unionByName(lines.withColumn("o", F.lit(1))).coalesce(1).select("value")
    lines.coalesce(1).write.mode("overwrite").text(path)


def write_atomic_matrix(rows: DataFrame, path: str, x_col: str = "x", comment: str = "") -> None:
    """Atoms' vectors (frame_id, atom_idx, x) as lines of numbers, in order of frame and atom."""
    write_matrix(numbered(rows, "frame_id", "atom_idx", name="_place"), path, x_col, "_place", comment)


def write_points(df: DataFrame, path: str, id_col: str = "sample_id") -> None:
    """What a plot shows (id, coordinates, colour, tag) as CSV with a header, in order of id; one file for each task."""
    df.orderBy(id_col).write.mode("overwrite").csv(path, header=True)


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Parameters of a run as JSON; `read_state` takes it."""
    spark.createDataFrame([(json.dumps(state, cls=NumbersEncoder, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_index(all_rows: DataFrame, kept: DataFrame, path: str, id_col: str = "sample_id") -> None:
    """A line of 1 or 0 for each row in order of id: whether it is among `kept`."""
    mask = all_rows.select(id_col).join(kept.select(id_col).distinct().withColumn("_k", F.lit(1)), id_col, "left")
    mask.orderBy(id_col).select(F.coalesce("_k", F.lit(0)).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_labels(df: DataFrame, path: str, label: str = "cluster_label", id_col: str = "sample_id", by_label: bool = False) -> None:
    """Lines of id and label; by_label: in order of label, without noise."""
    rows = df.where(F.col(label) >= 0).orderBy(label, id_col) if by_label else df.orderBy(id_col)
    rows.select(F.concat_ws(" ", F.col(id_col).cast("string"), F.col(label).cast("string")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_density(df: DataFrame, path: str, value: str = "log_density", id_col: str = "sample_id") -> None:
    df.orderBy(id_col).select(F.concat_ws(" ", F.col(id_col).cast("string"), F.format_string("%.8f", F.col(value))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def linearised(df: DataFrame, x_col: str, id_col: str = "sample_id", first: int = 0) -> DataFrame:
    """id, name and value of each component: name[k] counted from `first`."""
    return df.select(id_col, F.posexplode(x_col).alias("k", "value")).select(id_col, F.concat(F.lit(x_col + "["), (F.col("k") + first).cast("string"), F.lit("]")).alias("name"), "value")


def environments(frames: DataFrame, cutoff: float) -> DataFrame:
    """structure, center and cutoff of every atom."""
    return frames.select(F.col("frame_id").alias("structure"), F.explode("atoms").alias("a")).select("structure", F.col("a.idx").alias("center"), F.lit(float(cutoff)).alias("cutoff"))


def chemiscope(frames: DataFrame, path: str, name: str = "descmap", cutoff: float | None = None, compress: bool = True) -> None:
    """One JSON document {meta, structures, properties, environments}, as a text of lines that together are the document.

    Structures are made by the tasks that hold the frames; a property is one line, in order of frame. Only frames' own numbers go
    to a property line, so a line is as long as the number of frames.
    """
    spark = frames.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, ids = [], []
            for f in b.to_pylist():
                pos = np.array([a["pos"] for a in f["atoms"]]).reshape(-1, 3)
                s = {"size": f["natoms"], "names": [a["symbol"] for a in f["atoms"]], "x": pos[:, 0].tolist(), "y": pos[:, 1].tolist(), "z": pos[:, 2].tolist()}
                if f["cell"]:
                    s["cell"] = [v for row in f["cell"] for v in row]
                ids.append(f["frame_id"])
                made.append(json.dumps(s))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(made)], names=["frame_id", "s"])

    structures = frames.select("frame_id", "natoms", "cell", "atoms").mapInArrow(run, "frame_id bigint, s string")
    values = frames.select("frame_id", F.explode("props").alias("name", "v")).select("frame_id", "name", "v")
    vectors = frames.select("frame_id", F.explode("desc").alias("base", "x")).select("frame_id", "base", F.posexplode("x").alias("k", "v"))
    vectors = vectors.select("frame_id", F.concat("base", F.lit("["), F.col("k").cast("string"), F.lit("]")).alias("name"), "v")
    lines = values.unionByName(vectors).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("frame_id", "v"))).alias("p"))
    props = lines.select("name", F.to_json(F.struct(F.lit("structure").alias("target"), F.col("p.v").alias("values"))).alias("j"))
    quoted = F.concat(F.lit('"'), F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    def fixed(o, text):
        return spark.createDataFrame([(o, "", text)], "o int, k string, value string")

    head = fixed(0, '{"meta": ' + json.dumps({"name": name}) + ', "structures": [')
    # commas stand before all elements but the one of smallest key
    low = frames.agg(F.min("frame_id")).first()[0]
    body = structures.select(F.lit(1).alias("o"), F.format_string("%020d", "frame_id").alias("k"), F.concat(F.when(F.col("frame_id") == low, "").otherwise(","), F.col("s")).alias("value"))
    least = props.agg(F.min("name")).first()[0]
    named = props.select(F.lit(3).alias("o"), F.col("name").alias("k"), F.concat(F.when(F.col("name") == least, "").otherwise(","), quoted, F.lit(": "), F.col("j")).alias("value"))
    out = head.unionByName(body).unionByName(fixed(2, '], "properties": {')).unionByName(named)
    if cutoff is not None:
        env = environments(frames, cutoff)
        lowest = F.col("structure").eqNullSafe(F.lit(low)) & (F.col("center") == 0)
        out = out.unionByName(fixed(4, '}, "environments": [')).unionByName(env.select(F.lit(5).alias("o"), F.format_string("%020d/%010d", "structure", "center").alias("k"), F.concat(F.when(lowest, "").otherwise(","), F.to_json(F.struct("structure", "center", "cutoff"))).alias("value"))).unionByName(fixed(6, "]}"))
    else:
        out = out.unionByName(fixed(4, "}}"))
    writer = out.orderBy("o", "k").select("value").coalesce(1).write.mode("overwrite")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def read_state(text: str) -> dict:
    """YAML if it can be read as such, else JSON; string values that are JSON themselves are read once more."""
    try:
        import yaml

        got = yaml.safe_load(text)
    except Exception:  # noqa: BLE001  any error of the YAML reader means that it is to be read as JSON
        got = json.loads(text)
    out = {}
    for k, v in (got or {}).items():
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                pass
        out[k] = v
    return out


class NumbersEncoder(json.JSONEncoder):
    """JSON of NumPy scalars and arrays."""

    def default(self, o):
        if isinstance(o, np.generic):
            return o.item()
        if isinstance(o, np.ndarray):
            return o.tolist()
        return super().default(o)
