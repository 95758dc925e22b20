"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from descmap.operators.graph import work_dir, written

#: Bytes that end a word in the operators that split at ASCII white space.
SPACES = " \t\n\x0b\f\r"


#: Rows of one Arrow batch: texts are long, and both sides hold several batches at once.
BATCH = 1000


def small_batches(spark: SparkSession) -> None:
    """Batches to Python workers of BATCH rows at most from now on in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names, which all machines share; only a local master may leave that unset."""
    return work_dir(spark, "llm")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by files in the shared checkpoint folder."""
    return written(df)


def sub_batches(values: list, limit: int = 2_000_000) -> Iterator[list]:
    """Consecutive runs of texts with about `limit` characters at most, so that what is made of them stays small."""
    run: list = []
    size = 0
    for v in values:
        run.append(v)
        size += len(v)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str):
    return F.col(quoted(name))


def ddl(fields) -> str:
    """Column definitions of some fields of a schema."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it as long as df has such a column."""
    lower = {c.lower() for c in df.columns}
    while name.lower() in lower:
        name = "_" + name
    return name


_OWNER: list = [None, None]


def takes_memory(name: str, forget: Callable[[], None]) -> None:
    """To be called by what keeps something in a Python worker between tasks: workers serve many operators, and only
    the last keeps what it has learned. Freed memory goes back to the system where the C library can do that."""
    if _OWNER[0] != name or _OWNER[1] != forget:
        if _OWNER[1] is not None:
            _OWNER[1]()
        _OWNER[:] = [name, forget]
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def room(df: DataFrame, added: list[str], used: tuple[str, ...] = ()) -> DataFrame:
    """df without columns that have the name of one that is about to be added; columns that are used can't be replaced."""
    names = {a.lower() for a in added}
    if clash := [u for u in used if u.lower() in names]:
        raise ValueError(f"{clash} would be read and replaced")
    return df.select(*[column(df, c) for c in df.columns if c.lower() not in names])


#: Rows that `matched` broadcasts at most; parts of the rows of one key beyond that.
BROADCAST, SALT = 200_000, 32


def matched(rows: DataFrame, small: DataFrame, key: str, spread: str, fits: bool | None = None) -> DataFrame:
    """rows with the columns of small (short rows, one for each key), none where the key is missing.

    small goes out whole up to BROADCAST rows, or if it is known to fit. Beyond, its rows are copied for each of SALT parts that a key's rows are dealt to
    by a hash of `spread`, so that a key with a third of all rows is spread over as many tasks.
    """
    if small.limit(BROADCAST + 1).count() <= BROADCAST if fits is None else fits:
        return rows.join(F.broadcast(small), key, "left")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(copies, [key, "_salt"], "left").drop("_salt")
