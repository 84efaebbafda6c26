"""What the operators of this folder share: the shared folder, written intermediate tables, text chunks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
_OWN_DIR: dict[str, str] = {}
#: A written table has so many files for each core at most.
FILES_PER_CORE = 4


def session(df: DataFrame) -> SparkSession:
    """The DataFrame's session, set up so that its Python workers can import this package."""
    spark = df.sparkSession
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, on one machine (tests) a folder of our own, on a cluster an error."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if said:
        return said.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="gossamer-")
    return _OWN_DIR[app]


def written(df: DataFrame, name: str, gather: bool = True) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them again.

    Executors may be lost later without anything being computed anew, and
    whatever was random in the plan stays as it was written. Partitions beyond
    FILES_PER_CORE for each core share a task and a file, one after the other:
    they would wait for a core anyway, and a loop would leave very many small
    files. gather=False keeps them apart, where a task makes many rows of few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gossamer/{name}-{uuid.uuid4().hex}"
    rows = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism) if gather else df
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each with as many underscores before it as it takes not to be a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(doc_id: str, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(k))


def slices(rows: pa.RecordBatch | pa.Array, most: int = 256) -> Iterator:
    """A batch in parts of so many rows: as Python objects they take several times their room."""
    for at in range(0, len(rows), most):
        yield rows.slice(at, most)


def chunks(texts: pa.Array | Iterable[str | None], most: int = 500_000) -> Iterator[list[str]]:
    """Whole texts in their order, in lists of about so many characters; null counts as empty."""
    held: list[str] = []
    size = 0
    for t in (t for part in slices(texts, 64) for t in part.to_pylist()) if isinstance(texts, pa.Array | pa.ChunkedArray) else texts:
        held.append(t := t or "")
        size += len(t) + 16
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which a worker gives the memory that it no longer needs back to the system: it lives on, idle or with another task."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # the C library of Linux has it
            ctypes.CDLL(None).malloc_trim(0)

    return tidied


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
