"""Tables kept in the folder that the driver and all executors share."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset and the master is local; elsewhere an unset one is a ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="lodeline-"))
    return _OWN_DIR[0]


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """rows with all those of a key in one partition, by a hash of it.

    A repartition by the key itself is dropped from the plan after a join or aggregate by the same key, and what is left of it may then be read mapper by
    mapper (a join that becomes a broadcast) or in parts (a skewed one); a function that no group by stands above would see keys torn apart.
    """
    return rows.repartition(F.xxhash64(*key))


def runs(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple[int, int, tuple]]:
    """First and last row (not included) of each run of rows with equal values in columns, and these values."""
    table = pa.Table.from_batches([batch.select(columns)])
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = table.column(c).combine_chunks()
        new[1:] |= pc.fill_null(pc.not_equal(x[1:], x[:-1]), True).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(new).tolist()
    for first, last in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        yield first, last, tuple(table.column(c)[first].as_py() for c in columns)


class scratch:
    """A scope whose kept tables are deleted at its end: read or write what it gives inside, or take it out as result().

        with scratch(spark) as own:
            ids = own.result(parse(lines, masks), "ids")
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scratch:
        _SCOPES.append([])
        return self

    def __exit__(self, *_: object) -> None:
        for path in _SCOPES.pop():
            delete(self.spark, path)

    def result(self, df: DataFrame, tag: str) -> DataFrame:
        """df as a kept table that outlives this scope; an enclosing one has it."""
        inner = _SCOPES.pop()
        try:
            return keep(df, tag)
        finally:
            _SCOPES.append(inner)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder on any of Spark's file systems, if it is there."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    files, where = _file_system(spark, path)
    target = _file_system(spark, to)[1]
    files.mkdirs(target.getParent())
    if not files.rename(where, target):
        raise OSError(f"{path} can't be renamed to {to}")


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    files, where = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []


def write_small(spark: SparkSession, path: str, value: Mapping) -> None:
    """A small JSON file, which has its name only when it is whole."""
    files, where = _file_system(spark, f"{path}.{uuid.uuid4().hex}")
    out = files.create(where)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    rename(spark, where.toString(), path)


def read_small(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))
