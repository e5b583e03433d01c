"""Tables written to the folder that driver and executors share, and sets derived from a snapshot once."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where that is unset, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lumeno-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by release() or when the application ends."""
    path = f"{shared_dir(spark)}/lumeno/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release, spark)
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes all scratch paths made so far: for long applications, between queries whose results are no longer read.
    An application that has already stopped leaves them to the folder's owner."""
    jvm = spark.sparkContext._jvm
    _derived.clear()  # what was derived once is gone with its files
    while _made:
        path = _made.pop()
        if jvm is None or spark.sparkContext._jsc is None:
            continue
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the gateway may be gone by now
            continue


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: it is computed once, and a lost executor can't take it along.

    Shuffle files of the write are deleted with its end, since nothing reads them again; Spark itself keeps them until its driver collects garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_derived: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def once(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f(elements, ...) written the first time; later calls with the same elements and arguments read that table."""

    @functools.wraps(f)
    def get(elements: DataFrame, *args, **kwargs) -> DataFrame:
        known = _derived.setdefault(elements, {})
        key = (f.__module__, f.__name__, args, tuple(sorted(kwargs.items())))
        if key not in known:
            known[key] = written(f(elements, *args, **kwargs), f.__name__)
        return known[key]

    return get


def broadcast_measured(spark: SparkSession) -> None:
    """From now on tables are broadcast by the size that their rows have once they are shuffled, not by that of their files.

    Files of elements are a hundredth of their rows or less, so that Spark's estimates would broadcast tables that no driver holds. Hints still count.
    """
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if most != "-1":
        if spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) is None:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")


def starts(rows: pa.Table, *keys: str) -> np.ndarray:
    """Whether each row has other keys than the one before; the first has."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        c = rows[k].combine_chunks()
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return new


def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Batches of rows that are sorted by keys (without nulls), cut anew so that each has whole groups: no call for each group, and no group is split."""
    held: list[pa.Table] = []
    for b in batches:
        if not len(b):
            continue
        rows = pa.Table.from_batches([b])
        first = starts(rows, *keys)
        first[0] = bool(held) and any(held[-1][k][-1] != rows[k][0] for k in keys)
        cuts = np.flatnonzero(first)
        if len(cuts):
            last = int(cuts[-1])
            yield pa.concat_tables([*held, rows.slice(0, last)])
            held = [rows.slice(last)]
        else:
            held.append(rows)
    if held:
        yield pa.concat_tables(held)
