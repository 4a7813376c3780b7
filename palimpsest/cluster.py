"""What a job needs from the cluster: code on the executors, shared folders, Arrow batches of a bounded size."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_palimpsest_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    path = os.path.join(folder, f"{root.name}-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)
    sc._palimpsest_shipped = True


def broadcast_once(spark: SparkSession, value: bytes) -> Broadcast:
    """A broadcast of a small value that many queries of the session use."""
    kept = spark.sparkContext.__dict__.setdefault("_palimpsest_broadcasts", {})
    if value not in kept:
        kept[value] = spark.sparkContext.broadcast(value)
    return kept[value]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or in tests a temporary one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of the cluster's store, if it is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder that its context was given.

    Where neither is set, a session on this machine alone (tests) gets a temporary folder, which goes at the end; on a
    cluster, whose executors wouldn't see that, this is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    sc = spark.sparkContext
    set_there = sc._jsc.sc().getCheckpointDir()
    if set_there.isDefined():
        return set_there.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder, without their lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as none of the columns has (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_arrow(df: DataFrame, run: Callable, schema: T.StructType | str, rows: int = 1024, size: int = 8 << 20, task: bool = False) -> DataFrame:
    """mapInArrow in slices of at most so many rows, and of about so many bytes where one row isn't larger.

    task: run() makes the function, anew for each task, so that it may keep something meanwhile; its attributes
    rest (what is left to give) and close, if there are any, are called at the task's end."""
    ship(df.sparkSession)

    def every(batches: Iterable) -> Iterator:
        each = run() if task else run
        try:
            for batch in batches:
                n = batch.num_rows
                step = max(1, min(rows, n if not batch.nbytes else int(n * size / batch.nbytes)))
                for at in range(0, n, step):
                    out = each(batch.slice(at, step))
                    yield from out if isinstance(out, list) else [out]
            yield from getattr(each, "rest", list)()
        finally:
            getattr(each, "close", lambda: None)()
            give_back()

    return df.mapInArrow(every, schema)


def give_back() -> None:
    """Returns freed memory to the system, so that a worker that waits for its next task doesn't hold it."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
