"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the Python call site of every column costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "clienttrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the library's settings; keyword names use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


_local_root: str | None = None
_T = TypeVar("_T")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    A cluster sets that to storage all executors see. Only a local session
    may go without it and then gets a temporary folder.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _local_root = _local_root or tempfile.mkdtemp(prefix="clienttrace-")
        root = _local_root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing: Counter[str] = Counter()
_as_found: dict[str, str] = {}
_lock = Lock()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """``CLEANUP`` is on while any thread of the session is in here; then it is again what it was."""
    if not spark.conf.isModifiable(CLEANUP):
        yield
        return
    # The key of a session, which all its Python objects share.
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if not _writing[session]:
            _as_found[session] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writing[session] += 1
    try:
        yield
    finally:
        with _lock:
            _writing[session] -= 1
            if not _writing[session]:
                spark.conf.set(CLEANUP, _as_found.pop(session))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read back.

    Cuts the lineage for results used several times, and outlives executors.
    What was shuffled for it is removed.
    """
    path = shared_folder(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def side_by_side(jobs: Iterable[Callable[[], _T]]) -> list[_T]:
    """Results of functions that start Spark jobs of their own, run at the same time; the first failure is raised."""
    jobs = list(jobs)
    inherited = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(inherited(job)) for job in jobs]]
