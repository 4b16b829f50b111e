"""Session defaults and the shared folder for staged tables."""

from __future__ import annotations

import gc
import os
import tempfile
import threading
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, suppress
from contextvars import ContextVar, copy_context
from pathlib import Path
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

Result = TypeVar("Result")

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    # Call-site capture on every column expression doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key may be re-aggregated on the join key; splitting it is worth the extra shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "caregauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; on a cluster the submit command supplies master and sizes."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session may fall back to a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="caregauge-"))
    return context.getCheckpointDir()


def file_bytes(table: DataFrame) -> int:
    """Size of a table's files, as the optimizer sees it."""
    return int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


_scope: ContextVar[str | None] = ContextVar("staging folder", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block go when it ends; use their results before.

    The folder is that of a database made for the block, so that dropping the database deletes it, on any
    file system and nothing besides.
    """
    name = f"caregauge_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark).rstrip('/')}/{name}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def scratch_folder(spark: SparkSession) -> str:
    """Where staged tables go: the folder of the `staging` block, if any, else the shared folder."""
    return (_scope.get() or shared_folder(spark)).rstrip("/")


# Seconds that a job must take for its shuffle files to be let go at once.
LONG_JOB = 3
# Seconds after which Python collects its garbage then, and as many later the JVM.
PUT_OFF = 1.5


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files that nothing refers to any more.

    It does so when the driver's JVM collects its garbage, which may not happen for the half hour of its timer. Python
    has to drop its objects first, those of the caller's last step too, Py4J tells the JVM about a second late, and the
    JVM needs two collections: so all that happens a little later, and nobody waits for it.
    """
    collect = spark.sparkContext._jvm.System.gc

    def later() -> None:
        gc.collect()
        time.sleep(PUT_OFF)
        # The session may be over by then.
        with suppress(Exception):
            collect()
            time.sleep(PUT_OFF)
            collect()

    timer = threading.Timer(PUT_OFF, later)
    timer.daemon = True
    timer.start()


def stage(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Later reads see the same rows and row ids even after executors are lost, the lineage is cut, and
    the optimizer gets real sizes. Inside `staging` the table goes with the block, else it stays. The shuffle files
    of a long job go as soon as it is done.
    """
    return stage_parts([df])


def stage_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """Write frames of the same columns into one staged table, one after the other."""
    path, spark, schema = "", None, None
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or f"{scratch_folder(spark)}/staged-{uuid.uuid4().hex}"
        began = time.monotonic()
        df.write.mode("append").parquet(path)
        if time.monotonic() - began > LONG_JOB:
            release(spark)
    return spark.read.schema(schema).parquet(path)


def side_by_side(spark: SparkSession, jobs: Sequence[Callable[[], Result]], width: int) -> list[Result]:
    """The results of independent jobs, so many of them at a time; they stage where the caller does."""
    with ThreadPoolExecutor(width) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(copy_context().run), job) for job in jobs]
        return [r.result() for r in running]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per session; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_caregauge_shipped", False):
        return
    package = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="caregauge-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, path.relative_to(package.parent))
    context.addPyFile(target)
    context._caregauge_shipped = True


# Rows of a fit in one partition; a dozen numbers a row take some 50 MB.
ROWS_PER_PART = 500_000
LEAST_PARTS = 16


def layout(rows: int, rows_per_part: int = ROWS_PER_PART, least: int = LEAST_PARTS) -> int:
    """Partitions for a fit on so many rows: from the rows alone, so that a task's size is bounded on any machine."""
    return max(least, -(-rows // rows_per_part))


def settled(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """df dealt by a unique key into so many sorted partitions: the same layout on any machine.

    For fits that draw random numbers per partition. `partitions` is a parameter of the fit or follows from
    its rows (`layout`); it is never taken from the machine.
    """
    return df.repartition(partitions, key).sortWithinPartitions(key)
