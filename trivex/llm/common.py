"""Helpers the operators of this subpackage share: the shared folder, written tables, checked broadcasts, Arrow text access."""

from __future__ import annotations

import tempfile
import time
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows per Arrow batch: texts can be long, so a batch holds few of them.
ARROW_ROWS = 512
#: Seconds between two times that the driver gives memory back.
EASE_S = 3


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, local masters (tests) get a temporary one; on a cluster that would lose rows, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='trivex-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS):
    """Batches of so many rows for what is run inside (not just planned); then the session's setting is as it was."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """The shuffle files of a table that is written inside go when it is written; Spark else keeps them until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Yields keep(table): the tables that are written inside and not kept are deleted at the end. What is returned must not need them any more."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scratch.pop()
        paths = {getattr(df, "_trivex_path", None) for df in kept}
        for df in mine:
            if df._trivex_path not in paths:
                discard(df)
            elif _scratch:
                _scratch[-1].append(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage, and a lost executor costs no recomputation."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    df.write.parquet(path)
    ease(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._trivex_path = path
    if _scratch:
        _scratch[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_trivex_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has in any case of letters, for columns of a join's other side."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while f"_{n}".lower() in have:
            n = f"_{n}"
        out.append(f"_{n}")
    return out


def checked(side: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """side with a broadcast hint if rows x row_bytes is within BROADCAST_BYTES; else as it is, for a sort-merge join."""
    return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on between tasks, beside an executor's heap, and would keep its peak."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


_eased = float("-inf")


def ease(spark: SparkSession) -> str:
    """The driver's JVM returns freed memory to the system, at most every EASE_S seconds; what it said, empty if it did nothing.

    A plan of many exchanges runs on hundreds of the driver's threads, whose freed native memory the C library keeps, and its planning widens the heap, which G1 keeps. Both otherwise only grow while an operator writes table after table.
    """
    global _eased
    if time.monotonic() - _eased < EASE_S:
        return ""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    try:  # the server's class isn't open to calls, so by its interface
        of, text = jvm.java.lang.Class.forName, "java.lang.String"
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", text, "[Ljava.lang.Object;", f"[L{text};")):
            kinds[i] = of(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        said = str(of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args))
    except Py4JError:  # not in every JVM
        said = ""
    _eased = time.monotonic()
    return said


def trimmed(run):
    """run(batches), which gives its memory back at the end."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without copying; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not wide and not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if "string" in str(col.type) else b"")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def partitions_for(spark: SparkSession, rows: int, per: int) -> int:
    """Enough partitions for rows at per rows each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per))
