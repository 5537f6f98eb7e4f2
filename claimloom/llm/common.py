"""What the operators of this folder share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: A word for the operators that count or shingle: a run of anything but these.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Holds what a Python worker gets at once to some megabytes of text, whatever the rows' lengths; sizes that the session has set smaller stay.

    The settings are read when a plan runs, after the operator has returned it, so they stay in the session."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = str(spark.conf.get(name)).rstrip("b")
        if not now.isdigit() or int(now) > most or int(now) <= 0:
            spark.conf.set(name, str(most))


def give_back() -> None:
    """Returns what a Python worker has freed to the system; a worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # the C library may have no such function
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Returns what the driver's JVM has freed to the system: the C library keeps what compilers of many plans leave. Nothing happens where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    with contextlib.suppress(Py4JError):
        of = jvm.java.lang.Class.forName
        kinds, given = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        kinds[0], kinds[1], kinds[2], kinds[3] = of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method: the server's own class is closed to others
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of the driver's rows, handed over as Arrow: plain lists would start Python workers on the executors."""
    columns = list(zip(*rows)) or [()] * len(schema)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a folder of our own only where the session names none and runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="claimloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Folders that stash has written and discard has not deleted.
_written: list[str] = []


def stash(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors lose nothing. The folder stays until ``discard``.

    few: a table of narrow rows, written as two files a core at most instead of one for each partition."""
    spark = df.sparkSession
    if few:
        df = df.coalesce(2 * max(1, spark.sparkContext.defaultParallelism))
    path = f"{shared_dir(spark).rstrip('/')}/claimloom/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)  # on a local store each such file starts two shells
    _written.append(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *more: str) -> None:
    """Deletes what stash has written so far, and more folders; results that read from them must have been written elsewhere."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in [*_written, *more]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    _written.clear()
    trim_driver(spark)


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names that no column of the input bears, in either case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


#: Ids that may be broadcast at once: 16 MB of longs, some 50 MB as a hash table.
BROADCAST_IDS = 2_000_000


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """df semi- or anti-joined to a written table of distinct ids: by broadcast if its count is small, else by a shuffle."""
    (name,) = fresh(df.columns, "id_")
    ids = ids.toDF(name)
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = ids.hint("broadcast")
    return df.join(ids, df[key] == ids[name], how)
