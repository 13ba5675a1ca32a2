"""Tables settled in the shared folder: where lineage ends and no executor's loss costs anything."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group: what a task holds before it writes.
ROW_GROUP = 32 << 20

_settled: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session, as in tests, may name none and gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back. The files go when they are forgotten or the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if not _settled:
        atexit.register(_sweep)
    _settled.append((spark, path))
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the files of settled frames that nothing will read again."""
    for df in frames:
        path = getattr(df, "_settled", None)
        if path is not None:
            _delete(df.sparkSession, path)
            _settled[:] = [x for x in _settled if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets go of shuffle files that only settled tables came from: Spark drops them when the driver has forgotten their plans. Then trims the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> None:
    """Hands memory that the driver has freed back to the system, of its Python and of its JVM outside the heap.

    glibc keeps freed blocks in an arena for each few threads; compiled plans and fetched results leave hundreds of MB
    there. Where C library or JVM have no such call, nothing happens.
    """
    pa.default_memory_pool().release_unused()
    if (own := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        own(0)
    jvm, array, named = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array, spark.sparkContext._jvm.java.lang.Class.forName
    try:
        # by reflection, as py4j sees no methods of a class that its module keeps to itself
        kinds, args = array(jvm.java.lang.Class, 4), array(jvm.Object, 4)
        for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[k] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        args[2], args[3] = array(jvm.Object, 0), array(jvm.String, 0)
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def _sweep() -> None:
    for spark, path in _settled:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already; what is left is in the cluster's own folder
            return
