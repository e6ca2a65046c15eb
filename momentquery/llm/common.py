"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space, as the contracts name it.
SPACE = r"\x20\x09-\x0D"


#: Texts go to Python in batches of so many bytes; Spark's own bound is sixteen times as large, and both sides hold
#: several batches at once.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes in a session that has not set a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).lower() in ("64mb", "67108864b", "67108864"):
        spark.conf.set(key, BATCH_BYTES)


def prepared(spark: SparkSession) -> None:
    """What Python on the executors needs: the package, and bounded batches. Operators that run Python see to it
    themselves, as their input may come from anywhere, in a session that has read no table by table()."""
    ship(spark)
    bounded_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, columns: list[str]) -> str:
    """The name, with underscores before it until no column has it. Operators add their results under such a name, so
    that no column of their input is ever replaced; names are compared as Spark does, without regard to case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(column: str) -> Column:
    """A column by its very name, dots included."""
    return F.col("`{}`".format(column.replace("`", "``")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders made so far; they go when the driver's process ends, as results may be read until then.
_made: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    if not _made:
        atexit.register(_clean)
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _made:
            removed(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> None:
    """Lets the driver drop what finished steps leave behind. Spark cleans up shuffles and broadcasts when their handles
    are collected, and a driver with much room would collect seldom. What the virtual machine itself has freed, most of it
    the compiler's, stays with the process until it is asked for, too."""
    spark._jvm.java.lang.System.gc()
    with contextlib.suppress(Py4JError):  # not every virtual machine can
        _trim(spark)


def _trim(spark: SparkSession) -> None:
    """The command System.trim_native_heap. Reflection by the interface, as the server's own class is not open."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    given = gateway.new_array(jvm.java.lang.Object, 4)  # the last two, arguments and their types, stay null
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of fresh_path()."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
