"""Reading tables, the shared scratch folder, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a class for Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, by Spark's reader alone, so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder that driver and executors share, spark.checkpoint.dir. Where
    that is unset a temporary one is made, on a single machine alone (tests). It goes when Spark ends."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="kvlog-")
        context._conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/kvlog-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(own)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return own


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a
    lost executor costs no more than the reading. The files stay until ``release`` or Spark's end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage, upon which Spark drops shuffle files and broadcasts that nothing needs,
    and give free native memory back, where the JVM has that command (JDK 17 on Linux). Both would else grow
    over many steps, as the heap is rarely collected whole and each step starts threads."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    try:
        given = new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # The server's own class is closed to reflection, its interface is open.
        server, open_to = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")
        next(m for m in open_to.getMethods() if m.getName() == "invoke").invoke(server, given)
    except Py4JError:
        pass  # another JVM


def release(spark: SparkSession) -> None:
    """Delete what ``materialise`` has written in this application."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(col: str = "text"):
    """The text's UTF-8 bytes; null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
