"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import gc

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .textcore import give_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and go on from there, so that it is
    computed once and a lost executor costs no recomputation of what lies before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that nothing refers to any
    more, and return the driver's freed memory to the system.  Spark's cleaner learns of them
    from the driver's garbage collector, which by itself may come only after a whole job."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()
    trim_native_heap(spark)


def trim_native_heap(spark: SparkSession) -> bool:
    """Have the driver's JVM return what its C allocator keeps of freed memory (compilers, network
    and file buffers).  False on a JVM without that command; OpenJDK 17 on Linux has it."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    objects = lambda *x: _filled(new_array(jvm.Object, len(x)), x)
    try:
        # the server's class is not public, so its method is taken from the interface
        (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
        command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, objects(command, "systemTrimNativeHeap", None, None))
        return True
    except Py4JError:
        return False


def _filled(array, values):
    for i, v in enumerate(values):
        array[i] = v
    return array


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Names that clash with no column of ``df`` (underscores are appended)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in its order."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(one, ",")


def span_digest(spans: Column) -> Column:
    return F.sha2(F.encode(span_list(spans), "UTF-8"), 256)


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def number_rows(df: DataFrame, *identity: str, text: str, key: str, nth: str) -> DataFrame:
    """``df`` with a null-safe ``key`` of the identity columns and the text's hash, and
    ``nth``, which numbers rows that agree in all of them.  Both are the same whenever the
    rows are read again, so a narrow table of decisions can be joined back."""
    k = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(identity)], F.xxhash64(F.col(text).cast("string")).alias("t"))
    return (df.withColumn(key, k)
            .withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders of this package in whatever store they are."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
