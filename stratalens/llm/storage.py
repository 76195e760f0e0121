"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local one is set for the session if the executors run in
    the driver's process; on a cluster they couldn't see it, and that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratalens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Smaller Arrow batches for the session: texts are long, and a worker holds a batch several times over."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def written(df: DataFrame, tag: str, partitions: int | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: lost executors then cost no recomputation.

    The files belong to the session's checkpoint folder; `discard` deletes those that nothing needs any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def trained(rows: DataFrame, train: Callable[[Iterator[pa.RecordBatch]], dict]) -> dict:
    """The model that `train` makes of `rows`, a bounded sample, in one executor task; only the model comes to the driver.

    Rows come in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(batches), 5)], pa.binary())], ["model"])

    made = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else train(iter(()))


def _at(df: DataFrame, path: str | None) -> DataFrame:
    df.written_at = path
    return df


def derived(df: DataFrame, source: DataFrame) -> DataFrame:
    """`df`, which stands on the written table `source` alone: discarding it discards that table."""
    return _at(df, getattr(source, "written_at", None))


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables that nothing reads any more: what came from them is written itself."""
    for df in tables:
        if path := getattr(df, "written_at", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            df.written_at = None


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, once more after its listeners have let go of them, and gives memory of the
    driver back that many small stages have taken: the heap's by collections, then what the JVM has freed outside its heap."""
    for pause in (0.2, 0.0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)
    trim_native(spark)


def trim_native(spark: SparkSession) -> bool:
    """Gives the system back what the driver's JVM has freed outside its heap and the C library keeps, mostly memory of its compilers; that
    grows with every stage planned. False where the JVM has no such command: it then keeps the memory."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # By the public interface: the server's own class is closed to callers.
    kinds = gateway.new_array(jvm.java.lang.Class, 4)
    for k, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = jvm.java.lang.Class.forName(kind)
    given = gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, given)
    except Py4JJavaError:
        return False
    return True


@contextmanager
def small_steps(spark: SparkSession) -> Iterator[None]:
    """For iterations of many small jobs: plans run without code generation for whole stages, so that the driver doesn't generate and
    compile code for hundreds of stages that are each run once, and their descriptions, which the driver renews after every stage and
    keeps, are cut."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.maxPlanStringLength": "8192"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
