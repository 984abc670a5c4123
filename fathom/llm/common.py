"""Helpers shared by the operators: shared-folder tables and input columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
#: Spark's switch that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For a write: shuffle files go at its end, and the driver keeps a bounded description of the plan, whose literals can be long.
WRITING = {CLEANUP: "true", "spark.sql.maxPlanStringLength": "16384"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only where that is unset and Spark runs in one process, as in tests, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, survives lost executors. The write's shuffle files go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.path_of_table = path
    return out


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage once its heap has grown past half of its bound: plans of ended queries, and their broadcasts on the executors, stay until then."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def released(run):
    """run, a function over Arrow batches, at whose end an idle worker gives back the memory that it has freed."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "path_of_table", None):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row. Rows that come straight from files have the same numbers whenever they are read; others are written once, with their numbers."""
    out = df.withColumn(name, F.monotonically_increasing_id())
    plan = df._jdf.queryExecution().sparkPlan().toString()
    nodes = re.findall(r"^[ :+*()\d|-]*([A-Z]\w*)", plan, re.MULTILINE)
    return out if set(nodes) <= {"FileScan", "Project", "Filter"} else written(out, "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The runs of characters that are no ASCII white space, in order."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, as no column of df is called."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
