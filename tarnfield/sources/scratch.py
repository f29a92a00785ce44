"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Planned bytes from which on the size of a table is not known.
_UNKNOWN = 1 << 60
#: Bytes of rows up to which a table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one where a local session names none, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tarnfield-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def _own_prefix(spark: SparkSession) -> str:
    return f"tarnfield-{spark.sparkContext.applicationId}"


def durable(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written as Parquet into the shared folder and read back: computed once, with a short lineage that outlives executors."""
    path = f"{scratch_dir(df.sparkSession)}/{_own_prefix(df.sparkSession)}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_buckets(tables: Sequence[DataFrame], n: int, *keys: str, sort: Sequence[str] = (), page_rows: int = 20_000) -> DataFrame:
    """durable() with the rows of tables of the same columns in n buckets by keys: joins and sums by them need no shuffle. Each task writes a file for each bucket it has rows of.

    Within a file the rows are sorted by sort, so that a filter on its first
    column reads only the pages (of page_rows rows) whose range meets it.
    """
    spark = tables[0].sparkSession
    name = f"tarnfield_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/{_own_prefix(spark)}-{name}"
    for df in tables:
        writer = df.write.mode("append").bucketBy(n, *keys).option("path", path).option("parquet.page.row.count.limit", page_rows)
        (writer.sortBy(*sort) if sort else writer).saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved now, with its buckets, so the catalog's entry can go; the files stay
    spark.sql(f"DROP TABLE {name}")
    return stored


def _delete(spark: SparkSession, folder: str) -> None:
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    for found in system.globStatus(path) or []:
        system.delete(found.getPath(), True)


def forget(*tables: DataFrame) -> None:
    """Delete the files of durable() tables that no later step reads."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


#: What is called when stored tables are deleted, so that nothing keeps them.
on_clear: list[Callable[[], None]] = []


def clear(spark: SparkSession) -> None:
    """Delete all tables that durable() wrote for this application; call it when its results are written."""
    for forgotten in on_clear:
        forgotten()
    _delete(spark, f"{scratch_dir(spark)}/{_own_prefix(spark)}-*")


def _planned_bytes(df: DataFrame) -> int:
    """What the planner expects df to take, from the sizes of its files; an unknown size is a very large number."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def byte_size(df: DataFrame) -> int:
    """Bytes of all rows of df as text, a bound on what they take in memory up to a small factor."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows take at most limit bytes; call it on stored tables. Rows are measured only where the files' sizes leave it open."""
    if not df.columns or limit < _planned_bytes(df) < _UNKNOWN:
        return df
    return F.broadcast(df) if byte_size(df) <= limit else df
