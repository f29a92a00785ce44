"""Memory records that arrive as a stream, appended without duplicates."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarnfield.operators.memory import SCHEMA, identity
from tarnfield.sources.memories import read_memories

_FIELDS = ["id", "created_at", "task", "status", "summary", "files", "decisions"]


def _key() -> Column:
    """128 bits of a memory's identity; its first digit is the bucket."""
    task, files = identity()
    return F.md5(F.to_json(F.struct(task, files)))


def _known(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, batch long, part long, bucket string").parquet(path)


def _identities(spark: SparkSession, path: str, store: str) -> None:
    """Write the keys of what the store holds already, as those of batch -1; only where there are none yet."""
    try:
        _known(spark, path)
    except AnalysisException:
        keys = read_memories(spark, store).select(_key().alias("key")).distinct()
        keys.withColumn("bucket", F.substring("key", 1, 1)).withColumn("batch", F.lit(-1).cast("long")).write.partitionBy("bucket").parquet(f"{path}/part=-1")


def append_batch(batch: DataFrame, batch_id: int, store: str, known: str) -> None:
    """Append to the store the rows of a batch whose identity no earlier batch and not the store's first state has.

    Of equal rows of a batch the first one in the order of files and lines
    counts.  Only keys are compared, of the buckets that the batch touches.
    Both folders have a part for each batch, which a second run of it writes
    anew, without looking at its own keys.
    """
    spark = batch.sparkSession
    spot = ["spot_file", "spot_block", "spot_row"]
    rows = batch.withColumns({"key": _key(), "spot_file": F.col("source_file"), "spot_block": F.col("source_block"), "spot_row": F.monotonically_increasing_id()})
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(*spot))).filter("nth = 1").withColumn("bucket", F.substring("key", 1, 1))
    buckets = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # sixteen at most
    earlier = _known(spark, known).filter(F.col("bucket").isin(buckets) & (F.col("batch") < batch_id)).select("key")
    part = f"{known}/part={batch_id}"
    fresh = first.join(earlier, "key", "left_anti").withColumn("batch", F.lit(batch_id).cast("long"))
    fresh.select(*_FIELDS).write.mode("overwrite").json(f"{store}/batch-{batch_id}")
    fresh.select("key", "bucket", "batch").write.mode("overwrite").partitionBy("bucket").parquet(part)


def append_stream(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Read JSON records from incoming and append those whose identity the store does not have.

    Identities are kept beside the checkpoint in buckets, with the batch that
    brought them, so duplicates are skipped for all time without a watermark and
    the store is read once, when the stream first starts.  A batch that runs
    again after a failure writes the same parts and appends nothing twice.
    """
    known = f"{checkpoint}-identities"
    _identities(spark, known, store)
    stream = spark.readStream.schema(SCHEMA).json(incoming)
    stream = stream.select("*", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("source_block"))
    write = lambda batch, batch_id: append_batch(batch, batch_id, store, known)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
