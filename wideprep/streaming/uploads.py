"""Uploads arriving in a folder, each standardised as one run.

A run of the reference is one upload; here a file stream picks up new
upload files (one file per micro-batch) and ``foreachBatch`` applies the
batch pipeline: ordinal in upload order, header classification,
standardisation, and an append of the canonical rows tagged with the
batch id. The stream's checkpoint gives exactly-once file handling; the
batch writes are idempotent per batch id (overwrite of that partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wideprep.constants import STANDARDS
from wideprep.operators.classify import classify_columns, header_catalogue
from wideprep.operators.ordinal import with_ordinal
from wideprep.operators.standardize import standardize


def standardize_batch(batch: DataFrame, batch_id: int, order_cols: list[str], standards=STANDARDS) -> DataFrame:
    """The batch pipeline for one upload."""
    spark = batch.sparkSession
    raw = with_ordinal(batch, order_cols)
    mapping = classify_columns(header_catalogue(spark, {"upload": [c for c in raw.columns if c != "_row_id"]}))
    return standardize(raw, mapping, standards, dataset="upload").withColumn("batch_id", F.lit(batch_id))


def start(spark: SparkSession, source_dir: str, schema: str, out_dir: str, checkpoint: str,
          order_cols: list[str], fmt: str = "parquet") -> StreamingQuery:
    """Start the stream (``trigger(availableNow=True)`` processes what is there and stops)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).format(fmt).load(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        out = standardize_batch(batch, batch_id, order_cols)
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(out_dir))

    return (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
