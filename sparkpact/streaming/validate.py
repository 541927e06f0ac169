"""Validation and decoding of streams (an extension: no reference semantics).

Both look at one row at a time, so a stream needs no state, watermark or shuffle for them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contract import Request


def validated_stream(stream: DataFrame, request: Request, body: str) -> DataFrame:
    """The stream with `errors`; the plan is that of a batch."""
    return stream.withColumn("errors", request.body_errors(F.col(body)))


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver can all write: spark.checkpoint.dir, or a local folder in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkpact-")
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def written(stream: DataFrame) -> DataFrame:
    """Runs the stream over what there is and gives the table that it wrote, each row once."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
