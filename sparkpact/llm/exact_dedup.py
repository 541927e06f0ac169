"""Exact dedup: stateful streaming deduplication.

A Structured Streaming query keeps one entry a digest in RocksDB, without expiry:
the digest, the stable identifier of the row that stays, the locator of its
content and the group's size. Texts never enter the state. Rows whose digest was
met again ("hits") have their full bytes compared; were two different texts ever
to share a digest, the digest's rows are grouped by text instead.

Only digests and locators of all rows are shuffled; text moves for hits alone,
and is aggregated before it moves, so a huge group of copies costs no more
than others.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import KEY, Flat, column, drop, drop_path, join_counted, keyed, materialize, new_path, split_by_keys, tables

#: Most bytes of the spool that one micro-batch takes.
BATCH_BYTES = 1 << 30


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


#: How the state is kept: in RocksDB on the executors' disks, its changes in the checkpoint.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # many small stores: without this each reserves megabytes for its logs
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # an executor's stores share these megabytes, and a store is closed when its task ends
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def state_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of `spark` and those of STATE; other streams of `spark` keep their own."""
    own = spark.newSession()
    for k, v in {**spark.conf.getAll, **STATE}.items():
        with contextlib.suppress(AnalysisException):  # settings of the whole application can't be set, nor need be
            own.conf.set(k, v)
    return own


def dedup_state(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Runs `stream` (_digest, _id, _locator) to its present end; returns its state.

    The state's columns: _digest, _keep (_id, _locator), _size. A later call with
    the same checkpoint goes on where this one ended, with all that it has kept.
    Of equal digests the largest _id stays (nulls are smallest), then the
    largest locator. The stream should come from a state_session().
    """
    spark = stream.sparkSession
    kept = stream.groupBy("_digest").agg(
        F.max(F.struct("_id", "_locator")).alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    query = (
        kept.writeStream.outputMode("update")
        .format("noop")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    fields = state.schema["value"].dataType.names
    # the state's value holds the aggregation's buffers: the kept struct and the count
    return state.select(
        F.col("key")[state.schema["key"].dataType.names[0]].alias("_digest"),
        F.col("value")[fields[0]].alias("_keep"),
        F.col("value")[fields[1]].alias("_size"),
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_of,
    batch_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One row for each row of docs: the row key, _id, _digest, keep_id, group_size, kept.

    Texts are equal when identical; a null text counts as empty, however long a text is
    its whole bytes count. Of equal texts the row with the largest id stays, a null id
    being the smallest; of rows that repeat an id and text too, exactly one stays. An empty table
    gives an empty result. Only the id and the text are read; further columns of docs,
    whatever their names, play no part.
    """
    spark = docs.sparkSession
    own = keyed(docs, _id=column(id_col), _text=F.coalesce(column(text_col), F.lit("")))
    own = own.withColumn("_digest", digest(F.col("_text")))
    spool_path = new_path(spark, "dedup-spool")
    locator = F.struct(*KEY).alias("_locator")
    own.select("_digest", "_id", locator).write.parquet(spool_path)
    spool = spark.read.parquet(spool_path)
    stream = (
        state_session(spark).readStream.schema(spool.schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(spool_path)
    )
    checkpoint = new_path(spark, "dedup-state")
    state = dedup_state(stream, checkpoint)
    path = new_path(spark, "dedup-kept")
    state.write.parquet(path)
    state = spark.read.parquet(path)
    drop_path(spark, checkpoint)

    hits, _ = split_by_keys(own, F.col("_digest"), state.filter("_size > 1").select("_digest"))
    differing = (
        hits.groupBy("_digest").agg(F.min("_text").alias("_lo"), F.max("_text").alias("_hi")).filter("_lo <> _hi")
    )
    differing = materialize(differing.select("_digest"), "dedup-differing")
    out = join_counted(spool, state, "_digest", "_size").select(
        F.col("_locator")[KEY[0]].alias(KEY[0]),
        F.col("_locator")[KEY[1]].alias(KEY[1]),
        "_id",
        "_digest",
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_keep._locator").eqNullSafe(F.col("_locator")).alias("kept"),
    )
    if differing.isEmpty():
        drop(differing)
        return out
    some = own.join(differing, "_digest", "left_semi")
    groups = some.groupBy("_digest", "_text").agg(
        F.max(F.struct("_id", locator)).alias("_keep"), F.count(F.lit(1)).alias("_size")
    )
    groups = materialize(groups, "dedup-by-text")
    exact = some.join(groups, ["_digest", "_text"]).select(
        *KEY,
        "_id",
        "_digest",
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("_keep._locator").eqNullSafe(locator).alias("kept"),
    )
    return out.join(differing, "_digest", "left_anti").unionByName(exact)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents stay when of equal texts the one with the largest doc_id does."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay as they are, whatever their names."""
    flat = Flat(docs)
    with tables(docs.sparkSession):
        gone = exact_dedup(flat.rows, flat.name(id_col), flat.name(text_col)).filter("not kept")
        gone = materialize(gone.select(*KEY), "gone", outlives=True)
    return without_rows(flat, gone)


def without_rows(flat: Flat, gone: DataFrame) -> DataFrame:
    """The table but for the rows whose row keys are in `gone`, a written table. Only rows that may be gone are shuffled."""
    key = F.struct(*KEY)
    maybe, sure = split_by_keys(flat.rows, key, gone.select(key.alias("_k")))
    return flat.restored(sure.unionByName(maybe.join(gone, [*KEY], "left_anti")))
