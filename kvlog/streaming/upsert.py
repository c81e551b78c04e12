"""Streams into a store and newest values over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import KVStore


def into_store(stream: DataFrame, store: KVStore, checkpoint: str, key: str = "key", value: str = "value", seq: str = "seq"):
    """A writer whose micro-batches become runs. The rows keep their seq, so a late write with a lower one
    loses in whichever batch it comes. A batch that comes again after a failure is known by the checkpoint
    and its number, which stand in the manifest's commit, and is left."""
    put = lambda batch, n: store.put_df(batch, key, value, seq, keep_seq=True, batch=(checkpoint, n))
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)


def newest_stream(stream: DataFrame) -> DataFrame:
    """The newest value of each key so far (update or complete mode): a late write with a lower seq loses."""
    top = F.max_by(F.struct("value", "seq"), "seq").alias("top")
    return stream.groupBy("key").agg(top).select("key", "top.*")
