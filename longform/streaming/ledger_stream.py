"""Structured Streaming form of the model-call ledger: new request files are read as a stream, each micro-batch
drops requests already answered (M1), calls the model on the rest (M3) and appends the answers to the response
table. ``foreachBatch`` with a checkpoint location gives one answer per request across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from longform.operators import ledger as M
from longform.sources.tables import path_exists


def answer_stream(spark: SparkSession, requests_path: str, schema, responses_path: str, checkpoint: str,
                  call_fn: M.CallFn = M.fake_model, trigger_once: bool = True):
    stream = spark.readStream.schema(schema).parquet(requests_path)

    def batch(df: DataFrame, epoch_id: int) -> None:
        todo = M.pending(df, spark.read.parquet(responses_path)) if path_exists(spark, responses_path) else df
        M.record(spark, M.call(todo, call_fn), responses_path)

    w = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()
