"""Applications that arrive as a stream, scored with a fitted model.

Once the references are fixed an application is scored without looking at any
other, so no state or watermark is needed: each micro-batch goes through the
same plan as a table of applications. What a batch stages goes with the batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from pdengine.plans.scoring import score_applications
from pdengine.plans.training import RiskModel
from pdengine.staging import scratch

APPLICATION_SCHEMA = T.StructType([
    T.StructField("application_id", T.LongType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("tenure_months", T.IntegerType()),
    T.StructField("annual_income", T.DoubleType()),
    T.StructField("existing_emi", T.DoubleType()),
    T.StructField("credit_utilization_pct", T.DoubleType()),
    T.StructField("repayment_history", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("rm_note", T.StringType()),
])


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(APPLICATION_SCHEMA).parquet(path)


def score_stream(
    applications: DataFrame, model: RiskModel, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write scores per micro-batch; a batch that is run again replaces its own folder."""

    def score_batch(batch: DataFrame, number: int) -> None:
        with scratch(batch.sparkSession):
            scored = score_applications(model, batch)
            scored.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = applications.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
