"""Action memos for many loans at once."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from pdengine.functions.bands import action
from pdengine.functions.wording import escape_xml, memo_summary


def memo_records(loans: DataFrame, epoch: int) -> DataFrame:
    """One memo per loan.

    ``loans(borrower_id, segment, exposure_at_risk, pd_score, band, reason_codes)``;
    the run time is passed in, so a rerun gives the same memos.
    """
    stamp = time.strftime("%Y-%m-%d %H:%M:%S UTC", time.gmtime(epoch))
    exposure, score = F.round("exposure_at_risk", 2), F.round("pd_score", 1)
    summary = memo_summary(
        F.col("borrower_id"), F.col("segment"), exposure, score, F.col("band"), F.col("reason_codes")
    )
    return loans.select(
        F.concat(F.col("borrower_id").cast("string"), F.lit(f"_{epoch}")).alias("memo_id"),
        "borrower_id",
        "segment",
        exposure.alias("exposure_at_risk"),
        score.alias("pd_score"),
        "band",
        "reason_codes",
        action(F.col("band")).alias("recommended_intervention"),
        summary.alias("summary"),
        escape_xml(summary).alias("summary_xml"),
        F.lit(stamp).alias("generated_at"),
    )


def write_memos(memos: DataFrame, path: str, file_format: str = "json") -> None:
    memos.write.mode("overwrite").format(file_format).save(path)
