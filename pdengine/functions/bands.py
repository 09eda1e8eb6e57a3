"""Score fusion, risk bands and the action that goes with a band."""

from pyspark.sql import Column, functions as F

from pdengine import fixed_values as fv


def blend(gbm_rank: Column, cox_rank: Column) -> Column:
    return F.lit(fv.GBM_WEIGHT) * gbm_rank + F.lit(fv.COX_WEIGHT) * cox_rank


def band(score: Column, high_cut: Column, elevated_cut: Column) -> Column:
    """An unscored loan has no band."""
    return (
        F.when(score.isNull(), F.lit(None))
        .when(score >= high_cut, F.lit("High"))
        .when(score >= elevated_cut, F.lit("Elevated"))
        .otherwise(F.lit("Watch"))
    )


def action(band_name: Column) -> Column:
    """Recommended action; an unknown or missing band is treated as Watch."""
    named = [F.when(band_name == b, F.lit(text)) for b, text in fv.ACTIONS.items()]
    return F.coalesce(*named, F.lit(fv.ACTIONS["Watch"]))
