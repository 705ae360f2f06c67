"""Confusion metrics, rates and summaries, each one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, and 0 where den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def rate(flag: Column) -> Column:
    """Mean of a boolean; 0 over no rows."""
    return F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))


def confusion_counts(actual: Column, predicted: Column) -> list[Column]:
    """tp, tn, fp, fn. A null prediction (no valid output) counts as wrong in its class."""
    said = F.coalesce(predicted, ~actual)
    return [
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & ~said).alias("tn"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
    ]


def confusion_rates(counted: DataFrame) -> DataFrame:
    """Columns tp, tn, fp, fn to those and eight rates; every zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return counted.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "specificity": specificity,
            "balanced_accuracy": (recall + specificity) / 2,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "mcc": mcc,
        }
    )
