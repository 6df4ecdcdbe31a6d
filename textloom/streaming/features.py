"""Row-wise features over streams: the same projection, document by document, without state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import Spec
from ..plans import compile as plans


def streamed_features(docs: DataFrame, trees: list[Spec], id_col: str = "id", text_col: str = "text", **normalization) -> DataFrame:
    """id and all row-wise and derived features of a stream of documents; features over lexicons need a batch."""
    return plans.features(plans.prepared(docs, id_col, text_col, **normalization), trees, None, id_col)


def windowed_means(features: DataFrame, columns: list[str], time_col: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean of features by window of event time; rows later than the watermark are left out."""
    timed = features.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"))
    return timed.agg(F.count("*").alias("documents"), *(F.avg(F.col(f"`{c}`")).alias(c) for c in columns))
