"""Evidence spans and where in the documents they lie.

Spans are expressions (functions/spans.py) or joins (places.py); everything after that (histograms, corpus sums, vectors) is
grouped aggregation. No Python runs.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.regex import java_pattern


def evidence(docs: DataFrame, patterns: dict[str, tuple[str, list[str]]], id_col: str = "id") -> DataFrame:
    """id, dimension, start, end and text of all matches; patterns: dimension to its column and expressions, in any case.

    Places count characters. Null texts have none.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = lambda d, c, p: F.transform(S.spans(text(c), java_pattern(p)), lambda s: F.struct(F.lit(d).alias("dimension"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    each = [named(d, c, p) for d, (c, every) in patterns.items() for p in every]
    return S.exploded(docs, F.col(id_col).alias("id"), F.flatten(F.array(*each))).select("id", "x.*")


def histogram(spans: DataFrame, lengths: DataFrame, segments: int = 5) -> DataFrame:
    """id, dimension, segment, n, share and total of every document and dimension; all segments, also those without a span.

    lengths: id and length of the texts. A span counts in the segment that holds its middle. Documents of length zero
    have no place, and spans outside their text are an error.
    """
    of = lengths.select(F.col("id").alias("of"), F.col("length").cast("double").alias("length"))
    rows = spans.join(of, spans["id"] == F.col("of")).where("length > 0")
    valid = (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.col("length"))
    middle = F.try_divide((F.col("start") + F.col("end")) / 2.0, F.col("length"))
    segment = F.when(valid, F.least(F.floor(middle * segments).cast("int"), F.lit(segments - 1))).otherwise(F.raise_error(F.lit("a span lies outside its text")).cast("int"))
    counted = rows.select("id", "dimension", segment.alias("segment")).groupBy("id", "dimension").agg(F.count("*").alias("total"), *(F.count_if(F.col("segment") == k).alias(f"n{k}") for k in range(segments)))
    each = F.array(*(F.struct(F.lit(k).alias("segment"), F.col(f"n{k}").alias("n")) for k in range(segments)))
    return counted.select("id", "dimension", "total", F.explode(each).alias("x")).select("id", "dimension", "x.segment", "x.n", F.try_divide(F.col("x.n").cast("double"), F.col("total").cast("double")).alias("share"), "total")


def bounds(length, segments: int):
    """start and end (characters, rounded half to even) of each segment of a text of a length column."""
    edge = lambda k: F.bround(length * F.lit(k / segments)).cast("int")
    return F.array(*(F.struct(F.lit(k).alias("segment"), edge(k).alias("start"), edge(k + 1).alias("end")) for k in range(segments)))


def corpus_positions(histograms: DataFrame) -> DataFrame:
    """dimension, segment, n, pooled_share (of all spans) and mean_share (of the documents with a span)."""
    sums = histograms.groupBy("dimension", "segment").agg(F.sum("n").alias("n"), F.sum("total").alias("all"), F.avg("share").alias("mean_share"))
    return sums.select("dimension", "segment", "n", F.try_divide(F.col("n").cast("double"), F.col("all").cast("double")).alias("pooled_share"), "mean_share")


def deltas(positions: DataFrame) -> DataFrame:
    """dimension and the pooled and mean share of the last segment less those of the first."""
    first, last = (lambda c: F.min_by(c, "segment")), (lambda c: F.max_by(c, "segment"))
    return positions.groupBy("dimension").agg((last("pooled_share") - first("pooled_share")).alias("pooled_delta"), (last("mean_share") - first("mean_share")).alias("mean_delta"))


def position_report(histograms: DataFrame, lengths: DataFrame, dimensions: Iterable[str], segments: int = 3) -> DataFrame:
    """One row for each of dimensions: where in the texts its spans lie, over all documents.

    segments, document_count (documents with a length), documents_with_evidence, total_occurrences, and by segment
    occurrence_counts, occurrence_shares (all spans weigh the same) and mean_document_shares (all documents with a span do);
    occurrence_delta and mean_document_delta are the last share less the first. Without a span counts and shares are zero and
    the deltas null. Documents of length zero count in document_count only.
    """
    one = F.struct("segment", "n", (F.col("n") / F.col("all")).alias("pooled"), "mean")
    each = histograms.groupBy("dimension", "segment").agg(F.sum("n").alias("n"), F.sum("total").alias("all"), F.avg("share").alias("mean"), F.count("*").alias("docs"))
    wide = each.groupBy(F.col("dimension").alias("of")).agg(F.array_sort(F.collect_list(one)).alias("s"), F.max("docs").alias("docs"), F.max("all").alias("all"))  # segments at most
    asked = histograms.sparkSession.createDataFrame([(d,) for d in dict.fromkeys(dimensions)], "dimension string")
    listed = lambda c, kind: F.coalesce(F.transform("s", lambda x: x[c]), F.array_repeat(F.lit(0).cast(kind), segments))
    delta = lambda c: F.element_at("s", -1)[c] - F.get("s", F.lit(0))[c]
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return asked.join(wide, F.col("dimension") == F.col("of"), "left").select(
        "dimension", F.lit(segments).alias("segments"), lengths.agg(F.count("length")).scalar().alias("document_count"), count("docs").alias("documents_with_evidence"), count("all").alias("total_occurrences"),
        listed("n", "bigint").alias("occurrence_counts"), listed("pooled", "double").alias("occurrence_shares"), listed("mean", "double").alias("mean_document_shares"),
        delta("pooled").alias("occurrence_delta"), delta("mean").alias("mean_document_delta"),
    )


def vectors(values: DataFrame, histograms: DataFrame, dimensions: Iterable[str], segments: int = 5, id_col: str = "id") -> DataFrame:
    """values with total and share of each segment of the asked dimensions; no spans: zeros."""
    dimensions = list(dimensions)
    columns = []
    for d in dimensions:
        of = F.col("dimension") == d
        columns.append(F.max(F.when(of, F.col("total"))).alias(f"{d}__position_total"))
        columns += [F.max(F.when(of & (F.col("segment") == k), F.col("share"))).alias(f"{d}__position_share_{k + 1}") for k in range(segments)]
    wide = histograms.where(F.col("dimension").isin(dimensions)).groupBy(F.col("id").alias("__of")).agg(*columns)
    names = [c for c in wide.columns if c != "__of"]
    return values.join(wide, values[id_col] == F.col("__of"), "left").drop("__of").fillna(0, subset=names)
