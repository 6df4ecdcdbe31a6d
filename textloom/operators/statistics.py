"""Statistics over feature tables: summaries, grouped summaries, rankings, sparse and zero-only features."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

# The names of the statistics, in the order of their columns.
STATISTICS = ("count", "missing_count", "missing_ratio", "sum", "mean", "std", "min", "q25", "median", "q75", "max", "mode", "nonzero_count", "nonzero_ratio")


#: Shares of the quantiles; these and the mode come from the counts of distinct values.
QUANTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}
#: Ranges in which a feature's distinct values are counted before the ranks of its quantiles are sought in a few of them.
RANGES = 64


def numeric_columns(df: DataFrame, without: tuple[str, ...] = ("id",)) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in without]


def clean(column: Column) -> Column:
    """As a number; what is none, and NaN, is missing."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def aggregate(statistic: str, v: Column) -> Column:
    """A statistic of the values that are not missing; counts apart, all are null where there are none."""
    missing = F.count("*") - F.count(v)
    return {
        "count": lambda: F.count(v).cast("double"), "missing_count": lambda: missing.cast("double"),
        "missing_ratio": lambda: F.try_divide(missing.cast("double"), F.count("*").cast("double")),
        "sum": lambda: F.sum(v), "mean": lambda: F.avg(v), "std": lambda: F.stddev_samp(v), "min": lambda: F.min(v), "max": lambda: F.max(v),
        "nonzero_count": lambda: F.count_if(v != 0).cast("double"), "nonzero_ratio": lambda: F.avg(F.when(v.isNotNull(), (v != 0).cast("double"))),
    }[statistic]()


def long_values(features: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, feature and value; one row for each document and feature."""
    each = F.array(*(F.struct(F.lit(c).alias("feature"), clean(F.col(f"`{c}`")).alias("value")) for c in columns))
    return features.select(*keys, F.explode(each).alias("x")).select(*keys, "x.feature", "x.value")


def value_counts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, value and __n: how often each value that is not missing stands."""
    return rows.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count("*").alias("__n"))


def same(keys: tuple[str, ...], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"__of_{k}"]) for k in keys))


def renamed(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.withColumnsRenamed({k: f"__of_{k}" for k in keys})


def exact_quantiles(counts: DataFrame, keys: tuple[str, ...], shares: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """keys and a column for each share, interpolated between the two nearest ranks; counts: keys, value, __n.

    Approximate cuts deal the distinct values of a group to ranges. Counts of the ranges tell in which few of them the ranks
    lie, and only these are sorted, each by itself. So the result is exact whatever the cuts, no state grows with the distinct
    values, and a group that holds most of the rows is sorted by many tasks.
    """
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("value", [k / ranges for k in range(1, ranges)], 1_000).alias("__cuts"))
    of_cuts = renamed(cuts, keys)
    dealt = counts.join(of_cuts, same(keys, counts, of_cuts)).select(*keys, "value", "__n", F.size(F.filter("__cuts", lambda c: c < F.col("value"))).alias("__range"))
    group, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__m"))
    sizes = sizes.select("*", F.sum("__m").over(group).alias("__all"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))  # ranges rows a group
    place = lambda share: (F.col("__all") - 1) * F.lit(share)
    ends = {s: (F.floor(place(share)), F.ceil(place(share))) for s, share in shares.items()}
    inside = lambda rank, low, n: (rank >= low) & (rank < low + n)
    sought = sizes.where(reduce(lambda a, b: a | b, (inside(r, F.col("__before"), F.col("__m")) for both in ends.values() for r in both))).drop("__m")
    of_sought = renamed(sought, (*keys, "__range"))
    few = dealt.join(of_sought, same((*keys, "__range"), dealt, of_sought)).select(*keys, "__range", "value", "__n", "__all", "__before")
    ahead = Window.partitionBy(*keys, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = few.withColumn("__low", F.col("__before") + F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    picked = [F.max(F.when(inside(rank, F.col("__low"), F.col("__n")), F.col("value"))).alias(f"__{s}_{k}") for s, both in ends.items() for k, rank in enumerate(both)]
    found = ranked.groupBy(*keys).agg(F.first("__all").alias("__all"), *picked)
    low, high = (lambda s: F.col(f"__{s}_0")), (lambda s: F.col(f"__{s}_1"))
    mixed = lambda s, share: (ends[s][1] - place(share)) * low(s) + (place(share) - ends[s][0]) * high(s)
    return found.select(*keys, *(F.when(low(s) == high(s), low(s)).otherwise(mixed(s, share)).alias(s) for s, share in shares.items()))


def modes(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys and mode: the most frequent value, the smallest of a tie."""
    return counts.groupBy(*keys).agg(F.max(F.struct("__n", (-F.col("value")).alias("less"))).alias("x")).select(*keys, (0.0 - F.col("x.less")).alias("mode"))


def summary(features: DataFrame, columns: list[str] | None = None, statistics: tuple[str, ...] = STATISTICS, by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature and a column for each statistic. Groups with a null key are left out; without by, an empty table has counts of zero.

    One aggregation over the long form: as many rows leave the map side as there are groups and features. Quantiles and modes
    come from the counts of distinct values, which are shuffled once.
    """
    columns = columns or numeric_columns(features, ("id", *by))
    for key in by:
        features = features.where(F.col(key).isNotNull())
    rows, keys = long_values(features, columns, by), (*by, "feature")
    found = rows.groupBy(*keys).agg(F.count("*").alias("__rows"), *(aggregate(s, F.col("value")).alias(s) for s in statistics if s not in QUANTILES and s != "mode"))
    shares = {s: QUANTILES[s] for s in statistics if s in QUANTILES}
    for other in ([exact_quantiles(value_counts(rows, keys), keys, shares)] if shares else []) + ([modes(value_counts(rows, keys), keys)] if "mode" in statistics else []):
        of_other = renamed(other, keys)
        found = found.join(of_other, same(keys, found, of_other), "left").drop(*(f"__of_{k}" for k in keys))
    found = found.select(*keys, *statistics)
    if by:
        return found
    names = features.sparkSession.createDataFrame([(c,) for c in columns], "of_feature string")
    zero = [F.coalesce(s, F.lit(0.0)).alias(s) if s in ("count", "missing_count", "nonzero_count") else F.col(s) for s in statistics]
    return F.broadcast(names).join(found, F.col("of_feature") == F.col("feature"), "left").select(F.col("of_feature").alias("feature"), *zero)


def long_summary(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, feature, statistic and value."""
    names = [c for c in wide.columns if c not in (*by, "feature")]
    each = F.array(*(F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names))
    return wide.select(*by, "feature", F.explode(each).alias("x")).select(*by, "feature", "x.statistic", "x.value")


def ranked(wide: DataFrame, statistic: str = "mean", top: int = 10, bottom: bool = False) -> DataFrame:
    """rank, feature and value of the top (or bottom) features by a statistic; ties by name."""
    order = F.col(statistic).asc() if bottom else F.col(statistic).desc()
    few = wide.where(F.col(statistic).isNotNull()).orderBy(order, "feature").limit(top)  # the report's own length
    return few.select(F.row_number().over(Window.orderBy(order, "feature")).alias("rank"), "feature", F.col(statistic).alias("value"))


def zero_only(wide: DataFrame) -> DataFrame:
    return wide.where("nonzero_count = 0").select("feature")


def sparse(wide: DataFrame, most: float = 0.01) -> DataFrame:
    return wide.where(F.col("nonzero_ratio") <= most).select("feature", "nonzero_ratio").orderBy("nonzero_ratio", "feature")


def with_metadata(features: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """features and the columns of metadata by key; features without metadata keep nulls, several rows of it multiply."""
    other = metadata.select(F.col(key).alias("__key"), *columns)
    return features.join(other, features[key].eqNullSafe(F.col("__key")), "left").drop("__key")


def differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """column, only_in (a, b or both) and rows_differing of two tables by key."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    joined = a.select(key, *(F.col(f"`{c}`").alias(f"a_{c}") for c in shared)).join(b.select(F.col(key).alias("__key"), *(F.col(f"`{c}`").alias(f"b_{c}") for c in shared)), F.col(key).eqNullSafe(F.col("__key")), "full")
    counts = joined.agg(*(F.count_if(~F.col(f"`a_{c}`").eqNullSafe(F.col(f"`b_{c}`"))).alias(c) for c in shared))
    each = [F.struct(F.lit(c).alias("column"), F.lit("both").alias("only_in"), F.col(f"`{c}`").alias("rows_differing")) for c in shared]
    none = F.lit(None).cast("bigint")
    each += [F.struct(F.lit(c).alias("column"), F.lit(side).alias("only_in"), none.alias("rows_differing")) for side, one, two in (("a", a, b), ("b", b, a)) for c in one.columns if c not in two.columns]
    return counts.select(F.explode(F.array(*each)).alias("x")).select("x.*")
