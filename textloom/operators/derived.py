"""Features of other features: composites over children and ratios of sums."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(0.0))


def composite(strategy: str, children: list[str]) -> Column:
    """Sum (also of an unknown strategy), Avg, Max or Min of the children at hand; without a strategy a null."""
    if not strategy:
        return F.lit(None).cast("double")
    values = [number(c) for c in children]
    if not values:
        return F.lit(0.0)
    name = strategy.removeprefix("CompositeStrategy").lower()
    if name in ("none", "nonestrategy"):
        return F.lit(None).cast("double")
    if name in ("max", "min"):
        return values[0] if len(values) == 1 else (F.greatest if name == "max" else F.least)(*values)
    whole = reduce(lambda a, b: a + b, values)
    return whole / F.lit(float(len(values))) if name == "avg" else whole


def ratio(numerators: list[str], denominators: list[str], scale: float = 1.0, zero_division: float = 0.0) -> Column:
    top, bottom = (reduce(lambda a, b: a + b, map(number, names)) for names in (numerators, denominators))
    return F.coalesce(F.try_divide(top, bottom) * F.lit(float(scale)), F.lit(float(zero_division)))
