"""Running sums, maxima and numbers along an order, without one task for a whole key.

The rows are cut into slices of the order, at quantiles of all rows. Within a
slice and key a window runs as usual; what the slices before hold of the key
is a small table of one row a key and slice. A key that holds a third of all
rows is then spread over all slices. A table that fits one slice is one window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, about.
SLICE_ROWS = 2_000_000
_SLICE, _LOCAL, _BEFORE = "__slice", "__local", "__before"


def sliced(df: DataFrame, order: Column) -> tuple[DataFrame, int]:
    """``df`` with a slice number that grows with ``order`` (a number), and how many slices there are; nulls are in the first."""
    with_order = df.withColumn("__order", F.coalesce(order.cast("double"), F.lit(float("-inf"))))
    slices = with_order.count() // SLICE_ROWS + 1
    if slices == 1:
        return with_order.drop("__order").withColumn(_SLICE, F.lit(0)), 1
    finite = with_order.where(~F.col("__order").isin(float("-inf"), float("inf")))
    cuts = sorted(set(finite.approxQuantile("__order", [i / slices for i in range(1, slices)], 0.25 / slices)))
    bounds = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=bounds, inputCol="__order", outputCol=_SLICE).transform(with_order)
    return cut.withColumn(_SLICE, F.col(_SLICE).cast("int")).drop("__order"), len(bounds) - 1


def _running(df: DataFrame, keys: list[str], at: Column, order: list[Column | str], value: Column, name: str, of: Callable[[Column], Column], both: Callable[[Column, Column], Column], last: int) -> DataFrame:
    cut, slices = sliced(df, at)
    valued = cut.withColumn("__value", value)
    within = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = valued.withColumn(_LOCAL, of(F.col("__value")).over(within))
    if slices == 1:
        return local.withColumn(name, F.col(_LOCAL)).drop(_LOCAL, _SLICE, "__value")
    sums = valued.groupBy(*keys, _SLICE).agg(of(F.col("__value")).alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(_SLICE).alias("__s"), of(F.col("__sum")).over(earlier).alias(_BEFORE))
    same = F.col(_SLICE) == F.col("__s")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(before, same, "left").drop("__s", *(f"__k{i}" for i in range(len(keys))))
    return joined.withColumn(name, both(F.col(_BEFORE), F.col(_LOCAL))).drop(_LOCAL, _BEFORE, _SLICE, "__value")


def running_sum(df: DataFrame, keys: list[str], at: Column, order: list[Column | str], value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the key's rows before, and with this one if ``inclusive``; 0 without any.

    ``order`` must begin with what ``at`` is a number of.
    """
    add = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    found = _running(df, keys, at, order, value.cast("long"), name, F.sum, add, 0 if inclusive else -1)
    return found.withColumn(name, F.coalesce(name, F.lit(0)))


def running_max(df: DataFrame, keys: list[str], at: Column, order: list[Column | str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the largest ``value`` of the key's rows before this one; null without any."""
    return _running(df, keys, at, order, value, name, F.max, F.greatest, -1)


def numbered(df: DataFrame, keys: list[str], at: Column, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3 along the order of each key."""
    return running_sum(df, keys, at, order, F.lit(1), name)
