"""Counting what lies within reach on a line, by ranks instead of by pairs.

How many points of a group lie between ``x - reach`` and ``x + reach`` is the difference of two
ranks. Points and the two ends of every window are put in one order of (group, place), dealt
by ranges, and given their prefix sums: sums inside a range, plus the sum of the ranges before
it. Only one row for each range is ordered as a whole. A window lies in one group, so the sums
need not begin anew with each group, and a group that holds a third of all points is cut into
as many ranges as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerrecon.functions import ref
from ledgerrecon.session import shared_path

_END, _POINT, _START = 2, 1, 0


def sums_within(points: DataFrame, group: Sequence[str], at: str, counts: Sequence[str], reach: Decimal) -> DataFrame:
    """``points`` with ``within_<count>`` for each count: its sum over the group's points at most ``reach`` away.

    ``points`` has one row for each (group, at), without NULLs; ``at`` is a decimal with no more places than
    ``reach``. Borders belong to the window. The ordered events are staged once, below the shared folder.
    """
    spark = points.sparkSession
    place = "decimal(38,9)"
    nothing = [F.lit(0).cast("bigint").alias(c) for c in counts]
    own = [ref(c).cast("bigint").alias(c) for c in counts]
    event = lambda kind, shift, sums: F.struct(
        (ref(at).cast(place) + F.lit(shift)).cast(place).alias("__at__"), F.lit(kind).alias("__kind__"), *sums)
    events = points.select(
        *[ref(c) for c in group], ref(at), *[ref(c).alias(f"__own_{c}__") for c in counts],
        F.inline(F.array(event(_START, -reach, nothing), event(_POINT, Decimal(0), own), event(_END, reach, nothing))))
    order = [*[ref(c) for c in group], F.col("__at__"), F.col("__kind__")]
    folder = shared_path(spark, "ranks")
    events.repartitionByRange(*order).withColumn("__range__", F.spark_partition_id()).write.parquet(folder)
    staged = spark.read.parquet(folder)
    so_far = Window.partitionBy("__range__").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("__range__").rowsBetween(Window.unboundedPreceding, -1)
    before = staged.groupBy("__range__").agg(*[F.sum(ref(c)).alias(c) for c in counts]).select(
        "__range__", *[F.coalesce(F.sum(ref(c)).over(earlier), F.lit(0)).alias(f"__before_{c}__") for c in counts])
    ranked = staged.withColumns({f"__sum_{c}__": F.sum(ref(c)).over(so_far) for c in counts})
    ranked = ranked.where(F.col("__kind__") != _POINT).join(F.broadcast(before), "__range__")  # one row for each range
    sign = F.when(F.col("__kind__") == _END, 1).otherwise(-1)
    return ranked.groupBy(*[ref(c) for c in group], ref(at)).agg(
        *[F.max(ref(f"__own_{c}__")).alias(c) for c in counts],
        *[F.sum(sign * (ref(f"__sum_{c}__") + ref(f"__before_{c}__"))).alias(f"within_{c}") for c in counts])

