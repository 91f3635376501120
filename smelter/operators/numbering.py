"""Row numbers over a whole table without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from smelter.session import shared_folder

# Fixed by Spark: monotonically_increasing_id puts the partition above this bit.
_PARTITION_BIT = 33


def number_rows(df: DataFrame, order_by: Sequence[Column], out: str = "row_number") -> DataFrame:
    """Number all rows from 1 in ``order_by``, which has to decide every tie.

    Rows are range-partitioned and sorted, then fixed by a reliable checkpoint, since
    range bounds are sampled and may differ when a lost task is run again. Row counts
    per partition (one row each) give every partition its offset.
    """
    shared_folder(df.sparkSession)
    ranged = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_place", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_place", _PARTITION_BIT)
    within = F.col("_place") - F.shiftleft(part, _PARTITION_BIT)
    placed = ranged.withColumns({"_part": part, "_within": within}).drop("_place")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg((F.max("_within") + 1).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"))
    )
    # One row per range partition: bounded by the number of shuffle partitions.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + F.col("_within") + 1)
        .drop("_part", "_within", "_offset")
    )
