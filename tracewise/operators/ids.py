"""Dense 1-based ids in a global order without a single-partition window.

Rows are numbered inside each value of ``part`` (a low-cardinality leading
sort key such as the metric name or window size); a per-part count table --
one row per part -- gives each part its offset.  The result equals
``row_number() OVER (ORDER BY part, order...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_ids(df: DataFrame, part: str, order: list, id_col: str = "id") -> DataFrame:
    w = Window.partitionBy(part).orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(w))
    counts = numbered.groupBy(part).agg(F.count(F.lit(1)).alias("_c"))
    # one row per part: the global window below is over that small table
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return (numbered.join(F.broadcast(offsets), part)
            .withColumn(id_col, (F.col("_o") + F.col("_rn")).cast("long"))
            .drop("_rn", "_o"))
