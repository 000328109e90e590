"""Places in a total order, without a task that sees the whole table or a whole hot value.

A range partitioning by all columns of the order sorts the rows, so rows that tie in a leading column are spread by the next ones. The sorted rows are written
once; a row's place in its partition is what Spark numbers there, and one count for each partition gives every partition its offset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.sources.scratch import kept


def with_place(df: DataFrame, order: list[Column], name: str = "place", keep: Sequence[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with each row's 1-based place in the order, a long.

    The order should end with a key; rows that tie in all of it take their places in any order. An empty table gives no rows.
    """
    at, part = "_at", "_part"
    columns = [c for c in (df.columns if keep is None else keep) if c != name]
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns, F.monotonically_increasing_id().alias(at))
    rows = kept(sorted_, "ordered").withColumn(part, F.shiftright(at, 33))  # the id is the partition's number, and 33 bits for the row's
    counts = sorted((r[part], r["count"]) for r in rows.groupBy(part).count().collect())  # a row for each partition
    before, offsets = 0, []
    for number, n in counts:
        offsets.append((number, before))
        before += n
    small = df.sparkSession.createDataFrame(offsets, f"{part} long, _before long")
    inside = F.col(at) - F.shiftleft(F.col(part), 33)
    return rows.join(F.broadcast(small), part).withColumn(name, F.col("_before") + inside + 1).drop(at, part, "_before")
