"""Sharding by Hilbert order: quantise metadata dimensions, sort by curve index, cut runs.

Each dimension is cut at its own quantiles (weighted by rows, in the order of whole values, nulls in the first cell), the cell's
Hilbert index orders the rows, and shards are equal runs of that order. A shard then covers a small
box of every dimension, so a filter on any of them prunes most files. Ties on the curve are
ordered by the tie columns, so a cell that holds a third of all rows is still cut.

Nulls sort first and get the lowest cell; repeated rows keep one place each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobmarket.llm.common import free_name, prefix_sums


def hilbert_distance(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve index of integer cells, an array of shape (rows, dimensions)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work from the top bit down
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _cuts(df: DataFrame, dims: Sequence[str], bits: int) -> dict[str, list]:
    """Values after which a dimension's next cell begins: its quantiles by rows, fewer than 2**bits.

    Numbers are cut by approximate percentiles. Other values (strings of any length and common prefix, dates) are counted, and prefix
    sums over their order give each distinct value its exact quantile; one value for each cell reaches the driver.
    """
    numbers = [d for d in dims if isinstance(df.schema[d].dataType, T.NumericType)]
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(F.count("*").alias("_n"), *[F.percentile_approx(F.col(d).cast("double"), shares, 20_000).alias(f"_c{i}") for i, d in enumerate(numbers)]).first()
    out = {d: sorted(set(found[f"_c{i}"] or [])) for i, d in enumerate(numbers)}
    for d in dims:
        if d not in out:
            counts = prefix_sums(df.where(F.col(d).isNotNull()).groupBy(F.col(d).alias("v")).agg(F.count("*").alias("n")), ["v"], "n")
            counts = counts.withColumn("total", F.lit(max(found["_n"], 1))).withColumn("cell", F.floor((F.col("before") + F.col("n") - 1) * 2**bits / F.col("total")))
            out[d] = sorted(r["v"] for r in counts.groupBy("cell").agg(F.max("v").alias("v")).collect())[:-1]
    return out


def hilbert_shards(df: DataFrame, dims: Sequence[str], tie: Sequence[str], n_shards: int, bits: int = 5) -> DataFrame:
    """Add hilbert (curve index), shard and slot (place in its shard, gapless from 0) to every row.

    Row counts of two shards differ by one at most. Only the cut points, fewer than 2**bits for each
    dimension, and one row for each partition reach the driver. Columns of df by these three names are replaced.
    """
    n, rank, before = df.count(), free_name(df, "_rank"), free_name(df, "_before")
    cells, found = [], _cuts(df, dims, bits)
    for d in dims:
        cuts = found[d]
        value = F.col(d).cast("double") if isinstance(df.schema[d].dataType, T.NumericType) else F.col(d)
        scale = 2**bits // (len(cuts) + 1)  # few distinct values still span the whole axis
        at = sum(((value > F.lit(x)).cast("int") for x in cuts), F.lit(0))
        cells.append(F.coalesce(at, F.lit(0)) * F.lit(scale))

    @F.pandas_udf(T.LongType())
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_distance(np.stack([a.to_numpy() for a in axes], axis=1), bits))

    placed = prefix_sums(df.withColumn("hilbert", index(*[c.cast("long") for c in cells])), ["hilbert", *tie], None, rank=rank, before=before).drop(before)
    shard = F.expr(f"cast({rank} * {n_shards} div {max(n, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {max(n, 1)} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col(rank) - start).drop(rank)
