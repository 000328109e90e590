"""Shared building blocks of the training-data operators.

Everything here is a Spark job over narrow rows: written intermediate tables in the
cluster's shared folder, prefix sums over a total order, and connected components.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as every contract of this subpackage counts it.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a new one in local mode; on a cluster the job fails."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext.getCheckpointDir()
    return str(current).rstrip("/")


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (by: a folder for each value) and read it back: cuts lineage and fixes row placement."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 250_000  # of a few longs each; a join side beyond it is shuffled


def sized(df: DataFrame) -> DataFrame:
    """df as the small side of a join: broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def free_name(df: DataFrame, name: str, *more: str) -> str:
    """name, with underscores before it until no column of df (and none of more) bears it."""
    taken = {c.lower() for c in (*df.columns, *more)}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def file_rows(docs: DataFrame, row: str) -> DataFrame:
    """Add a long that names each row by its file and its place there; docs must be a table as read from files.

    The name is the same whichever task reads the row and however the files are split, so a second read finds it again.
    """
    if "_metadata" in {c.lower() for c in docs.columns}:  # hides the place in the file
        return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    file, place = free_name(docs, "_file"), free_name(docs, "_place")
    placed = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    files = sorted(r[0] for r in placed.select(file).distinct().collect())  # as many as the table has files
    names = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"`{file}` string, `{row}` long")
    numbered = placed.join(F.broadcast(names), file) if len(files) <= BROADCAST_ROWS else placed.join(names, file)
    return numbered.withColumn(row, F.shiftleft(row, 40) + F.col(place)).select(*docs.columns, row)


def prefix_sums(df: DataFrame, order: Sequence[str], value: str | None, group: str | None = None, rank: str = "rank", before: str = "before") -> DataFrame:
    """Add `rank` (rows before) and `before` (sum of `value` before) in the total order group, *order.

    With a group both count inside the group (null is a group of its own). A range partitioning
    sorts the rows, each task numbers its own rows, and one row per partition carries the
    offset of the group that goes on from the partitions before it: no task sees a whole group, so a
    group with a third of all rows is split over many partitions, and however many groups there are, the driver sees one row per
    partition. The sorted rows are written once, hence rows that tie in every order column keep
    one place. Columns of df called `rank` or `before` are replaced.
    """
    spark = df.sparkSession
    df = df.drop(*{rank, before} - {group, value, *order})
    keys = ([group] if group else []) + list(order)
    pid_, rank_, sum_ = (free_name(df, c, rank, before) for c in ("_pid", "_rank", "_sum"))
    schema = T.StructType([*df.schema.fields, T.StructField(pid_, T.IntegerType()), T.StructField(rank_, T.LongType()), T.StructField(sum_, T.LongType())])

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = TaskContext.get().partitionId()
        last, n, total = object(), 0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            add = pdf[value].fillna(0).astype("int64") if value else pd.Series(0, index=pdf.index)
            if group:
                g = pdf[group]
                change = (g != g.shift()) & ~(g.isna() & g.shift().isna())
                change.iloc[0] = True
                run = change.cumsum()
            else:
                run = pd.Series(1, index=pdf.index)
            place, sums = run.groupby(run).cumcount(), add.groupby(run).cumsum() - add
            first = g.iloc[0] if group else None
            same = first == last or (first is None and last is None)
            head = (run == 1) if same else (run == 0)
            place, sums = place + head * n, sums + head * total
            n, total = int(place.iloc[-1]) + 1, int(sums.iloc[-1] + add.iloc[-1])
            last = g.iloc[-1] if group else None
            yield pdf.assign(**{pid_: pid, rank_: place.astype("int64"), sum_: sums.astype("int64")})

    ranged = df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys])
    local = written(ranged.mapInPandas(number, schema), "ordered")
    g = F.col(group) if group else F.lit(None).cast("string")
    size = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    totals = local.groupBy(F.col(pid_).alias("pid"), g.alias("g")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("s"))
    ends = totals.groupBy("pid").agg(F.min(F.struct("g", "n", "s")).alias("first"), F.max(F.struct("g", "n", "s")).alias("last")).collect()
    offsets, held = [], None
    for row in sorted(ends, key=lambda r: r["pid"]):  # one row per partition
        first, last = row["first"], row["last"]
        n0, s0 = held[1:] if held and held[0] == first["g"] else (0, 0)
        if n0:
            offsets.append((row["pid"], first["g"], n0, s0))
        if first["g"] == last["g"]:
            held = (first["g"], n0 + first["n"], s0 + first["s"])
        else:
            held = (last["g"], last["n"], last["s"])
    kind = local.schema[group].dataType if group else T.StringType()
    opid, og, n0, s0 = (free_name(local, c, rank, before) for c in ("_opid", "_group", "_n0", "_s0"))
    small = spark.createDataFrame(offsets, T.StructType([T.StructField(opid, T.IntegerType()), T.StructField(og, kind), T.StructField(n0, T.LongType()), T.StructField(s0, T.LongType())]))
    goes_on = F.col(opid).isNotNull() & g.eqNullSafe(F.col(og))
    return (
        local.join(F.broadcast(small), F.col(pid_) == F.col(opid), "left")  # a row for each partition at most
        .withColumn(rank, F.col(rank_) + F.when(goes_on, F.col(n0)).otherwise(0))
        .withColumn(before, F.col(sum_) + F.when(goes_on, F.col(s0)).otherwise(0))
        .drop(pid_, rank_, sum_, opid, og, n0, s0)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component = smallest node.

    Alternating large-star and small-star rounds, each a group-by and a join; the edge table is
    written to the shared folder after each round, so a lost executor costs one round. A node with
    very many neighbours is aggregated by min with map-side combine, never collected.
    """
    def key(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("x")).first())

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = key(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: every larger neighbour of a node links to the node's smallest neighbour (or itself)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = big.where("a <> b").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct(), "edges")
        after = key(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
