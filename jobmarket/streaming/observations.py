"""Streams of observations, pages and status commands, on the batch operators' rules."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from jobmarket.functions.urls import canonical_url
from jobmarket.operators.tracking import verdict_of
from jobmarket.sources.scratch import kept, listed, read_file, remove, write_file


def seen_times(observations: DataFrame) -> DataFrame:
    """First and last sighting of each canonical URL in a batch of observations (url, observed_at)."""
    return observations.groupBy(canonical_url(F.col("url")).alias("source_url")).agg(F.min("observed_at").alias("first_seen_at"), F.max("observed_at").alias("last_seen_at"), F.count("*").alias("n"))


FIRST_DEPTH = 3  # leading bits of a URL's hash that choose its bucket at first
DEPTH = 16  # and at most
BUCKET_ROWS = 2_000_000  # beyond which a bucket is split
KEEP = 3  # newest manifests whose folders stay, for readers and retries


def _slot(url: Column) -> Column:
    """The DEPTH leading bits of a URL's hash."""
    return F.call_function("shiftrightunsigned", F.xxhash64(url), F.lit(64 - DEPTH)).cast("int")


def _directory(spark: SparkSession, buckets: list[dict]) -> DataFrame:
    """slot, bucket: the bucket (its place in the list) of each slot; 65,536 rows at most."""
    rows = [(n, b["bits"] << (DEPTH - b["depth"]), (b["bits"] + 1) << (DEPTH - b["depth"])) for n, b in enumerate(buckets)]
    ranges = spark.createDataFrame(rows, "bucket int, low int, high int")
    return ranges.select("bucket", F.explode(F.sequence("low", F.col("high") - 1)).alias("slot"))


def _split(bucket: dict, rows: int, limit: int) -> list[dict]:
    """A bucket that would hold too many rows becomes two, four and so on."""
    more = 0
    while rows >> more > limit and bucket["depth"] + more < DEPTH:
        more += 1
    return [{"depth": bucket["depth"] + more, "bits": (bucket["bits"] << more) + n, "folder": None, "rows": 0} for n in range(1 << more)]


def merge_batches(path: str, bucket_rows: int = BUCKET_ROWS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps first/last sightings under path, in buckets by a hash of the URL.

    Each batch leaves a manifest, path/manifest/<batch>: every bucket with its leading bits, its folder and its rows. A batch reads the manifest before its own, reads and
    rewrites the buckets that it touches, and splits those that have grown beyond bucket_rows, so a batch costs what it touches, however many
    batches and buckets there are. A batch that is run again starts from the same manifest and writes its own once more. Manifests beyond the newest KEEP go, with the
    folders that only they name.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _manifests(spark, path)  # KEEP + 1 names at most
        before = [n for n in known if n < batch_id]
        buckets = _read(spark, path, before[-1]) if before else [{"depth": FIRST_DEPTH, "bits": n, "folder": None, "rows": 0} for n in range(1 << FIRST_DEPTH)]
        new = seen_times(batch).withColumn("slot", _slot(F.col("source_url")))
        new = kept(new, "sightings")  # counted, then merged
        grown = {r["bucket"]: r["count"] for r in new.join(F.broadcast(_directory(spark, buckets)), "slot").groupBy("bucket").count().collect()}  # a row for each bucket
        after, held = [], []
        for n, bucket in enumerate(buckets):
            if n not in grown:
                after.append(bucket)
                continue
            held += [bucket["folder"]] if bucket["folder"] else []
            after += _split(bucket, bucket["rows"] + grown[n], bucket_rows)
        if held:
            old = spark.read.parquet(*[f"{path}/{f}" for f in held]).withColumn("slot", _slot(F.col("source_url")))
            merged = old.select(*new.columns).unionByName(new).groupBy("source_url", "slot")
            new = merged.agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("n").alias("n"))
        placed = new.join(F.broadcast(_directory(spark, after)), "slot").drop("slot")
        folder = f"data/batch={batch_id}"
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
        sizes = {r["bucket"]: r["count"] for r in spark.read.parquet(f"{path}/{folder}").groupBy("bucket").count().collect()} if grown else {}
        for n, rows in sizes.items():
            after[n] = {**after[n], "folder": f"{folder}/bucket={n}", "rows": rows}
        write_file(spark, f"{path}/manifest/{batch_id:012d}", json.dumps(after), replace=True)
        _clear(spark, path, sorted({*known, batch_id}))

    return merge


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(name) for f in listed(spark, f"{path}/manifest/*") if (name := f.rsplit("/", 1)[1]).isdigit())


def _read(spark: SparkSession, path: str, batch: int) -> list[dict]:
    return json.loads(read_file(spark, f"{path}/manifest/{batch:012d}"))


def _clear(spark: SparkSession, path: str, known: list[int]) -> None:
    """Remove manifests beyond the newest KEEP, and folders that no other one names."""
    named = lambda batch: {b["folder"] for b in _read(spark, path, batch) if b["folder"]}
    stay = set().union(*map(named, known[-KEEP:]))
    for batch in known[:-KEEP]:
        for folder in named(batch) - stay:
            remove(spark, f"{path}/{folder}")
        remove(spark, f"{path}/manifest/{batch:012d}")


def read_sightings(spark: SparkSession, path: str) -> DataFrame:
    """source_url, first_seen_at, last_seen_at, n after the newest batch."""
    known = _manifests(spark, path)
    folders = [f"{path}/{b['folder']}" for b in _read(spark, path, known[-1]) if b["folder"]] if known else []
    if not folders:
        return spark.createDataFrame([], "source_url string, first_seen_at timestamp, last_seen_at timestamp, n long")
    return spark.read.parquet(*folders).select("source_url", "first_seen_at", "last_seen_at", "n")


def write_sightings(observations: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return observations.writeStream.foreachBatch(merge_batches(path)).option("checkpointLocation", checkpoint)


def first_arrivals(pages: DataFrame, delay: str = "1 day") -> DataFrame:
    """Pages whose canonical URL was not met within the watermark's delay. pages: url, arrived_at (timestamp)."""
    return pages.withColumn("source_url", canonical_url(F.col("url"))).withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["source_url"])


EVENTS = "vacancy_source_url string, id long, previous_status string, new_status string, verdict string"


class StatusMachine(StatefulProcessor):
    """The current status of one application; commands arrive in batches and are taken in order of their ids, by the rules of the batch fold."""

    def __init__(self, unknown: str | None) -> None:
        self.unknown = unknown  # status of an application that is not stored

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        self.status.update((initialState["status"].iloc[0],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = self.status.get()[0] if self.status.exists() else self.unknown
        out = []
        for c in pd.concat(list(rows)).sort_values("id").itertuples():
            said = verdict_of(now, c.new_status, c.kind, c.reason)
            out.append((key[0], c.id, now, c.new_status, said))
            now = c.new_status if said == "accepted" else now
        if now is not None:
            self.status.update((now,))
        yield pd.DataFrame(out, columns=["vacancy_source_url", "id", "previous_status", "new_status", "verdict"])

    def close(self) -> None:
        pass


def status_stream(commands: DataFrame, applications: DataFrame | None = None) -> DataFrame:
    """Verdicts of a command stream (id, vacancy_source_url, new_status, kind, reason).

    applications (vacancy_source_url, status; one row each): the stored statuses, which the first batch takes as initial state; an application that is not
    stored has none, as in the batch fold. Without them every application starts as Saved.
    """
    stored = None if applications is None else applications.select("vacancy_source_url", "status").where("status is not null").groupBy("vacancy_source_url")
    machine = StatusMachine("Saved" if applications is None else None)
    return commands.groupBy("vacancy_source_url").transformWithStateInPandas(machine, outputStructType=EVENTS, outputMode="append", timeMode="None", initialState=stored)


def use_state_store(spark: SparkSession) -> None:
    """status_stream needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
