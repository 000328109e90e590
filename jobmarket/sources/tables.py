"""Files in and out: profiles, URL lists, CSV reports, CV texts, and state tables kept as versions."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.functions.text import cefr, decoded_bytes, work_modes, work_modes_from_json, years
from jobmarket.functions.urls import url_list
from jobmarket.operators.order import with_place
from jobmarket.operators.ranking import REPORT_FIELDS, report_order
from jobmarket.operators.score import PROFILE
from jobmarket.sources.scratch import listed, read_file, scratch_folder, write_file  # noqa: F401  scratch_folder: for those who read and write tables

CV_LIMIT = 24_000
PROFILE_JSON = (
    "name string, target_roles array<string>, skills array<string>, must_have_skills array<string>, nice_to_have_skills array<string>, preferred_locations array<string>, "
    "additional_keywords array<string>, excluded_keywords array<string>, experience_level string, years_of_experience string, salary_expectation string, max_english_level string, "
    "work_modes string, _corrupt_record string"
)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles from a folder of JSON files, one each; files that do not parse or lack a name and skills are left out."""
    raw = spark.read.schema(PROFILE_JSON).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    raw = raw.withColumn("profile_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1))
    return normal_profiles(raw.where("_corrupt_record is null and name is not null and skills is not null"))


def normal_profiles(raw: DataFrame) -> DataFrame:
    """Missing lists are empty, the name and level have defaults; years, the English level and work modes (JSON text or structs) are normalised."""
    modes = work_modes_from_json if raw.schema["work_modes"].dataType.simpleString() == "string" else work_modes
    none = F.array().cast("array<string>")
    lists = [f.name for f in PROFILE.fields if f.name not in ("profile_id", "years_of_experience", "max_english_level", "work_modes")]
    out = raw.withColumns({c: F.coalesce(F.col(c), none) for c in lists})
    return out.select("profile_id", *lists, years(F.col("years_of_experience")).alias("years_of_experience"), cefr(F.col("max_english_level")).alias("max_english_level"), modes(F.col("work_modes")).alias("work_modes"), F.coalesce("name", F.lit("Candidate")).alias("name"), F.coalesce("experience_level", F.lit("Mid")).alias("experience_level"))


def read_pages(spark: SparkSession, path: str, charset: str = "utf-8") -> DataFrame:
    """file, html: raw page files decoded by the charset that the server named; bytes that it cannot hold are left out."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), decoded_bytes(F.col("content"), charset).alias("html"))


def read_url_lists(spark: SparkSession, path: str) -> DataFrame:
    """file, at, url: URLs of text files in order, first of each."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return texts.select("file", F.posexplode(url_list(F.col("value"))).alias("at", "url"))


def read_cv_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, text: plain-text CVs (txt, md), trimmed and cut at CV_LIMIT characters; empty ones are left out."""
    texts = spark.read.text(path, wholetext=True).where(F.lower(F.col("_metadata.file_name")).rlike(r"\.(txt|md)$"))
    trimmed = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return texts.select(F.col("_metadata.file_name").alias("file"), F.substring(trimmed, 1, CV_LIMIT).alias("text")).where("text <> ''")


def newest_report(spark: SparkSession, pattern: str) -> str | None:
    """Path of the newest matching CSV that is neither final nor refined."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    row = files.where(~F.regexp_extract("path", "[^/]*$", 0).rlike("final|refined")).agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return row[0]


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report CSV with a header that may begin with a byte-order mark; fit_score is an integer, 0 if absent."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.withColumn("fit_score", F.coalesce(F.col("fit_score").try_cast("int"), F.lit(0)))


def write_report(refined: DataFrame, path: str) -> None:
    """The ranking as CSV in the fixed column layout."""
    ranked = with_rank(refined)
    have = [F.col(c).cast("string").alias(c) if c in ranked.columns else F.lit("").alias(c) for c in REPORT_FIELDS]
    ranked.orderBy("rank").select(*have).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def with_rank(refined: DataFrame) -> DataFrame:
    """Add the 1-based rank in report order; however many rows share a score, no task numbers them all."""
    return with_place(refined, report_order(), "rank").withColumn("rank", F.col("rank").cast("int"))


class Conflict(RuntimeError):
    """Another writer changed a table that this commit read or writes."""


def commit_tables(tables: dict[str, DataFrame], path: str, read: dict[str, int] | None = None, attempts: int = 20) -> int:
    """Commit several tables that change together; returns the number of the commit.

    Readers see all of them or none. The data goes to folders of their own first; then the next commit number is claimed by creating its file, which
    the file system grants to one writer. A loser reads what won: if it left alone every table written here and every table in `read` (the
    versions this change was computed from, see read_commit), the next number is tried; else Conflict is raised, and what was written stays unseen.
    """
    spark = next(iter(tables.values())).sparkSession
    base = read_commit(spark, path) if read is None else read
    new = {}
    for name, df in tables.items():
        new[name] = f"{name}/data={uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{new[name]}")
    return publish(spark, path, new, {**{t: base.get(t) for t in tables}, **(read or {})}, attempts)


def publish(spark: SparkSession, path: str, new: dict, read: dict, attempts: int = 20) -> int:
    """Make `new` (what each table's name stands for from now on) the next commit, unless an entry of `read` has changed since."""
    for _ in range(attempts):
        number, held = _newest_commit(spark, path)
        changed = sorted(t for t in read if held.get(t) != read[t])
        if changed:
            raise Conflict(f"changed by another writer: {', '.join(changed)}")
        if write_file(spark, f"{path}/commits/{number + 1:012d}", json.dumps(held | new, sort_keys=True)):
            return number + 1
    raise Conflict("too many writers")


def transact(spark: SparkSession, path: str, change: Callable[[Callable[[str, str], DataFrame]], dict[str, DataFrame]], attempts: int = 5) -> int:
    """Commit change(read), computed anew on the newest versions whenever another writer changed what it read or writes. read(name, schema) reads a table."""
    for attempt in range(attempts):
        held = read_commit(spark, path)
        used: dict[str, str | None] = {}

        def read(name: str, schema: str) -> DataFrame:
            used[name] = held.get(name)
            return read_table(spark, path, name, schema, held)

        tables = change(read)
        try:
            return commit_tables(tables, path, {**{t: held.get(t) for t in tables}, **used})
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise Conflict("too many writers")


GRACE = 10.0  # seconds after which a commit file that is still incomplete counts as that of a dead writer


def _newest_commit(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """Number and folders of the newest commit; -1 before the first. A file that stays incomplete changed nothing: the commit before it counts."""
    done = sorted((name for f in listed(spark, f"{path}/commits/*") if (name := f.rsplit("/", 1)[1]).isdigit()), reverse=True)
    for name in done:
        until = time.monotonic() + GRACE
        while True:
            text = read_file(spark, f"{path}/commits/{name}")
            if text.endswith("}"):
                return int(done[0]), json.loads(text)
            if time.monotonic() > until:
                break
            time.sleep(0.2)
    return (int(done[0]) if done else -1), {}


def read_commit(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each table as of the newest commit."""
    return _newest_commit(spark, path)[1]


def read_table(spark: SparkSession, path: str, name: str, schema: str, held: dict[str, str] | None = None) -> DataFrame:
    """A table as of the newest commit (or of `held`); empty before its first. Data that no commit names is not seen."""
    folder = (read_commit(spark, path) if held is None else held).get(name)
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(f"{path}/{folder}")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(f.rsplit("/", 2)[1].partition("=")[2]) for f in listed(spark, f"{path}/version=*/_SUCCESS"))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version of a state table; empty before the first."""
    done = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={done[-1]}") if done else spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str) -> int:
    """Write the next version. Readers see it once it is complete: Spark's _SUCCESS file is the commit. Each writer claims a number of its own first; one that dies leaves a gap."""
    spark = df.sparkSession
    taken = [int(f.rsplit("/", 1)[1]) for f in listed(spark, f"{path}/claims/*")] + _versions(spark, path)
    version = max(taken, default=-1) + 1
    while not write_file(spark, f"{path}/claims/{version}", ""):
        version += 1
    df.write.parquet(f"{path}/version={version}")
    return version
