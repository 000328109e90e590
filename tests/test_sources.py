import json

from pyspark.sql import functions as F

import __spark_entry__
from jobmarket.operators import lifecycle, ranking
from jobmarket.sources import tables


def test_profiles(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "skills": ["x"], "years_of_experience": 6, "work_modes": [{"mode": "remote", "country": ""}]}))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text(json.dumps({"skills": ["x"]}))
    got = tables.read_profiles(spark, f"file://{tmp_path}").collect()
    assert [(r["profile_id"], r["skills"], r["target_roles"], r["years_of_experience"], r["experience_level"]) for r in got] == [("a", ["x"], [], 6.0, "Mid")]


def test_text_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("https://a.test/1, https://a.test/1\n<https://b.test/2>")
    (tmp_path / "cv.md").write_text("  \n text " + "x" * 30_000)
    (tmp_path / "empty.md").write_text(" \n")
    assert [r["url"] for r in tables.read_url_lists(spark, f"file://{tmp_path}/u.txt").orderBy("at").collect()] == ["https://a.test/1", "https://b.test/2"]
    got = {r["file"]: len(r["text"]) for r in tables.read_cv_texts(spark, f"file://{tmp_path}").collect()}
    assert got["cv.md"] == tables.CV_LIMIT and "empty.md" not in got


def test_report_round_trip(spark, tmp_path):
    (tmp_path / "base.csv").write_text("﻿url,title,company,location,fit_score,language_risk,why,risks\nhttps://u.test/1,Clerk,c,l,90,OK,good,\nhttps://u.test/2,Senior clerk,c,l,95,OK,,Requires 3 years; far\nhttps://u.test/3,Clerk,c,l,,C1,x,\n")
    (tmp_path / "base_final.csv").write_text("url\n")
    path = tables.newest_report(spark, f"file://{tmp_path}/*.csv")
    assert path.endswith("base.csv")
    none = spark.createDataFrame([], "source_url string, title string, company string, location string, salary_text string, requirements array<string>, responsibilities array<string>")
    refined = ranking.refine(tables.read_report(spark, path), none)
    tables.write_report(refined, f"file://{tmp_path}/out")
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/out").orderBy("rank").collect()
    assert [(r["rank"], r["rank_score"], r["priority"], r["url"][-1]) for r in rows] == [("1", "90", "Top", "1"), ("2", "29", "Blocked", "2"), ("3", "0", "Blocked", "3")]
    assert rows[1]["risks"] == "Senior-like title: senior; far" and rows[2]["block_reason"] == "C1"


def test_state_versions(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    assert tables.read_state(spark, path, "a int").count() == 0
    for v in (0, 1):
        assert tables.write_state(spark.createDataFrame([(v,)], "a int"), path) == v
    assert [r["a"] for r in tables.read_state(spark, path, "a int").collect()] == [1]


def test_runs_open_and_close(spark):
    none = spark.createDataFrame([], "id long, started_at timestamp, finished_at timestamp, status string")
    runs = lifecycle.begin_runs(none, spark.createDataFrame([(1,), (2,)], "id long").withColumn("started_at", F.current_timestamp()))
    done = lifecycle.finish_runs(runs, spark.createDataFrame([(1, "partial")], "run_id long, status string"), F.current_timestamp())
    assert {r["id"]: (r["status"], r["finished_at"] is None) for r in done.collect()} == {1: ("partial", False), 2: ("running", True)}
    again = lifecycle.finish_runs(done, spark.createDataFrame([(1, "failed")], "run_id long, status string"), F.current_timestamp())
    assert {r["id"]: r["status"] for r in again.collect()} == {1: "partial", 2: "running"}


def test_entry_and_registry(spark):
    out = __spark_entry__.entry(spark)
    assert out.limit(5).count() == 5 and {"score", "fit_label", "profile_id"} <= set(out.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
