"""Registered queries of file sources and sinks: rows of the given tables are written as files and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.plans.field_queries import _RANKED
from jobmarket.plans.registry import _analyses, _refined, _t, query
from jobmarket.sources import tables


@query("""
    SELECT name, skills, level, CASE n_nationkey % 2 WHEN 0 THEN 'remote' ELSE 'office:' || name END AS work_modes, years, experience
    FROM (SELECT n_nationkey, n_name AS name, lower(n_name) || '|sql' AS skills, CASE n_nationkey % 3 WHEN 0 THEN 'C1' END AS level, (n_nationkey % 5)::DOUBLE AS years, CASE n_nationkey % 4 WHEN 0 THEN 'Senior' ELSE 'Mid' END AS experience FROM nation WHERE n_nationkey % 7 <> 0)""")
def a9_profile_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile file for each nation; those without skills are left out, defaults fill the rest."""
    folder = tables.scratch_folder(spark)
    n, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    modes = F.when(k % 2 == 0, F.array(F.struct(F.lit("Remote").alias("mode"), F.lit(None).cast("string").alias("country")))).otherwise(F.array(F.struct(F.lit("OFFICE").alias("mode"), F.col("n_name").alias("country"))))
    rows = n.select(
        F.col("n_name").alias("name"), F.when(k % 7 != 0, F.array(F.lower("n_name"), F.lit("sql"))).alias("skills"), F.when(k % 3 == 0, " c1").alias("max_english_level"), modes.alias("work_modes"),
        (k % 5).cast("string").alias("years_of_experience"), F.when(k % 4 == 0, "Senior").alias("experience_level"),
    )
    rows.write.option("maxRecordsPerFile", 1).json(f"{folder}/profiles")
    out = tables.read_profiles(spark, f"{folder}/profiles")
    shown = F.array_join(F.transform("work_modes", lambda m: F.when(m["mode"] == "remote", m["mode"]).otherwise(F.concat(m["mode"], F.lit(":"), m["country"]))), "|")
    return out.select("name", F.array_join("skills", "|").alias("skills"), F.col("max_english_level").alias("level"), shown.alias("work_modes"), F.col("years_of_experience").alias("years"), F.col("experience_level").alias("experience"))


@query(f"""{_RANKED} SELECT 'https://x.test/' || doc_id AS url, row_number() OVER (ORDER BY blocked, rank_score DESC, fit DESC, lower(title), 'https://x.test/' || doc_id)::INT AS rank, fit::INT AS fit_score, title, seniority_risk FROM d""")
def a10_report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking as CSV, the newest report that is no final one, read back."""
    folder = tables.scratch_folder(spark)
    tables.write_report(_refined(spark, sf_dir), f"{folder}/base")
    tables.write_report(_refined(spark, sf_dir).limit(0), f"{folder}/base_final")
    newest = tables.newest_report(spark, f"{folder}/*/part-*.csv")
    back = tables.read_report(spark, newest.rsplit("/", 1)[0] if "final" not in newest.rsplit("/", 2)[1] else f"{folder}/base")
    return back.select("url", F.col("rank").cast("int").alias("rank"), "fit_score", "title", "seniority_risk")


@query("SELECT 'analyses' AS name, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders UNION ALL SELECT 'vacancies', count(*), sum(c_custkey)::BIGINT FROM customer WHERE c_custkey % 2 = 0")
def a18_committed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables committed twice; a version written after the last commit is not seen."""
    folder = tables.scratch_folder(spark)
    analyses, vacancies = _analyses(spark, sf_dir).select("id"), _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tables.commit_tables({"analyses": analyses.limit(0), "vacancies": vacancies}, folder)
    tables.commit_tables({"analyses": analyses, "vacancies": vacancies.where("id % 2 = 0")}, folder)
    tables.write_state(vacancies.limit(3), f"{folder}/vacancies")
    read = lambda name: tables.read_table(spark, folder, name, "id long").agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("id").alias("keys"))
    return read("analyses").unionByName(read("vacancies"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'first' ELSE 'second' END AS writer FROM customer")
def a18_optimistic_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers add their rows to one table; the second commits while the first computes, so the first computes anew."""
    folder, schema = tables.scratch_folder(spark), "id long, writer string"
    c = _t(spark, sf_dir, "customer")
    rows = lambda rest, who: c.where(f"c_custkey % 2 = {rest}").select(F.col("c_custkey").alias("id"), F.lit(who).alias("writer"))
    tables.commit_tables({"rows": rows(0, "first").limit(0)}, folder)
    rival = [rows(1, "second")]

    def change(read: Callable) -> dict[str, DataFrame]:
        held = read("rows", schema)
        if rival:
            theirs = rival.pop()
            tables.transact(spark, folder, lambda read: {"rows": read("rows", schema).unionByName(theirs)})
        return {"rows": held.unionByName(rows(0, "first"))}

    tables.transact(spark, folder, change)
    return tables.read_table(spark, folder, "rows", schema)


@query("SELECT substr('CV of ' || n_name || ' ' || trim(repeat('work ', 10000)), 1, 24000) AS text FROM nation WHERE n_nationkey % 5 <> 0")
def a19_cv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation: trimmed, cut, empty ones left out."""
    folder = tables.scratch_folder(spark)
    n = _t(spark, sf_dir, "nation")
    cv = F.when(F.col("n_nationkey") % 5 == 0, "  ").otherwise(F.concat(F.lit(" \t"), F.lit("CV of "), "n_name", F.lit(" "), F.lit("work " * 10_000)))
    n.select(cv.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/cv")
    return tables.read_cv_texts(spark, f"{folder}/cv").select("text")


@query("SELECT 'https://x.test/' || n_nationkey || '|http://y.test/' || lower(n_name) AS urls FROM nation")
def a6_url_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of URLs for each nation, one file each."""
    folder = tables.scratch_folder(spark)
    n, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    value = F.concat(F.lit("- https://x.test/"), k.cast("string"), F.lit(";\nhttp://y.test/"), F.lower("n_name"), F.lit(", https://x.test/"), k.cast("string"), F.lit(")"))
    n.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{folder}/lists")
    found = tables.read_url_lists(spark, f"{folder}/lists")
    return found.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"]), "|").alias("urls")).select("urls")
