from pyspark.sql import functions as F

from jobmarket.operators import inbox, lifecycle
from jobmarket.sources.buckets import BucketedTable


def test_stored_sides_are_not_shuffled(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    vacancies = BucketedTable(spark, str(tmp_path), "v", "source_url STRING, title STRING", "source_url", 4, 6)
    analyses = BucketedTable(spark, str(tmp_path), "a", "vacancy_source_url STRING, id BIGINT, score INT, fit_label STRING", "vacancy_source_url", 4, 6)
    assert vacancies.read().count() == 0
    vacancies.replace(spark.range(500).selectExpr("concat('u', id) AS source_url", "concat('t', id) AS title"))
    analyses.replace(spark.range(2000).selectExpr("concat('u', id % 700) AS vacancy_source_url", "id", "cast(id % 90 as int) AS score", "'Low' AS fit_label"))
    out = inbox.with_analysis(vacancies.read(), analyses.read())
    rows = out.collect()
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(rows) == 500 and all(r["analysis_id"] == max(i for i in range(2000) if i % 700 == int(r["source_url"][1:])) for r in rows[:50])
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_an_upsert_rewrites_touched_segments_only(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    schema = "source_url STRING, title STRING, original_source_url STRING, first_seen_at STRING, first_seen_run_id BIGINT, last_seen_at STRING, last_seen_run_id BIGINT"
    row = lambda i, run: (f"u{i}", f"t{run}", "o", f"d{run}", run, f"d{run}", run)
    table = BucketedTable(spark, str(tmp_path), "v", schema, "source_url", 32, 4)
    table.replace(spark.createDataFrame([row(i, 1) for i in range(800)], schema))
    before = table.folders()
    plans = []

    def merge(old, new):
        out = lifecycle.upsert_vacancies(old, new)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    table.upsert(spark.createDataFrame([row(3, 2), row(900, 2)], schema), merge)
    after = table.folders()
    assert 1 <= sum(before.get(n) != f for n, f in after.items()) <= 2 and set(before) <= set(after)
    got = {r["source_url"]: (r["title"], r["first_seen_run_id"], r["last_seen_run_id"]) for r in table.read().collect()}
    assert len(got) == 801 and got["u3"] == ("t2", 1, 2) and got["u900"] == ("t2", 2, 2) and got["u4"] == ("t1", 1, 1)
    assert plans[0].count("Exchange hashpartitioning") == 1  # the batch alone
    again = BucketedTable(spark, str(tmp_path), "v", schema, "source_url", 32, 4)  # as another session would open it
    rival = BucketedTable(spark, str(tmp_path), "v", schema, "source_url", 32, 4)
    done = []

    def slow(old, new):
        if not done:
            done.append(rival.upsert(spark.createDataFrame([row(901, 3)], schema), lifecycle.upsert_vacancies))
        return lifecycle.upsert_vacancies(old, new)

    again.upsert(spark.createDataFrame([row(902, 4)], schema), slow)
    assert {r[0] for r in table.read().where(F.col("source_url").isin("u901", "u902")).select("source_url").collect()} == {"u901", "u902"}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
