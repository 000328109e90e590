import random

import pytest
from pyspark.sql import functions as F

from jobmarket.operators import tracking
from jobmarket.operators.order import with_place
from jobmarket.plans import registry  # noqa: F401
from jobmarket.sources import tables


def test_places_of_rows_that_share_a_score(spark):
    df = spark.range(20_000).select(F.lit(7).alias("score"), F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") * 7919) % 1000).alias("title"), F.col("id").cast("string").alias("url"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one partition
    out = with_place(df, [F.col("score").desc(), F.col("title").asc_nulls_last(), F.col("url")])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    rows = sorted(out.collect(), key=lambda r: r["place"])
    want = sorted(df.collect(), key=lambda r: (r["title"] is None, r["title"] or 0, r["url"]))
    assert [r["url"] for r in rows] == [r["url"] for r in want] and [r["place"] for r in rows] == list(range(1, 20_001))
    assert len(out.inputFiles()) > 1  # one score, several tasks
    assert with_place(df.limit(0), [F.col("url")]).count() == 0


@pytest.mark.parametrize("fold", [3, 500])
def test_one_application_with_very_many_commands(spark, monkeypatch, fold):
    monkeypatch.setattr(tracking, "FOLD", fold)
    rng = random.Random(3)
    n = 200_000 if fold == 500 else 400
    states = [*tracking.TRANSITIONS, "Nonsense"]
    rows = [(i, "hot" if i % 100 else f"u{i % 7}", rng.choice(states), rng.choice(["normal", "normal", "corrective"]), rng.choice(["", "", "why"])) for i in range(n)]
    commands = spark.createDataFrame(rows, "id long, vacancy_source_url string, new_status string, kind string, reason string")
    stored = {"hot": "Saved", "u0": "Lost", "u1": "Offer", "u2": "Saved"}
    apps = spark.createDataFrame(list(stored.items()), "vacancy_source_url string, status string")
    out = tracking.apply_commands(apps, commands)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["id"]: (r["previous_status"], r["verdict"]) for r in out.collect()}
    now = dict(stored)
    for i, key, new, kind, reason in rows:
        said = tracking.verdict_of(now.get(key), new, kind, reason)
        assert got[i] == (now.get(key), said)
        if said == "accepted":
            now[key] = new


def test_two_writers_lose_nothing(spark, tmp_path):
    path, schema = str(tmp_path), "n long"
    one = lambda n: spark.createDataFrame([(n,)], schema)
    tables.commit_tables({"a": one(0), "b": one(0)}, path)
    seen = []

    def change(read):
        held = read("a", schema)
        seen.append(held.count())
        if len(seen) == 1:  # another writer is faster
            tables.transact(spark, path, lambda read: {"a": read("a", schema).unionByName(one(1))})
        return {"a": held.unionByName(one(2))}

    tables.transact(spark, path, change)
    assert seen == [1, 2] and sorted(r["n"] for r in tables.read_table(spark, path, "a", schema).collect()) == [0, 1, 2]
    held = tables.read_commit(spark, path)
    tables.commit_tables({"b": one(5)}, path)
    with pytest.raises(tables.Conflict):
        tables.commit_tables({"a": one(9)}, path, read={"a": held["a"], "b": held["b"]})
    tables.commit_tables({"a": one(7)}, path, read={"a": held["a"]})  # b is none of its business
    assert tables.read_table(spark, path, "b", schema).first()["n"] == 5 and tables.read_table(spark, path, "a", schema).first()["n"] == 7
    (tmp_path / "commits" / f"{9:012d}").write_text("{")  # a writer that died while it wrote
    tables.GRACE, grace = 0.1, tables.GRACE
    assert tables.read_table(spark, path, "a", schema).first()["n"] == 7
    assert tables.commit_tables({"a": one(8)}, path) == 10 and tables.read_table(spark, path, "a", schema).first()["n"] == 8
    tables.GRACE = grace


def test_each_writer_of_a_version_has_its_own(spark, tmp_path):
    path, one = f"{tmp_path}/s", spark.range(1)
    assert tables.write_state(one, path) == 0
    assert tables.write_file(spark, f"{path}/claims/1", "")  # another writer is at version 1 still
    assert tables.write_state(spark.range(2), path) == 2 and tables.read_state(spark, path, "id long").count() == 2


def test_actions_equal_a_fold_of_their_commands(spark):
    rng = random.Random(4)
    vacancies = spark.createDataFrame([("u0",), ("u1",)], "source_url string")
    rows = []
    for i in range(1500):
        op = rng.choice(["create", "update", "complete", "reopen", "complete"])
        rows.append((i, rng.randrange(120) if i % 3 else 7, rng.choice(["u0", "u1", "gone"]), op, rng.choice(["A", " ", None, "B "]), rng.choice([None, "d1", "d2"]), f"t{i:05d}" if rng.random() < 0.9 else None))
    got = {r["action_id"]: tuple(r)[1:] for r in tracking.apply_actions(vacancies, spark.createDataFrame(rows, "id long, action_id long, vacancy_source_url string, op string, title string, due_at string, at string")).collect()}
    want: dict = {}
    for _, action, url, op, title, due, at in rows:
        title, s = (title or "").strip() or None, want.get(action)
        if s is None:
            if op == "create" and url != "gone" and title and at:
                want[action] = {"url": url, "title": title, "due": due, "completed": None, "created": at, "updated": at}
            continue
        if op == "create" and (url == "gone" or not title):
            continue  # rejected
        if op == "update":
            s.update(title=title or s["title"], due=due)
        s["completed"] = (s["completed"] or at) if op == "complete" else None if op == "reopen" else s["completed"]
        s["updated"] = at
    assert got == {a: (s["url"], s["title"], s["due"], s["completed"], s["created"], s["updated"], "completed" if s["completed"] else "open") for a, s in want.items()}
