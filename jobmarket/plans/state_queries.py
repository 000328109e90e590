"""Registered queries of lifecycle, tracking, inbox order and streams, with the SQL they must equal.

Customers are vacancies, orders are analyses, a customer's other columns make its stored and new states.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.operators import inbox, lifecycle, tracking
from jobmarket.operators.order import with_place
from jobmarket.plans.registry import _COMMANDS, _SQL, _STORED, _VERDICT, _analyses, _applications, _observations, _results, _runs, _stored_statuses, _t, _vacancies, query
from jobmarket.sources.tables import scratch_folder
from jobmarket.streaming import observations

DAY = 1704067200  # 2024-01-01


def _key() -> Column:
    return F.col("c_custkey")


def _at(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(DAY) + seconds)


def _placed(df: DataFrame, order: list[Column], *columns: str) -> DataFrame:
    """Columns and the place in an order, which an SQL result without order can be compared with."""
    return with_place(df, order, keep=columns).select(*columns, F.col("place").cast("int").alias("place"))


# --- lifecycle -------------------------------------------------------------------------------------------

@query("""
    SELECT c_custkey AS source_url, CASE WHEN n THEN 'new ' ELSE 'old ' END || c_name AS title, CASE WHEN o THEN 'o' || c_custkey ELSE 'n' || c_custkey END AS original_source_url, CASE WHEN o THEN c_custkey % 100 ELSE 500 END AS first_seen, CASE WHEN o THEN 1 ELSE 9 END AS first_run,
           CASE WHEN n THEN 500 ELSE c_custkey % 100 END AS last_seen, CASE WHEN n THEN CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 9 END ELSE 1 END AS last_run
    FROM (SELECT *, c_custkey % 3 <> 0 AS o, c_custkey % 2 = 0 AS n FROM customer) WHERE o OR n""")
def j1_vacancy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds are stored, half come again: content is the new one's, first sighting the old one's, a last run may become null."""
    c = _t(spark, sf_dir, "customer")
    rows = lambda df, word, seen, run: df.select(
        _key().alias("source_url"), F.concat(F.lit(f"{word} "), "c_name").alias("title"), F.concat(F.lit(word[0]), _key().cast("string")).alias("original_source_url"), _at(seen).alias("first_seen_at"),
        run.cast("long").alias("first_seen_run_id"), _at(seen).alias("last_seen_at"), F.when(F.lit(word == "old") | (_key() % 4 != 0), run.cast("long")).alias("last_seen_run_id"),
    )
    out = lifecycle.upsert_vacancies(rows(c.where("c_custkey % 3 <> 0"), "old", _key() % 100, F.lit(1)), rows(c.where("c_custkey % 2 = 0"), "new", F.lit(500), F.lit(9)))
    return out.select("source_url", "title", "original_source_url", (F.unix_timestamp("first_seen_at") - DAY).alias("first_seen"), F.col("first_seen_run_id").alias("first_run"), (F.unix_timestamp("last_seen_at") - DAY).alias("last_seen"), F.col("last_seen_run_id").alias("last_run"))


@query("""
    WITH s AS (SELECT user_id, max(ts) AS seen, max((ts, day(ts))) AS m FROM events GROUP BY 1)
    SELECT c_custkey AS source_url, coalesce(epoch_us(s.seen), epoch_us(TIMESTAMP '2020-01-01')) AS last_us, coalesce(day(s.seen), 7)::BIGINT AS last_run FROM customer LEFT JOIN s ON user_id = c_custkey""")
def j3_observe_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last sighting of a stored vacancy moves."""
    stored = _t(spark, sf_dir, "customer").select(_key().alias("source_url"), F.lit("2020-01-01").cast("timestamp").alias("last_seen_at"), F.lit(7).cast("long").alias("last_seen_run_id"))
    seen = _observations(spark, sf_dir).select(F.col("vacancy_source_url").cast("long").alias("source_url"), "observed_at", "run_id")
    return lifecycle.observe_known(stored, seen).select("source_url", F.unix_micros("last_seen_at").alias("last_us"), F.col("last_seen_run_id").alias("last_run"))


@query(f"{_SQL} SELECT count(*) AS removed FROM (SELECT l.url FROM l JOIN v USING (url) ANTI JOIN p USING (url) WHERE score < 40)")
def d10_prune_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.prune_count(lifecycle.prune_candidates(_vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir), 40))


@query("""
    SELECT day(ts)::BIGINT AS run_id, count(*) AS attempted, count(*) FILTER (value < 5) AS failed, count(*) FILTER (value >= 50 OR value IS NULL) AS new, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS sources FROM events GROUP BY 1""")
def d11_run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.run_totals(lifecycle.run_summary(_results(spark, sf_dir)))


def _merged_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each third customer is stored under a second URL with a tracking parameter, each fifth only under such a one."""
    c = _t(spark, sf_dir, "customer")
    plain = F.concat(F.lit("https://v.test/"), _key().cast("string"))
    marked = F.concat(F.lit("HTTPS://V.test/"), _key().cast("string"), F.lit("/?utm_source=x"))
    return c.where("c_custkey % 5 <> 0").select(plain.alias("source_url"), "c_name").unionByName(c.where("c_custkey % 3 = 0 or c_custkey % 5 = 0").select(marked.alias("source_url"), "c_name"))


@query("SELECT o_orderkey, 'https://v.test/' || o_custkey AS vacancy_source_url FROM orders WHERE o_custkey % 5 <> 0 OR o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'https://v.test/' || o_custkey || '?gone' FROM orders WHERE o_custkey % 5 = 0 AND o_orderkey % 2 = 0")
def j10_rewritten_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of merged vacancies become canonical; a key that names no stored vacancy stays."""
    who, odd = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 2 == 1
    marked = F.concat(F.lit("HTTPS://V.test/"), who, F.lit("/?utm_source=x"))
    plain = F.concat(F.lit("https://v.test/"), who)
    fifth = F.col("o_custkey") % 5 == 0
    child = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(fifth & odd, marked).when(fifth, F.concat(plain, F.lit("?gone"))).when((F.col("o_custkey") % 3 == 0) & odd, marked).otherwise(plain).alias("vacancy_source_url"))
    return lifecycle.rewritten_keys(child, _merged_urls(spark, sf_dir))


@query("SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 4 = 3 THEN 'running' ELSE ['completed', 'partial', 'failed'][1 + n_nationkey % 4] END AS status, CASE WHEN n_nationkey % 4 = 3 THEN NULL WHEN n_nationkey >= 20 THEN 50 ELSE 100 END AS finished FROM nation")
def j18_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs begin as running and finish once; those that had finished stay as they are."""
    n, k = _t(spark, sf_dir, "nation"), F.col("n_nationkey")
    status = F.element_at(F.array(*map(F.lit, ("completed", "partial", "failed"))), (k % 4 + 1).cast("int"))
    kept = n.where("n_nationkey >= 20").select(k.cast("long").alias("id"), F.timestamp_seconds(k).alias("started_at"), F.when(k % 4 < 3, F.timestamp_seconds(F.lit(50))).alias("finished_at"), F.when(k % 4 < 3, status).otherwise("running").alias("status"))
    opened = lifecycle.begin_runs(kept, n.select(k.cast("long").alias("id"), F.timestamp_seconds(k).alias("started_at")))
    ends = n.where("n_nationkey % 4 < 3").select(k.cast("long").alias("run_id"), status.alias("status"))
    return lifecycle.finish_runs(opened, ends, F.timestamp_seconds(F.lit(100))).select("id", "status", F.unix_timestamp("finished_at").alias("finished"))


# --- records and actions -----------------------------------------------------------------------------------

@query(f"""{_SQL}, w AS (SELECT url, CASE WHEN url % 3 = 0 THEN 7 END AS id, CASE WHEN url % 2 = 0 THEN 'note' END AS note FROM v WHERE url % 5 < 3)
    SELECT coalesce(p.url, w.url) AS vacancy_source_url, coalesce(p.pinned, w.id)::BIGINT AS analysis_id, coalesce(p.status, 'Saved') AS status, coalesce(w.note, '') AS notes, p.url IS NULL AS created FROM p FULL JOIN w USING (url)""")
def j7_ensured_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absent records are created as Saved with an event, present ones filled where empty."""
    wanted = _t(spark, sf_dir, "customer").where("c_custkey % 5 < 3").select(_key().alias("vacancy_source_url"), F.when(_key() % 3 == 0, F.lit(7).cast("long")).alias("analysis_id"), F.when(_key() % 2 == 0, "note").alias("notes"))
    out, events = tracking.ensure_applications(_applications(spark, sf_dir), wanted)
    return out.join(events.select("vacancy_source_url", F.lit(True).alias("created")), "vacancy_source_url", "left").withColumn("created", F.coalesce("created", F.lit(False)))


_GRAPH = "(('Saved', 'Applied'), ('Saved', 'Interview'), ('Saved', 'Withdrawn'), ('Applied', 'Interview'), ('Applied', 'Rejected'), ('Applied', 'Withdrawn'), ('Interview', 'Offer'), ('Interview', 'Rejected'), ('Interview', 'Withdrawn'), ('Offer', 'Withdrawn'))"


@query(f"""{_SQL}, r AS (SELECT url, ['Saved', 'Applied', 'Interview', 'Offer', 'Rejected', 'Withdrawn'][1 + (url // 7) % 6] AS wanted FROM v WHERE url % 2 = 0),
    j AS (SELECT coalesce(p.url, r.url) AS url, p.status, r.wanted, r.url IS NOT NULL AS saves, r.url IS NOT NULL AND p.status <> r.wanted AND (p.status, r.wanted) NOT IN {_GRAPH} AS refused FROM p FULL JOIN r USING (url))
    SELECT url AS vacancy_source_url, CASE WHEN saves AND NOT coalesce(refused, false) THEN wanted ELSE status END AS status, saves AND NOT coalesce(refused, false) AND status IS DISTINCT FROM wanted AS event, coalesce(refused, false) AS refused FROM j""")
def j8_saved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records saved whole: a status that the graph does not allow is refused, a change is an event of the system."""
    status = F.element_at(F.array(*[F.lit(s) for s in lifecycle.STATUS_RANK]), (F.floor(_key() / 7) % 6 + 1).cast("int"))
    records = _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(_key().alias("vacancy_source_url"), F.lit(1).cast("long").alias("analysis_id"), status.alias("status"), F.lit("n").alias("notes"))
    out, events, refused = tracking.save_records(_applications(spark, sf_dir), records)
    mark = lambda df, name: df.where("true").select("vacancy_source_url", F.lit(True).alias(name))
    joined = out.join(mark(events.where("origin = 'system'"), "event"), "vacancy_source_url", "left").join(mark(refused, "refused"), "vacancy_source_url", "left")
    return joined.select("vacancy_source_url", "status", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("event", "refused")])


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five commands for each customer's action: create, update, complete, complete again, reopen; some are left out by key."""
    ops = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(op).alias("op")) for i, op in enumerate(("create", "update", "complete", "complete", "reopen"))])
    each = _t(spark, sf_dir, "customer").select(_key(), "c_name", F.explode(ops).alias("x")).select("c_custkey", "c_name", "x.*").where("n <= c_custkey % 7")
    return each.select(
        (_key() * 10 + F.col("n")).alias("id"), _key().alias("action_id"), F.when(_key() % 11 == 0, -1).otherwise(_key()).alias("vacancy_source_url"), "op", F.when((F.col("op") == "create") & (_key() % 13 == 0), "  ").when(F.col("op") == "create", F.concat(F.lit(" "), "c_name")).when(_key() % 2 == 0, "changed").alias("title"),
        F.when(F.col("n") < 2, _at(_key() * 977 % 100_000 + F.col("n"))).alias("due_at"), _at(F.col("n")).alias("at"),
    )


_ACTIONS = """
    WITH a AS (SELECT c_custkey AS action_id, c_custkey % 7 AS last, c_name, c_custkey * 977 % 100000 AS due FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0),
    s AS (SELECT action_id, CASE WHEN last >= 1 AND action_id % 2 = 0 THEN 'changed' ELSE c_name END AS title, CASE WHEN last >= 1 THEN due + 1 ELSE due END AS due, CASE WHEN last IN (2, 3) THEN 2 END AS completed, least(last, 4) AS updated FROM a)"""


@query(f"{_ACTIONS} SELECT action_id, title, due, completed, updated, CASE WHEN completed IS NULL THEN 'open' ELSE 'completed' END AS state FROM s")
def j11_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title and a parent are required; the first completion counts; reopening clears it."""
    out = tracking.apply_actions(_vacancies(spark, sf_dir), _actions(spark, sf_dir))
    seconds = lambda c: (F.unix_timestamp(c) - DAY)
    return out.select("action_id", "title", seconds("due_at").alias("due"), seconds("completed_at").alias("completed"), seconds("updated_at").alias("updated"), "state")


def _open_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tracking.apply_actions(_vacancies(spark, sf_dir), _actions(spark, sf_dir))
    return items.withColumn("due_at", F.when(F.col("action_id") % 17 != 0, F.col("due_at")))


@query(f"{_ACTIONS} SELECT action_id, row_number() OVER (ORDER BY CASE WHEN action_id % 17 <> 0 THEN due END NULLS LAST, action_id)::INT AS place FROM s WHERE completed IS NULL")
def f9_open_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open actions, those without a date last."""
    rows = tracking.actions(_open_items(spark, sf_dir), completed=False)
    return _placed(rows, [F.col("due_at").asc_nulls_last(), F.col("action_id")], "action_id")


@query(f"""{_ACTIONS} SELECT action_id, c_name AS vacancy_title, CASE WHEN due < 20000 THEN 'overdue' ELSE 'due_soon' END AS reminder_state, row_number() OVER (ORDER BY due, action_id)::INT AS place
    FROM s JOIN customer ON c_custkey = action_id WHERE completed IS NULL AND action_id % 17 <> 0 AND due <= 20000 + 86400 AND due IS NOT NULL""")
def f10_reminders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reminders beside today's list, with their vacancy's title, in order."""
    now = F.timestamp_seconds(F.lit(DAY + 20_000))
    _, due = inbox.today(_vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir), _runs(spark), _open_items(spark, sf_dir), now)
    return _placed(due, tracking.reminder_order(), "action_id", "vacancy_title", "reminder_state")


# --- inbox orders and lookups ---------------------------------------------------------------------------------

_INBOX = f"{_SQL}, r AS (SELECT v.url, v.title, v.company, coalesce(l.score, -1) AS score, v.url * 977 % 100000 AS seen, p.status, v.first_run, v.last_run FROM v LEFT JOIN l USING (url) LEFT JOIN p USING (url))"


def _inbox(spark: SparkSession, sf_dir: str, **given: object) -> DataFrame:
    q = inbox.InboxQuery(current_run=False).with_options(**given)
    rows = inbox.inbox(_vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir), _runs(spark), q)
    return _placed(rows, inbox.inbox_order(q.sort), "source_url")


@query(f"{_INBOX} SELECT url AS source_url, row_number() OVER (ORDER BY score DESC, seen DESC, title, url)::INT AS place FROM r")
def f1_inbox_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inbox(spark, sf_dir)


@query(f"{_INBOX} SELECT url AS source_url, row_number() OVER (ORDER BY seen DESC, title, url)::INT AS place FROM r WHERE status = 'Interview'")
def f2_inbox_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inbox(spark, sf_dir, sort="newest", status=" interVIEW ")


@query(f"{_INBOX} SELECT url AS source_url, row_number() OVER (ORDER BY lower(company), lower(title), url)::INT AS place FROM r WHERE first_run = 5")
def f3_inbox_by_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new ones of all runs; a blank option changes nothing."""
    return _inbox(spark, sf_dir, sort="company", new_only=True, source="", all_runs=True)


@query(f"{_INBOX} SELECT url AS source_url, row_number() OVER (ORDER BY lower(title), url)::INT AS place FROM r WHERE last_run = 5 AND score >= 60")
def j15_cleared_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearing the filters drops what was set and what comes with it, and goes back to the current run; other options stay."""
    q = inbox.InboxQuery(source="n1", label="low", new_only=True, min_score=60, hide_below=True).with_options(clear_filters=True, status="Saved", sort="title")
    rows = inbox.inbox(_vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir), _runs(spark), q)
    return _placed(rows, inbox.inbox_order(q.sort), "source_url")


@query(f"{_INBOX} SELECT url AS source_url, row_number() OVER (ORDER BY score DESC, title, url)::INT AS place FROM r")
def f4_vacancy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vacancies, best first."""
    return _placed(inbox.vacancy_list(_vacancies(spark, sf_dir), _analyses(spark, sf_dir)), inbox.list_order(), "source_url")


@query(f"{_SQL} SELECT p.url AS vacancy_source_url, row_number() OVER (ORDER BY p.status, v.title, p.url)::INT AS place FROM p JOIN v USING (url)")
def f5_tracked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inbox.tracked(_vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir))
    return _placed(rows, inbox.tracked_order(), "vacancy_source_url")


@query("""
    WITH v AS (SELECT c_custkey AS url, (c_custkey % 50)::VARCHAR AS id, 'n' || c_nationkey AS name FROM customer), u AS (SELECT id, name, count(*) AS n, min(url) AS url FROM v GROUP BY ALL),
    w AS (SELECT id, name FROM u UNION ALL SELECT DISTINCT id, NULL FROM v UNION ALL SELECT 'none', NULL)
    SELECT w.id AS source_id, w.name AS source_name, CASE WHEN count(DISTINCT v.name) = 1 THEN min(v.url) END AS source_url, CASE WHEN count(DISTINCT v.name) > 1 THEN 'ambiguous' WHEN count(v.name) = 0 THEN 'unknown' END AS problem
    FROM w LEFT JOIN v ON v.id = w.id AND (w.name IS NULL OR v.name = w.name) GROUP BY w.id, w.name""")
def a11_by_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id with its source, an id alone (often ambiguous), and one that is not stored."""
    v = _vacancies(spark, sf_dir)
    ids = v.select("source_id", "source_name").distinct()
    wanted = ids.unionByName(ids.select("source_id").distinct().withColumn("source_name", F.lit(None).cast("string"))).unionByName(spark.createDataFrame([("none", None)], "source_id string, source_name string"))
    return inbox.by_source_id(v, wanted).select("source_id", "source_name", "source_url", "problem")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS title FROM customer")
def a11_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any spelling of a URL finds the vacancy that is stored under its canonical form."""
    c, k = _t(spark, sf_dir, "customer"), _key().cast("string")
    stored = c.where("c_custkey % 4 <> 0").select(F.concat(F.lit("https://v.test/"), k).alias("source_url"), F.col("c_name").alias("title"))
    return inbox.by_url(stored, c.select("c_custkey", F.concat(F.lit("HTTPS://user@V.test:443/"), k, F.lit("/?utm_x=1#top")).alias("url"))).select("c_custkey", "title")


# --- streams ---------------------------------------------------------------------------------------------------

@query("""
    SELECT user_id::VARCHAR AS source_url, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM events GROUP BY 1""")
def k1_sighting_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations as files that arrive over several batches; the state after all of them."""
    folder = scratch_folder(spark)
    obs = _observations(spark, sf_dir).select(F.col("vacancy_source_url").alias("url"), "observed_at", (F.col("event_id") % 3).alias("arrives"))
    obs.repartition(3, "arrives").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("url string, observed_at timestamp, arrives long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    observations.write_sightings(stream.select("url", "observed_at"), f"{folder}/state", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = observations.read_sightings(spark, f"{folder}/state")
    return out.select("source_url", F.unix_micros("first_seen_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "n")


@query("SELECT user_id::VARCHAR AS source_url, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def k2_first_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page is let through once, however often it arrives within the watermark."""
    folder = scratch_folder(spark)
    rows = _observations(spark, sf_dir).select(F.col("vacancy_source_url").alias("url"), "observed_at")
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("url string, observed_at timestamp").parquet(f"{folder}/in").withColumnRenamed("observed_at", "arrived_at")
    observations.first_arrivals(stream, "3650 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("source_url").agg(F.count("*").alias("n"))


@query(_COMMANDS.replace("VERDICT AS verdict", f"{_VERDICT} AS verdict").replace("now, VERDICT FROM", f"now, {_VERDICT} FROM") + " SELECT id, prev AS previous_status, new AS new_status, verdict FROM f")
def k3_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of j6, as a stream with one state for each application."""
    return _streamed(spark, sf_dir, None)


@query(_STORED + " SELECT id, prev AS previous_status, new AS new_status, verdict FROM f")
def k3_stored_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands of j6 upon stored statuses, which the stream takes as its initial state."""
    stored = _stored_statuses(spark, sf_dir)
    return _streamed(spark, sf_dir, stored.select(F.col("vacancy_source_url").cast("string").alias("vacancy_source_url"), "status"))


def _streamed(spark: SparkSession, sf_dir: str, stored: DataFrame | None) -> DataFrame:
    """Verdicts of the commands, which arrive in three batches in order of their ids."""
    folder = scratch_folder(spark)
    e = _t(spark, sf_dir, "events")
    third = e.agg((F.max("event_id") / 3).alias("n")).first()["n"] or 1.0
    new = F.element_at(F.array(*map(F.lit, ("Applied", "Interview", "Offer", "Rejected", "Withdrawn", "Saved"))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("vacancy_source_url"), new.alias("new_status"), F.when(F.col("event_id") % 7 == 0, "corrective").otherwise("normal").alias("kind"), F.when(F.col("event_id") % 7 < 2, "why").otherwise("").alias("reason"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    observations.use_state_store(spark)
    for part in range(3):
        rows.where(F.least(F.floor(F.col("id") / third), F.lit(2)) == part).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("id long, vacancy_source_url string, new_status string, kind string, reason string").parquet(f"{folder}/in")
        observations.status_stream(stream, stored).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.parquet(f"{folder}/out").select("id", "previous_status", "new_status", "verdict")
