"""Registered queries that return what an operator adds in full: rendered rows, histories, notes, events, several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.operators import extract, inbox, lifecycle, ranking, reports, tracking
from jobmarket.operators.order import with_place
from jobmarket.plans.field_queries import _RANKED
from jobmarket.plans.registry import _LABEL, _SQL, _analyses, _applications, _refined, _t, _vacancies, query
from jobmarket.sources import boards
from jobmarket.sources.buckets import BucketedTable
from jobmarket.sources.scratch import scratch_folder
from jobmarket.streaming import observations

_REPORT = """, e AS (SELECT *, array_to_string([x FOR x IN [CASE WHEN lang <> 'OK' THEN lang END, CASE WHEN senior THEN seniority_risk END] IF x IS NOT NULL], '; ') AS reasons FROM d),
    f AS (SELECT *, row_number() OVER (ORDER BY blocked, rank_score DESC, fit DESC, lower(title), 'https://x.test/' || doc_id)::INT AS rank,
                 CASE WHEN blocked THEN 'Blocked' WHEN rank_score >= 82 THEN 'Top' WHEN rank_score >= 68 THEN 'Strong' WHEN rank_score >= 52 THEN 'Maybe' ELSE 'Low' END AS priority,
                 CASE WHEN blocked THEN reasons || '; far away' ELSE 'far away' END AS risks, CASE WHEN doc_id % 5 = 1 THEN 'junior/entry signal' ELSE '' END AS why FROM e QUALIFY rank <= 300)"""


@query(_RANKED + _REPORT + r"""
    SELECT doc_id, '<tr><td>' || rank || '</td><td>' || rank_score || '</td><td>' || priority || '</td><td>&lt;R&amp;D&gt; | ' || title || ' &#x27;&quot;</td><td></td><td></td><td>' || why || '</td><td>' || risks
               || '</td><td><a href="https://x.test/' || doc_id || '">Open</a></td></tr>' AS html_row,
           '| ' || concat_ws(' | ', rank, rank_score, priority, '<R&D> \| ' || title || ' ''"', '', '', why, risks, 'https://x.test/' || doc_id) || ' |' AS markdown_row FROM f""")
def a15_rendered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 300 rows of the ranking as HTML and Markdown, with characters that both must escape."""
    refined = _refined(spark, sf_dir).withColumn("title", F.concat(F.lit("<R&D> | "), "title", F.lit(" '\"")))
    return reports.ranking_rows(refined, 300).select("doc_id", "html_row", "markdown_row")


@query("SELECT c_custkey, 0 AS \"at\", 'https://cv.test/1-' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '?a=1&b=2' ELSE '' END AS link FROM customer WHERE c_custkey % 3 < 2")
def a2_board_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: a third of the listing pages marks its vacancy links, a third has plain links only, a third none."""
    k, c = F.col("c_custkey").cast("string"), _t(spark, sf_dir, "customer")
    marked = F.concat(
        F.lit('<a href="/1-999">n</a><a class="x list_a" href="/1-'), k, F.lit('?a=1&amp;b=2#f">x</a><a class="list_a" href="https://cv.test/1-'), k, F.lit('?a=1&b=2">y</a><a class="list_a" href="/about">z</a>')
    )
    plain = F.concat(F.lit('<a href="/1-'), k, F.lit('">x</a><a href="/jobs">y</a><a href="/1-'), k, F.lit('#top">z</a><a href="https://other.test/1-7">w</a>'))
    html = F.when(F.col("c_custkey") % 3 == 0, marked).when(F.col("c_custkey") % 3 == 1, plain).otherwise("<p>none</p>")
    pages = c.select("c_custkey", F.concat(F.lit("https://cv.test/list/"), k).alias("url"), html.alias("html"))
    return boards.harvest_links(pages, boards.LIST_LINK, boards.LINK, r"^https://cv\.test/1-\d+").select("c_custkey", "at", "link")


@query(f"""{_SQL}, h AS (SELECT url, string_agg(id || ':' || {_LABEL}, ',' ORDER BY id) AS history FROM a GROUP BY url), i AS (SELECT o_custkey AS url, string_agg(o_orderkey || ' ' || o_orderstatus, ',' ORDER BY o_orderkey) AS actions FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT v.url AS source_url, coalesce(history, '') AS history, coalesce(actions, '') AS actions, p.pinned AS pinned FROM v LEFT JOIN h USING (url) LEFT JOIN i USING (url) LEFT JOIN p USING (url)""")
def c13_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vacancy's events and actions in order, and its application's analysis."""
    analyses = _analyses(spark, sf_dir)
    history = analyses.select("vacancy_source_url", "id", F.col("fit_label").alias("new_status"))
    items = _t(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("vacancy_source_url"), F.col("o_orderkey").alias("action_id"), F.col("o_orderstatus").alias("title"))
    out = inbox.detail(_vacancies(spark, sf_dir).select("source_url"), analyses, _applications(spark, sf_dir), history, items)
    text = lambda name, key, value, mark: F.coalesce(F.array_join(F.transform(name, lambda x: F.concat(x[key].cast("string"), F.lit(mark), x[value])), ","), F.lit(""))
    return out.select("source_url", text("history", "id", "new_status", ":").alias("history"), text("actions", "action_id", "title", " ").alias("actions"), F.col("application.analysis_id").alias("pinned"))


@query("""
    WITH a AS (SELECT o_custkey AS c, 'https://j.test/' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '?utm_source=' || o_orderkey ELSE '' END AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'note ' || o_orderkey ELSE '' END AS note FROM orders),
    n AS (SELECT DISTINCT c, url, '[' || url || '] ' || note AS v FROM a WHERE note <> '')
    SELECT 'https://j.test/' || c AS vacancy_source_url, coalesce((SELECT string_agg(v, chr(10) ORDER BY url, v) FROM n WHERE n.c = k.c), '') AS notes FROM (SELECT DISTINCT c FROM a) k""")
def d4_merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of merged applications, each with the URL it came from."""
    key = F.col("o_orderkey")
    url = F.concat(F.lit("https://j.test/"), F.col("o_custkey").cast("string"), F.when(key % 2 == 0, F.concat(F.lit("?utm_source="), key.cast("string"))).otherwise(""))
    note = F.when(key % 3 == 0, F.concat(F.lit(" note "), key.cast("string"), F.lit(" "))).otherwise(" ")
    apps = _t(spark, sf_dir, "orders").select(url.alias("vacancy_source_url"), F.lit("Saved").alias("status"), note.alias("notes"), key.alias("analysis_id"))
    return lifecycle.merged_applications(apps).select("vacancy_source_url", "notes")


@query(f"""{_SQL}, n AS (SELECT url, score FROM l WHERE url % 3 <> 1)
    SELECT coalesce(p.url, n.url) AS vacancy_source_url, CASE WHEN n.url IS NULL THEN '' ELSE 'auto' END AS notes, CASE WHEN p.url IS NULL THEN 'Saved system normal' END AS event
    FROM p FULL JOIN n USING (url) WHERE p.url IS NOT NULL OR n.score >= 50""")
def j4_auto_save_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of saved applications, and an event for each new one."""
    newest = lifecycle.latest(_analyses(spark, sf_dir), "vacancy_source_url").where("vacancy_source_url % 3 <> 1").withColumn("note", F.lit("auto"))
    out, events = lifecycle.auto_save(_applications(spark, sf_dir), newest, 50)
    said = events.where("previous_status is null").select("vacancy_source_url", F.concat_ws(" ", "new_status", "origin", "kind").alias("event"))
    return out.join(said, "vacancy_source_url", "full").select("vacancy_source_url", "notes", "event")


@query(f"""{_SQL}, x AS (SELECT l.url FROM l JOIN v USING (url) ANTI JOIN p USING (url) WHERE score < 40),
    t AS (SELECT 'vacancies' AS name, url AS k, url FROM v UNION ALL SELECT 'analyses', id, url FROM a UNION ALL SELECT 'applications', url, url FROM p UNION ALL SELECT 'observations', event_id, user_id FROM events
          UNION ALL SELECT 'actions', o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0)
    SELECT name, count(*) AS n, sum(k)::BIGINT AS keys FROM t WHERE url NOT IN (SELECT url FROM x) GROUP BY name""")
def c7_five_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prune takes the rows of its vacancies out of all five tables."""
    vacancies, analyses, apps = _vacancies(spark, sf_dir), _analyses(spark, sf_dir), _applications(spark, sf_dir)
    pruned = lifecycle.prune_candidates(vacancies, analyses, apps, 40)
    tables = {
        "vacancies": vacancies.select("source_url", F.col("source_url").alias("k")), "analyses": analyses.select("vacancy_source_url", F.col("id").alias("k")), "applications": apps.select("vacancy_source_url", F.col("vacancy_source_url").alias("k")),
        "observations": _t(spark, sf_dir, "events").select(F.col("user_id").alias("vacancy_source_url"), F.col("event_id").alias("k")),
        "actions": _t(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("vacancy_source_url"), F.col("o_orderkey").alias("k")),
    }
    left = lifecycle.without_pruned(tables, pruned, {name: "source_url" if name == "vacancies" else "vacancy_source_url" for name in tables})
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum("k").alias("keys"))
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT o_orderkey AS action_id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END NULLS LAST, o_orderkey)::INT AS place FROM orders WHERE o_orderkey % 4 <> 0")
def j12_action_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of open actions, undated ones last."""
    o, key = _t(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = o.select(key.alias("action_id"), F.col("o_custkey").alias("vacancy_source_url"), F.when(key % 9 != 0, F.col("o_orderdate")).alias("due_at"), F.when(key % 4 == 0, F.col("o_orderdate")).alias("completed_at"))
    placed = with_place(tracking.actions(items, completed=False), [F.col("due_at").asc_nulls_last(), F.col("action_id")], keep=("action_id",))
    return placed.select("action_id", F.col("place").cast("int").alias("place"))


@query("""
    WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 7 ELSE (doc_id + 3) % 7 END AS y, doc_id % 101 AS fit FROM documents)
    SELECT doc_id, CASE WHEN y >= 5 THEN 'Requires ' || y || '+ years' WHEN y >= 3 THEN 'Experience requirement may be ' || y || '+ years' ELSE 'OK' END AS seniority_risk, (CASE WHEN y >= 5 THEN least(29, fit) ELSE fit END)::INT AS rank_score FROM r""")
def c8_own_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report rows whose vacancy is not stored are judged by their own fields, the others by the stored body."""
    id_, docs = F.col("doc_id"), _t(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://x.test/"), id_.cast("string"))
    asks = lambda n: F.concat(F.lit("requirements: "), n.cast("string"), F.lit("+ years of work"))
    rows = docs.select("doc_id", url.alias("url"), F.lit("Clerk").alias("title"), asks((id_ + 3) % 7).alias("company"), F.lit("").alias("location"), (id_ % 101).cast("int").alias("fit_score"), F.lit("OK").alias("language_risk"), F.lit("").alias("why"), F.lit("").alias("risks"))
    none = F.array().cast("array<string>")
    stored = docs.where("doc_id % 2 = 0").select(url.alias("source_url"), F.lit("Clerk").alias("title"), F.lit("").alias("company"), F.lit("").alias("location"), F.lit("").alias("salary_text"), F.array(asks(id_ % 7)).alias("requirements"), none.alias("responsibilities"))
    return ranking.refine(rows, stored).select("doc_id", "seniority_risk", "rank_score")


@query("""
    WITH e AS (SELECT user_id, (day(ts) - 1) // 10 AS p, CASE WHEN user_id % 2 = 0 THEN max(ts) ELSE min(ts) END AS ts FROM events GROUP BY 1, 2),
    m AS (SELECT p, max(ts) - INTERVAL 1 DAY AS mark FROM e GROUP BY p),
    a AS (SELECT user_id, ts FROM e WHERE p = 0),
    b AS (SELECT e.user_id, e.ts FROM e LEFT JOIN a USING (user_id), (SELECT mark FROM m WHERE p = 0) w WHERE e.p = 1 AND (a.ts IS NULL OR a.ts + INTERVAL 1 DAY <= w.mark)),
    c AS (SELECT e.user_id, e.ts FROM e LEFT JOIN a USING (user_id) LEFT JOIN b ON b.user_id = e.user_id, (SELECT mark FROM m WHERE p = 1) w WHERE e.p = 2 AND (coalesce(b.ts, a.ts) IS NULL OR coalesce(b.ts, a.ts) + INTERVAL 1 DAY <= w.mark))
    SELECT user_id, 0 AS batch, epoch_us(ts) AS at_us FROM a UNION ALL SELECT user_id, 1, epoch_us(ts) FROM b UNION ALL SELECT user_id, 2, epoch_us(ts) FROM c""")
def k2_expiring_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: three batches of ten days each; a page that was let through is known until the watermark is a day past it, and is let through again then."""
    folder = scratch_folder(spark)
    e = _t(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("p", F.floor((F.dayofmonth("ts") - 1) / 10).cast("int"))
    rows = e.groupBy("user_id", "p").agg(F.when(F.col("user_id") % 2 == 0, F.max("ts")).otherwise(F.min("ts")).alias("arrived_at")).withColumn("url", F.col("user_id").cast("string"))
    for p in range(3):
        rows.where(F.col("p") == p).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("user_id long, p int, arrived_at timestamp, url string").parquet(f"{folder}/in")
        observations.first_arrivals(stream, "1 day").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", F.col("p").alias("batch"), F.unix_micros("arrived_at").alias("at_us"))


# --- state tables that keep their partitioning ---------------------------------------------------------------

VACANCY = "source_url BIGINT, title STRING, original_source_url STRING, first_seen_at TIMESTAMP, first_seen_run_id BIGINT, last_seen_at TIMESTAMP, last_seen_run_id BIGINT"


@query(f"{_SQL} SELECT v.url AS source_url, v.title, analysis_id, score, {_LABEL} AS fit_label FROM v LEFT JOIN l USING (url)")
def c1_bucketed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vacancies with their newest analysis, both stored by URL: neither side is shuffled."""
    folder = scratch_folder(spark)
    vacancies = BucketedTable(spark, folder, "vacancies", "source_url BIGINT, title STRING", "source_url", 8, 8)
    analyses = BucketedTable(spark, folder, "analyses", "vacancy_source_url BIGINT, id BIGINT, score INT, fit_label STRING", "vacancy_source_url", 8, 8)
    vacancies.replace(_vacancies(spark, sf_dir).select("source_url", "title"))
    analyses.replace(_analyses(spark, sf_dir))
    return inbox.with_analysis(vacancies.read(), analyses.read()).select("source_url", "title", "analysis_id", "score", "fit_label")


@query("""
    SELECT c_custkey AS source_url, CASE WHEN n THEN 'new ' ELSE 'old ' END || c_name AS title, CASE WHEN o THEN 1 ELSE 9 END AS first_run, CASE WHEN n THEN 9 ELSE 1 END AS last_run
    FROM (SELECT *, c_custkey % 3 <> 0 AS o, c_custkey % 40 = 0 AS n FROM customer) WHERE o OR n""")
def j1_bucketed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small batch is merged into the segments that it touches."""
    c, at = _t(spark, sf_dir, "customer"), F.timestamp_seconds(F.lit(1704067200))
    rows = lambda df, word, run: df.select(
        F.col("c_custkey").alias("source_url"), F.concat(F.lit(f"{word} "), "c_name").alias("title"), F.lit(word).alias("original_source_url"), at.alias("first_seen_at"), F.lit(run).cast("long").alias("first_seen_run_id"), at.alias("last_seen_at"), F.lit(run).cast("long").alias("last_seen_run_id")
    )
    table = BucketedTable(spark, scratch_folder(spark), "vacancies", VACANCY, "source_url", 64, 8)
    table.replace(rows(c.where("c_custkey % 3 <> 0"), "old", 1))
    table.upsert(rows(c.where("c_custkey % 40 = 0"), "new", 9), lifecycle.upsert_vacancies)
    return table.read().select("source_url", "title", F.col("first_seen_run_id").alias("first_run"), F.col("last_seen_run_id").alias("last_run"))


@query("SELECT c_custkey, 'LD ' || c_name AS title FROM customer WHERE c_custkey % 7 < 6")
def b12_deep_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings up to five graphs deep; a seventh of the pages has none."""
    k = F.col("c_custkey")
    depth = (k % 7).cast("int")
    post = F.concat(F.lit('{"@type": "JobPosting", "title": "LD '), "c_name", F.lit('"}'))
    json = F.concat(F.repeat(F.lit('{"@graph": [{"@type": "Thing"}, '), depth), F.when(depth < 6, post).otherwise("[]"), F.repeat(F.lit("]}"), depth))
    pages = _t(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('<script type="application/ld+json">'), json, F.lit("</script>")).alias("html"))
    return pages.select("c_custkey", F.try_variant_get(extract.job_posting(F.col("html")), "$.title", "string").alias("title")).where("title is not null")
