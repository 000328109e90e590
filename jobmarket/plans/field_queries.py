"""Registered queries of page parsing, boards, profiles, model output and text functions, with the SQL they must equal.

The tables hold no job pages, so pages, settings and responses are made from columns of the given tables: a row's key picks
the layout, its other columns fill it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobmarket.functions import model_output, text, times, urls
from jobmarket.operators import extract, ranking, reports, score
from jobmarket.plans.registry import _LABEL, _refined, _spread, _t, _vacancies, query
from jobmarket.sources import boards, tables

def _key() -> Column:
    return F.col("c_custkey")


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _pick(key: Column, *values: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (key % len(values) + 1).cast("int"))


# --- fields of pages -----------------------------------------------------------------------------------

def _field_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layouts: data-testid, classes, ld+json alone, nothing but a heading."""
    k, seg, nation, name = _s("c_custkey"), F.col("c_mktsegment"), _s("c_nationkey"), F.col("c_name")
    testid = F.concat(
        F.lit('<div data-testid="company-name"><b>'), seg, F.lit(" &amp; Co</b></div><span data-testid=\"location\">City&nbsp;"), nation, F.lit('</span><i data-testid="salary">'), k,
        F.lit(' &euro;</i><span class="skill">R&amp;D '), nation, F.lit('</span><em class="tag">SQL</em><em class="tag">SQL</em><u class="badge">'), F.lit("long " * 13), F.lit('</u><section data-testid="job-description"> Do <b>'), name, F.lit("</b>\n now</section>"),
    )
    classes = F.concat(
        F.lit('<p class="x employer y">'), seg, F.lit('</p><p class="job-location">City '), nation, F.lit('</p><p class="compensation">&#8364; '), k, F.lit('</p><em class="skill-tag">&scaron;ok</em><main>Work &ndash; '), name, F.lit("</main>"),
    )
    posting = F.concat(
        F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": "JobPosting", "title": "LD", "description": "<p>Tasks of '), name, F.lit('</p>", "hiringOrganization": {"name": "'), seg,
        F.lit(' R&amp;D"}, "jobLocation": [{"address": {"addressLocality": "City '), nation, F.lit('", "addressCountry": "LT"}}, {"address": {"addressCountry": "LT"}}], "baseSalary": {"currency": "EUR", "value": {"minValue": '), k,
        F.lit(', "maxValue": '), (_key() + 10).cast("string"), F.lit(', "unitText": "MONTH"}}}]}</script>'),
    )
    head = F.concat(F.lit("<h1>Job "), name, F.lit("</h1>"))
    c = _spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_name"), "c_custkey")
    return c.select("c_custkey", F.concat(F.lit("https://b.test/ad/"), k, F.lit("/?x=1#y")).alias("url"), F.concat(head, _pick(_key(), testid, classes, posting, "")).alias("html"))


@query("""
    SELECT c_custkey, 'Job ' || c_name AS title, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || ' & Co' WHEN 1 THEN c_mktsegment WHEN 2 THEN c_mktsegment || ' R&D' ELSE '' END AS company,
           CASE c_custkey % 4 WHEN 2 THEN 'City ' || c_nationkey || ', LT' WHEN 3 THEN '' ELSE 'City ' || c_nationkey END AS location,
           CASE c_custkey % 4 WHEN 0 THEN c_custkey || ' €' WHEN 1 THEN '€ ' || c_custkey WHEN 2 THEN c_custkey || '-' || (c_custkey + 10) || ' EUR MONTH' ELSE '' END AS salary_text FROM customer""")
def b5_company_location_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered patterns, then the posting of the page."""
    return extract.vacancies(_field_pages(spark, sf_dir), boards.Board("b", ("b.test",))).select("c_custkey", "title", "company", "location", "salary_text")


@query("""
    SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'R&D ' || c_nationkey || '|SQL' WHEN 1 THEN 'šok' ELSE '' END AS skills,
           CASE c_custkey % 4 WHEN 0 THEN 'Do ' || c_name || ' now' WHEN 1 THEN 'Work – ' || c_name WHEN 2 THEN 'Tasks of ' || c_name ELSE '' END AS description FROM customer""")
def b11_skills_and_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags decoded, first of each, none longer than sixty characters; the first container with text."""
    out = extract.vacancies(_field_pages(spark, sf_dir), boards.Board("b", ("b.test",)))
    return out.select("c_custkey", F.array_join("requirements", "|").alias("skills"), F.array_join("responsibilities", "|").alias("description"))


@query("""
    SELECT c_custkey, 'LD' AS title, c_mktsegment || ' R&D' AS company, 'City ' || c_nationkey || ', LT' AS location, c_custkey || '-' || (c_custkey + 10) || ' EUR MONTH' AS salary_text, 'Tasks of ' || c_name AS description
    FROM customer WHERE c_custkey % 4 = 2""")
def b12_job_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posting inside @graph, its places and pay."""
    return extract.postings(_field_pages(spark, sf_dir).select("c_custkey", "html")).drop("html")


def _jobad_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, seg, nation = _s("c_custkey"), F.col("c_mktsegment"), _s("c_nationkey")
    pay = _pick(
        _key(), F.concat(F.lit('<h2>Atlyginimas</h2><div class="jobad_txt">'), k, F.lit(" EUR</div>")),
        F.concat(F.lit('<div class="data_tag_component_body salary_bl_x">nuo '), k, F.lit('</div><span class="data_tag_component_salary_amount">'), k, F.lit("</span>")), F.concat(F.lit('<div class="salary"> '), k, F.lit("+ </div>")),
    )
    needs = _pick(_key(), F.concat(F.lit('<h2>Reikalavimai darbuotojui</h2> <div class="jobad_txt"><ul><li>A&amp;B '), nation, F.lit("</li><li> </li><li>SQL</li></ul></div>")), F.concat(F.lit('<h2> Reikalavimai </h2><div class="jobad_txt">All of '), nation, F.lit("</div>")), '<div class="requirements"><ul><li>old</li></ul></div>')
    duties = _pick(_key() + 1, '<h2>Darbo pobūdis</h2><div class="jobad_txt"><li>build</li></div>', '<section><div class="jobad_txt">Intro &scaron;</div></section>', "")
    html = F.concat(F.lit('<i data-source-id="s'), k, F.lit('"></i><h1 id="jobad_heading1">Remote '), seg, F.lit('</h1><div id="jobad_location">City '), nation, F.lit(" - "), seg, F.lit("</div>"), pay, needs, duties)
    c = _spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    return c.select("c_custkey", F.concat(F.lit("https://www.cvbankas.lt/x/1-"), k).alias("url"), html.alias("html"))


@query("""
    SELECT c_custkey, 's' || c_custkey AS source_id, 'Remote ' || c_mktsegment AS title, c_mktsegment AS company, 'City ' || c_nationkey AS location,
           CASE c_custkey % 3 WHEN 0 THEN c_custkey || ' EUR' WHEN 1 THEN 'nuo ' || c_custkey ELSE c_custkey || '+' END AS salary_text,
           CASE c_custkey % 3 WHEN 0 THEN 'A&B ' || c_nationkey || '|SQL' WHEN 1 THEN 'All of ' || c_nationkey ELSE 'old' END AS requirements,
           CASE (c_custkey + 1) % 3 WHEN 0 THEN 'build' WHEN 1 THEN 'Intro š' ELSE '' END AS responsibilities FROM customer""")
def b6_jobad_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One board's layout, through its row of rules."""
    out = extract.vacancies(_jobad_pages(spark, sf_dir), boards.CVBANKAS)
    return out.select("c_custkey", "source_id", "title", "company", "location", "salary_text", F.array_join("requirements", "|").alias("requirements"), F.array_join("responsibilities", "|").alias("responsibilities"))


def _gate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _pick(
        _key(), "<h1>Clerk</h1>Just a Moment, remote", "<h1>Clerk</h1>office", '<h1>Remote clerk</h1><i class="location">Sankt, Москва</i>', "<p>remote work</p>", "<h1>Remote clerk</h1>", '<h1>Clerk</h1><i class="location">Minsk, Belarus</i>access denied',
        '<h1>Clerk</h1><i class="location">Belarus</i>',
    )
    return _spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.concat(F.lit("https://g.test/"), _s("c_custkey")).alias("url"), body.alias("html"))


@query("""
    SELECT c_custkey, ['blocked', 'not_remote', 'excluded_location', 'no_title', 'good', 'blocked', 'not_remote'][1 + c_custkey % 7] AS gate FROM customer""")
def b20_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the gate, in order."""
    out = extract.vacancies(_gate_pages(spark, sf_dir), boards.Board("g", ("g.test",), remote_only=True, exclude_locations=True))
    return out.select("c_custkey", F.coalesce("reject_reason", F.lit("good")).alias("gate"))


@query("""
    SELECT c_custkey, ['not', 'blocked', 'not', 'blocked', 'not'][1 + c_custkey % 5] AS page, ['blocked', 'blocked', 'not', 'blocked', 'blocked'][1 + c_custkey % 5] AS listing FROM customer""")
def b17_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title marker clears a vacancy page but no listing; listings are also judged by their markup."""
    html = _pick(_key(), '<b data-qa="vacancy-title">x</b> Captcha', "please solve the CAPTCHA", "<p>fine</p>", "Доступ ограничен", '<script src="challenge-platform.js"></script>ok')
    rows = _t(spark, sf_dir, "customer").select("c_custkey", html.alias("html"))
    say = lambda c: F.when(c, "blocked").otherwise("not")
    return rows.select("c_custkey", say(boards.page_blocked(F.col("html"), text.visible_text(F.col("html")), boards.HH)).alias("page"), say(boards.listing_blocked(F.col("html"), boards.HH)).alias("listing"))


@query("SELECT c_custkey, [true, true, false, false][1 + c_custkey % 4] AS remote, [true, false, true, false][1 + c_custkey % 4] AS excluded FROM customer")
def b18_remote_and_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers in title, place, URL and page with one letter folded; excluded places."""
    title, place = _pick(_key(), "Clerk УДАЛЁННО", "удаленная работа", "Clerk", "Clerk"), _pick(_key(), "Королёв, Уфа", "Vilnius", "  Казань ", "Kaunas")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", title.alias("t"), place.alias("p"))
    b = boards.HH
    return rows.select("c_custkey", boards.looks_remote(F.col("t"), F.col("p"), F.lit("https://hh.ru/vacancy/1"), F.lit("<p>x</p>"), b.remote_markers, b.fold_io).alias("remote"), boards.excluded_location(F.col("p"), b.excluded_locations).alias("excluded"))


_BOARDS = (boards.HH, boards.JUSTJOIN, boards.EUREMOTEJOBS, boards.STARTUP_JOBS)


@query("""
    SELECT c_custkey, ['hh', 'justjoin', 'euremotejobs', 'startup_jobs', NULL, 'hh', NULL][1 + c_custkey % 7] AS board,
           CASE c_custkey % 7 WHEN 0 THEN '' || c_custkey WHEN 1 THEN 'acme-' || c_custkey WHEN 2 THEN 'title-' || c_custkey WHEN 3 THEN 'title-' || c_custkey WHEN 5 THEN '' || c_custkey END AS source_id,
           CASE c_custkey % 7 WHEN 0 THEN 'https://spb.hh.ru/vacancy/' || c_custkey WHEN 1 THEN 'https://justjoin.it/job-offer/acme-' || c_custkey WHEN 2 THEN 'https://euremotejobs.com/job/title-' || c_custkey || '/'
                WHEN 3 THEN 'https://startup.jobs/title-' || c_custkey WHEN 5 THEN 'https://hh.ru/vacancy/' || c_custkey END AS source_url FROM customer""")
def b14_board_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page finds its board by host and path; the board's row gives id and canonical URL."""
    k = _s("c_custkey")
    url = _pick(
        _key(), F.concat(F.lit("https://spb.hh.ru/vacancy/"), k, F.lit("?from=x#y")), F.concat(F.lit("https://justjoin.it/job-offer/acme-"), k, F.lit("?a=b")), F.concat(F.lit("https://euremotejobs.com/job/title-"), k, F.lit("/?s=1")),
        F.concat(F.lit("https://startup.jobs/title-"), k, F.lit("/?utm=1")), F.concat(F.lit("https://euremotejobs.com/tag/"), k), F.concat(F.lit("https://hh.ru/vacancy/"), k, F.lit("/print")), F.concat(F.lit("https://nothh.ru/vacancy/"), k),
    )
    routed = boards.route(_t(spark, sf_dir, "customer").select("c_custkey", url.alias("url")), boards.board_rows(spark, _BOARDS))
    each = lambda f: F.coalesce(*[F.when(F.col("board") == b.name, f(b)) for b in _BOARDS])
    return routed.select("c_custkey", "board", each(lambda b: boards.source_id(F.col("url"), F.lit(""), b)).alias("source_id"), each(lambda b: boards.vacancy_url(F.col("url"), b)).alias("source_url"))


@query("SELECT c_custkey, c_custkey % 3 <> 0 AS needs FROM customer")
def b22_needs_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, some, none = F.col("c_mktsegment"), F.array("c_name"), F.array().cast("array<string>")
    rows = _t(spark, sf_dir, "customer").select("c_custkey", seg.alias("company"), F.when(_key() % 3 == 1, "").otherwise(seg).alias("location"), seg.alias("salary_text"), F.when(_key() % 3 == 2, none).otherwise(some).alias("requirements"), some.alias("responsibilities"))
    return rows.select("c_custkey", extract.needs_enrichment(rows).alias("needs"))


@query("""
    WITH t AS (SELECT p_partkey, trim(repeat(p_name || ' ', (p_partkey % 1900)::INT)) || CASE WHEN p_partkey % 3 = 0 THEN ' your job ' || trim(repeat(p_name || ' ', 600)) ELSE '' END AS t FROM part),
    c AS (SELECT *, strpos(t, 'your job') AS a FROM t),
    k AS (SELECT p_partkey, [trim(substr(t, 1, 12000)), CASE WHEN a > 0 THEN trim(substr(t, greatest(1, a - 800), a + 2800 - greatest(1, a - 800))) END, trim(CASE WHEN length(t) > 4000 THEN substr(t, length(t) - 3999) ELSE t END)] AS c FROM c),
    f AS (SELECT p_partkey, [x FOR x IN c IF x IS NOT NULL AND x <> ''] AS c FROM k)
    SELECT p_partkey, md5(substr(array_to_string([c[i] FOR i IN range(1, len(c) + 1) IF list_position(c, c[i]) = i], chr(10) || chr(10)), 1, 22000)) AS window_md5 FROM f""")
def b23_enrichment_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _spread(_t(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    long = F.concat(F.trim(F.repeat(F.concat("p_name", F.lit(" ")), (F.col("p_partkey") % 1900).cast("int"))), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" your job "), F.trim(F.repeat(F.concat("p_name", F.lit(" ")), F.lit(600))))).otherwise(""))
    return p.select("p_partkey", F.md5(extract.enrichment_text(long)).alias("window_md5"))


@query("SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{3000}]+', ' ', 'g')) AS t FROM documents)")
def b24_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


# --- boards, keywords, lists -----------------------------------------------------------------------------

@query("SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def a1_decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bytes of the texts, every third with a byte that no UTF-8 text holds: it is dropped."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FF")), raw)).otherwise(raw).alias("raw"))
    return docs.select("doc_id", F.md5(text.decoded_bytes(F.col("raw"))).alias("text_md5"))


@query("""
    WITH k AS (SELECT c_mktsegment AS keyword, row_number() OVER (ORDER BY c_mktsegment) - 1 AS position FROM customer GROUP BY 1)
    SELECT board, keyword, page::INT AS page, CASE board WHEN 'startup_jobs' THEN 'https://startup.jobs/remote-jobs?remote=true&w=remote&q=' || keyword || CASE WHEN page > 1 THEN '&page=' || page ELSE '' END
        WHEN 'euremotejobs' THEN 'https://euremotejobs.com/job-region/remote-jobs-europe/' || CASE WHEN page > 1 THEN 'page/' || page || '/' ELSE '' END || '?s=' || keyword
        ELSE 'https://hh.ru/search/vacancy?page=' || (page - 1) || '&text=' || keyword END AS url
    FROM (SELECT keyword, unnest(['startup_jobs', 'euremotejobs', 'hh']) AS board FROM k), range(1, 4) r(page)""")
def a2_listing_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of every keyword (a customer segment) on three boards; the first page is 1 (one board counts from 0)."""
    words = _t(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("keyword")).distinct()
    some = (boards.STARTUP_JOBS, boards.EUREMOTEJOBS, boards.HH)
    asked = words.withColumn("board", F.explode(F.array(*[F.lit(b.name) for b in some]))).withColumn("position", F.lit(0))
    out = boards.listing_urls(spark, some, asked, 3)
    return out.select("board", "keyword", (F.col("page") + F.when(F.col("board") == "hh", 1).otherwise(0)).cast("int").alias("page"), "url")


@query("""
    SELECT c_custkey, 'https://hh.ru/search/vacancy?text=' || c_mktsegment || '+x' || CASE c_custkey % 4 WHEN 0 THEN '&area=28' WHEN 3 THEN '&area=40&area=97' ELSE '&page=2' END ||
           CASE WHEN c_custkey % 4 IN (0, 3) THEN '' ELSE '&area=5&area=9&area=28&area=40&area=48&area=97&area=1001' END || '&schedule=remote&work_format=REMOTE' AS url FROM customer""")
def a5_forced_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://hh.ru/search/vacancy?text="), F.col("c_mktsegment"), F.lit("%20x"), _pick(_key(), "&area=28&schedule=fullDay", "&page=2&area=113", "&page=2&work_format=ON_SITE", "&area=16&area=40&area=97"))
    return _t(spark, sf_dir, "customer").select("c_custkey", boards.forced_filters(url, boards.HH).alias("url"))


@query("""
    SELECT n_name AS board, CASE WHEN n_nationkey % 5 = 0 THEN 'cli' WHEN n_nationkey % 2 = 0 THEN lower(n_name) || '|sql' ELSE 'alpha|beta' END AS keywords FROM nation""")
def a8_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each board (a nation): its own command-line word, else its own list, else the global one; the fallback is not reached."""
    n = _t(spark, sf_dir, "nation")
    own = n.where("n_nationkey % 2 = 0").select(F.lit("source").alias("level"), F.col("n_name").alias("board"), F.array(F.lower("n_name"), F.lit(" sql "), F.lit("SQL")).alias("keywords"))
    cli = n.where("n_nationkey % 5 = 0").select(F.lit("cli").alias("level"), F.col("n_name").alias("board"), F.array(F.lit("cli")).alias("keywords"))
    fixed = spark.createDataFrame([("global", None, ["alpha", "", "beta"]), ("fallback", None, ["none"]), ("cli", None, [" "])], "level string, board string, keywords array<string>")
    out = boards.resolve_keywords(n.select(F.col("n_name").alias("board")), own.unionByName(cli).unionByName(fixed))
    return out.select("board", F.array_join("keywords", "|").alias("keywords"))


@query("""SELECT p_partkey, 'https://x.test/a' || p_partkey || '|http://y.test/' || replace(p_name, ' ', '-') AS urls FROM part""")
def a6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("see https://x.test/a"), _s("p_partkey"), F.lit(", (http://y.test/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(').\nhttps://x.test/a'), _s("p_partkey"), F.lit('"'))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(urls.url_list(raw), "|").alias("urls"))


@query("""SELECT p_partkey, CASE WHEN length(u) > 40 THEN substr(u, 1, 39) || '…' ELSE u END AS short FROM (SELECT p_partkey, 'x.test/' || replace(p_name, ' ', '/') || repeat('/y', (p_partkey % 20)::INT) AS u FROM part)""")
def h21_short_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.concat(F.lit("https://X.test/"), F.replace("p_name", F.lit(" "), F.lit("/")), F.repeat(F.lit("/y"), (F.col("p_partkey") % 20).cast("int")), F.lit("?q=1"))
    return _t(spark, sf_dir, "part").select("p_partkey", urls.short_url(url, 40).alias("short"))


@query("""
    WITH s AS (SELECT source, doc_id FROM documents WHERE source IN ('src_0', 'src_1') OR true)
    SELECT source_name, source_position::INT AS source_position, n, failed FROM (
        SELECT 'even' AS source_name, 0 AS source_position, count(*) FILTER (doc_id % 2 = 0) AS n, 0 AS failed FROM s UNION ALL SELECT 'down', 1, 0, 1 UNION ALL SELECT 'odd', 2, count(*) FILTER (doc_id % 2 = 1), 0 FROM s)""")
def g1_union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources and one that failed."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "text")
    rows, summary = boards.union_sources(spark, [("even", docs.where("doc_id % 2 = 0")), ("down", None), ("odd", docs.where("doc_id % 2 = 1"))], "doc_id long, text string")
    n = rows.groupBy("source_position").agg(F.count("*").alias("n"))
    return summary.join(n, "source_position", "left").select("source_name", "source_position", F.coalesce("n", F.lit(0)).alias("n"), F.col("failed").cast("int").alias("failed"))


# --- profiles, settings, model output ----------------------------------------------------------------------

@query("""
    SELECT c_custkey, ['remote', 'hybrid:LT|office:', '', 'remote|office:' || c_mktsegment][1 + c_custkey % 4] AS work_modes, [NULL, 'B2', 'A1', NULL][1 + c_custkey % 4] AS level,
           [NULL, 6.0, 0.8, 0.0, 2.4, 0.5][1 + c_custkey % 6]::DOUBLE AS years, ['Candidate', c_name][1 + c_custkey % 2] AS name FROM customer""")
def a9_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as people write them: modes as words or objects, levels in any case, years as text."""
    c = _t(spark, sf_dir, "customer")
    none = F.lit(None).cast("array<string>")
    raw = c.select(
        _s("c_custkey").alias("profile_id"), *[none.alias(f.name) for f in score.PROFILE.fields if f.name not in ("profile_id", "years_of_experience", "max_english_level", "work_modes")],
        _pick(_key(), F.lit(None).cast("string"), "6", " 0.8 ", "-3", "2.35000001", "0.45000001").alias("years_of_experience"), _pick(_key(), "fluent", " b2", "A1 ", F.lit(None).cast("string")).alias("max_english_level"),
        _pick(_key(), '["Remote", "remote"]', '[{"mode": "HYBRID", "country": " LT "}, "office", "moon"]', "{bad", F.concat(F.lit('[{"mode": "remote", "country": "X"}, {"mode": "office", "country": "'), F.col("c_mktsegment"), F.lit('"}]'))).alias("work_modes"),
        F.when(_key() % 2 == 1, F.col("c_name")).alias("name"), F.lit(None).cast("string").alias("experience_level"),
    )
    out = tables.normal_profiles(raw)
    shown = F.array_join(F.transform("work_modes", lambda m: F.when(m["mode"] == "remote", m["mode"]).otherwise(F.concat(m["mode"], F.lit(":"), m["country"]))), "|")
    return out.select(F.col("profile_id").cast("long").alias("c_custkey"), shown.alias("work_modes"), F.col("max_english_level").alias("level"), F.col("years_of_experience").alias("years"), "name")


@query("SELECT c_custkey, [NULL, 'C1', 'A2', NULL][1 + c_custkey % 4] AS level, [NULL, 5, 2, NULL][1 + c_custkey % 4]::INT AS rank FROM customer")
def h12_cefr(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(_key(), "D1", " c1 ", "a2", F.lit(None).cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.cefr(raw).alias("level"), text.cefr_rank(raw).alias("rank"))


@query("SELECT c_custkey, [6.0, 0.8, 0.0, 2.4, 12.5, NULL, NULL][1 + c_custkey % 7]::DOUBLE AS years, ['6', '0.8', '0', '2.4', '12.5', NULL, NULL][1 + c_custkey % 7] AS shown FROM customer")
def h15_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H15, H17."""
    value = text.years(_pick(_key(), "6", "0.8", "-2", "2.36", "12.5", "many", F.lit(None).cast("string")))
    return _t(spark, sf_dir, "customer").select("c_custkey", value.alias("years"), text.years_text(value).alias("shown"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN least(100, c_custkey % 150) WHEN 1 THEN 0 WHEN 2 THEN 40 ELSE 40 END::INT AS threshold FROM customer")
def h18_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _pick(_key(), F.concat(F.lit(" "), (_key() % 150).cast("string")), "-5", "high", F.lit(None).cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.threshold(raw, 40).alias("threshold"))


@query("SELECT c_custkey, ['Saved', 'Offer', NULL, 'Withdrawn', NULL][1 + c_custkey % 5] AS status FROM customer")
def h20_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", text.status(_pick(_key(), " saved", "OFFER", "hired", "Withdrawn ", "")).alias("status"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN epoch(o_orderdate)::BIGINT + 36000 WHEN 1 THEN epoch(o_orderdate)::BIGINT + 36000 - 7200 WHEN 2 THEN epoch(o_orderdate)::BIGINT + 36000 + 19800 END AS at FROM orders")
def h4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO texts with an offset are instants in whole seconds; without one they are none."""
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'10:00:00"), _pick(F.col("o_orderkey"), ".750Z", "+02:00", "-0530", ""))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(times.utc_instant(raw)).alias("at"))


@query("""
    WITH w AS (SELECT o_orderkey, (o_orderkey % 16)::INT AS q, o_orderkey % 2 = 0 AS spring, [NULL, 0, 1][1 + o_orderkey % 3] AS fold FROM orders),
    t AS (SELECT *, CASE WHEN spring THEN epoch(TIMESTAMP '2024-03-31 00:00:00') ELSE epoch(TIMESTAMP '2024-10-27 00:00:00') END::BIGINT + q * 1800 AS wall FROM w)
    SELECT o_orderkey, CASE WHEN spring THEN CASE WHEN q < 6 THEN wall - 7200 WHEN q < 8 THEN NULL ELSE wall - 10800 END
                            ELSE CASE WHEN q < 6 THEN wall - 10800 WHEN q < 8 THEN CASE fold WHEN 0 THEN wall - 10800 WHEN 1 THEN wall - 7200 END ELSE wall - 7200 END END AS at,
           CASE WHEN spring AND q IN (6, 7) THEN 'nonexistent' WHEN NOT spring AND q IN (6, 7) AND fold IS NULL THEN 'ambiguous' END AS problem FROM t""")
def h5_wall_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours round both clock changes of a zone."""
    k = F.col("o_orderkey")
    wall = F.timestamp_seconds(F.when(k % 2 == 0, 1711843200).otherwise(1729987200) + (k % 16) * 1800).cast("timestamp_ntz")
    out = times.local_to_utc(wall, F.lit("Europe/Vilnius"), _pick(k, F.lit(None).cast("int"), F.lit(0), F.lit(1)))
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.unix_timestamp(out["at"]).alias("at"), out["problem"].alias("problem"))


@query("""
    SELECT o_orderkey, strftime(o_orderdate + INTERVAL (CASE WHEN s THEN 3 ELSE 2 END) HOUR, '%Y-%m-%dT%H:%M:%S') || CASE WHEN s THEN '+03:00' ELSE '+02:00' END AS shown
    FROM (SELECT *, month(o_orderdate) BETWEEN 5 AND 8 AS s FROM orders WHERE month(o_orderdate) NOT IN (3, 4, 9, 10))""")
def h6_local_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants of the months without a clock change, shown in a zone."""
    o = _t(spark, sf_dir, "orders").where(~F.month("o_orderdate").isin(3, 4, 9, 10))
    return o.select("o_orderkey", times.local_text(F.col("o_orderdate").cast("timestamp"), F.lit("Europe/Helsinki")).alias("shown"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of model response."""
    k = F.col("o_orderkey")
    n = (k % 140 - 20).cast("string")
    fields = F.concat(F.lit('"explanation": " fits ", "matched_points": ["a", null, 3, true, ["x"], " "], "missing_points": "one", "notes": null'))
    raw = _pick(
        k, F.concat(F.lit('{"score": '), n, F.lit(', "fit_label": "HIGH", '), fields, F.lit("}")), F.concat(F.lit('```json\n{"score": "about '), n, F.lit(' points", '), fields, F.lit("}\n```")),
        F.concat(F.lit('Sure: {"score": 79.9, '), fields, F.lit("} done")), F.concat(F.lit('{"score": true, "fit_label": "great"}')), "no object at all", "[1, 2]",
    )
    return _t(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


@query(f"""
    WITH s AS (SELECT o_orderkey, o_orderkey % 6 AS v, CASE o_orderkey % 6 WHEN 0 THEN least(100, greatest(0, o_orderkey % 140 - 20)) WHEN 1 THEN least(100, greatest(0, o_orderkey % 140 - 20)) WHEN 2 THEN 79 ELSE 0 END::INT AS score FROM orders)
    SELECT o_orderkey, score, CASE WHEN v = 0 THEN 'High' ELSE {_LABEL} END AS fit_label, CASE WHEN v < 3 THEN 'fits' ELSE '' END AS explanation, CASE WHEN v < 3 THEN 'a|3|True' ELSE '' END AS matched, CASE WHEN v < 3 THEN 'one' ELSE '' END AS missing, '' AS notes FROM s""")
def i17_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON in fences or prose, coerced field by field."""
    a = _responses(spark, sf_dir).select("o_orderkey", model_output.analysis(F.col("raw")).alias("a"))
    return a.select("o_orderkey", "a.score", "a.fit_label", "a.explanation", F.array_join("a.matched_points", "|").alias("matched"), F.array_join("a.missing_points", "|").alias("missing"), "a.notes")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN 'ai_assisted' ELSE 'rule_based' END AS analysis_method, CASE o_orderkey % 6 WHEN 0 THEN least(100, greatest(0, o_orderkey % 140 - 20)) WHEN 1 THEN least(100, greatest(0, o_orderkey % 140 - 20)) WHEN 2 THEN 79 ELSE 11 END::INT AS score FROM orders")
def c11_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete model analysis replaces the rule row."""
    r = _responses(spark, sf_dir)
    none = F.array().cast("array<string>")
    rules = r.select("o_orderkey", F.lit(11).alias("score"), F.lit("Low").alias("fit_label"), F.lit("rule").alias("explanation"), none.alias("matched_points"), none.alias("missing_points"), F.lit("").alias("notes"), F.lit("rule_based").alias("analysis_method"))
    return score.overlay(rules, r.select("o_orderkey", model_output.analysis(F.col("raw")).alias("analysis")), ["o_orderkey"]).select("o_orderkey", "analysis_method", "score")


@query("""
    SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'model' END AS company, CASE WHEN c_custkey % 3 = 0 THEN 'place' ELSE '' END AS location,
           CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'asked' ELSE '' END AS requirements FROM customer""")
def c10_filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's extraction fills only what the parser left empty."""
    c, none = _t(spark, sf_dir, "customer"), F.array().cast("array<string>")
    parsed = c.select("c_custkey", F.when(_key() % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("company"), F.lit("").alias("location"), F.lit("").alias("salary_text"), F.when(_key() % 2 == 0, F.array(F.lit("own"))).otherwise(none).alias("requirements"), none.alias("responsibilities"))
    model = c.select("c_custkey", F.lit(" model ").alias("company"), F.when(_key() % 3 == 0, "place").alias("location"), F.lit("").alias("salary_text"), F.when(_key() % 3 == 0, F.array(F.lit("asked"))).alias("requirements"), none.alias("responsibilities"))
    return extract.fill_missing(parsed, model, "c_custkey").select("c_custkey", "company", "location", F.array_join("requirements", "|").alias("requirements"))


# --- rule scores -------------------------------------------------------------------------------------------

@query("""SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 20 WHEN 'BUILDING' THEN 15 WHEN 'FURNITURE' THEN 10 ELSE 0 END::INT AS points,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'The vacancy title directly matches the target role: Machinery.' WHEN 'BUILDING' THEN 'The vacancy text strongly aligns with the target role: builder of roads.'
         WHEN 'FURNITURE' THEN 'The vacancy title partially aligns with the target role: furniture.maker expert.' ELSE '' END AS note FROM customer""")
def i5_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role in the title, in the text, and by overlapping words."""
    seg = F.lower("c_mktsegment")
    title = F.when(seg == "furniture", "old furniture maker wanted").otherwise(seg)
    hay = F.concat(title, F.when(seg == "building", " a builder of roads").otherwise(""))
    roles = F.array(F.lit("builder of roads"), F.lit("furniture.maker expert"), F.lit(" "), F.lit("Machinery"))
    return _t(spark, sf_dir, "customer").select("c_custkey", score.role_match(roles, title, hay).alias("r")).select("c_custkey", "r.points", "r.note")


@query("""SELECT c_custkey, [8, -8, 8, 0][1 + c_custkey % 4]::INT AS middle, [8, 8, 8, 0][1 + c_custkey % 4]::INT AS senior, [-8, -8, 8, 0][1 + c_custkey % 4]::INT AS beginner FROM customer""")
def i9_seniority_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a number of years the level words decide."""
    hay = _pick(_key(), "a middle clerk", "team lead", "entry level clerk", "clerk")
    points = lambda have: score.experience_match(F.lit(have), hay)["points"]
    return _t(spark, sf_dir, "customer").select("c_custkey", points(3.0).alias("middle"), points(7.0).alias("senior"), points(0.5).alias("beginner"))


@query(f"""
    WITH s AS (SELECT doc_id, contains(lower(text), 'license') AS a, contains(lower(text), 'the') AS b, (CASE WHEN contains(lower(text), 'license') THEN 25 ELSE 0 END + CASE WHEN contains(lower(text), 'the') THEN 2 ELSE 0 END)::INT AS score FROM documents)
    SELECT doc_id, score, 'Rule-based analysis marked this vacancy as a low fit with a score of ' || score || '.' AS explanation,
           array_to_string([x FOR x IN [CASE WHEN a THEN 'Matched skills: license' END, CASE WHEN b THEN 'Extra profile keywords found: the' END] IF x IS NOT NULL], ' ') AS matched,
           array_to_string([x FOR x IN [CASE WHEN NOT a THEN 'No core profile skills matched directly in the vacancy text.' END, 'The vacancy title does not closely match the target role.',
               'The vacancy location is outside the preferred locations.', CASE WHEN NOT b THEN 'No extra profile keywords were found.' END] IF x IS NOT NULL], ' ') AS missing, 'Used deterministic profile-to-vacancy keyword matching.' AS notes FROM s""")
def i14_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of a score."""
    p = spark.createDataFrame([("p", ["clerk"], ["license"], [], [], [], ["the"], [], None, None, None)], score.PROFILE)
    out = score.score(_t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.lower("text").alias("searchable")), p)
    return out.select("doc_id", "score", "explanation", F.array_join("matched_points", " ").alias("matched"), F.array_join("missing_points", " ").alias("missing"), "notes")


@query("""
    WITH s AS (SELECT doc_id, contains(lower(text), 'license') AS a, least(100, (CASE WHEN contains(lower(text), 'license') THEN 25 ELSE 0 END) + 10)::INT AS score FROM documents)
    SELECT doc_id, score, 'Low' AS fit_label, CASE WHEN a THEN 'Matched skills: license' ELSE 'The vacancy has general alignment with the active profile.' END AS matched, 'ai_assisted' AS analysis_method FROM s""")
def i15_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("p", [], ["license"], [], [], [], [], [], None, None, None)], score.PROFILE)
    out = score.boosted(score.score(_t(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.lower("text").alias("searchable")), p))
    return out.select("doc_id", "score", "fit_label", F.array_join("matched_points", " ").alias("matched"), "analysis_method")


@query("""
    SELECT c_custkey AS source_url, profile, c_name AS title, profile || ' skill' AS skill, c_mktsegment AS company, 'text of ' || c_name AS vacancy_text FROM customer, (SELECT unnest(['p1', 'p2']) AS profile)""")
def i16_model_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for an analysis (each profile) and for an extraction, read back from their JSON."""
    none = F.array().cast("array<string>")
    v = _vacancies(spark, sf_dir).select("source_url", "source_name", "title", "company", "location", F.lit("").alias("salary_text"), none.alias("requirements"), none.alias("responsibilities"), F.lit("raw").alias("raw_text"))
    p = spark.createDataFrame([(n, [], [f"{n} skill"], [], [], [], [], [], None, None, None) for n in ("p1", "p2")], score.PROFILE)
    asked = score.requests(v, p)
    get = lambda c, path: F.get_json_object(c, path)
    texts = score.extraction_requests(v, F.concat(F.lit("text of "), "title")).withColumnRenamed("payload", "other")
    both = asked.join(texts, "source_url")
    return both.select("source_url", F.col("profile_id").alias("profile"), get("payload", "$.vacancy.title").alias("title"), get("payload", "$.profile.skills[0]").alias("skill"), get("other", "$.current_fields.company").alias("company"), get("other", "$.vacancy_text").alias("vacancy_text"))


# --- ranking and its reports -----------------------------------------------------------------------------------

_RANKED = """
    WITH r AS (SELECT doc_id, source, doc_id % 7 AS y, doc_id % 101 AS fit, CASE doc_id % 5 WHEN 0 THEN 'Senior clerk' WHEN 1 THEN 'Junior clerk' ELSE 'Clerk' END AS title, CASE doc_id % 4 WHEN 0 THEN 'C1 English' ELSE 'OK' END AS lang FROM documents),
    s AS (SELECT *, CASE WHEN doc_id % 5 = 1 THEN 'OK' WHEN doc_id % 5 = 0 THEN 'Senior-like title: senior' WHEN y >= 5 THEN 'Requires ' || y || '+ years' WHEN y >= 3 THEN 'Experience requirement may be ' || y || '+ years' ELSE 'OK' END AS seniority_risk FROM r),
    b AS (SELECT *, seniority_risk LIKE 'Senior%' OR seniority_risk LIKE 'Requires%' AS senior FROM s),
    d AS (SELECT *, senior OR lang <> 'OK' AS blocked, CASE WHEN senior OR lang <> 'OK' THEN least(29, fit) ELSE fit END AS rank_score FROM b)"""


@query(f"{_RANKED} SELECT doc_id, row_number() OVER (ORDER BY blocked, rank_score DESC, fit DESC, lower(title), 'https://x.test/' || doc_id)::INT AS rank FROM d")
def a12_report_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of every row, not only of the first ones."""
    return tables.with_rank(_refined(spark, sf_dir)).select("doc_id", "rank")


@query(f"{_RANKED} SELECT doc_id, CASE WHEN title = 'Junior clerk' THEN 'junior/entry signal' ELSE '' END AS why, senior AS seniority_blocked, lang <> 'OK' AS language_blocked FROM d")
def i24_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir).select("doc_id", "why", "seniority_blocked", "language_blocked")


@query(f"""{_RANKED}, x AS (SELECT 'seniority' AS list, *, seniority_risk AS said FROM d WHERE senior UNION ALL SELECT 'language', *, lang FROM d WHERE lang <> 'OK'),
    n AS (SELECT *, row_number() OVER (PARTITION BY list ORDER BY fit DESC, lower(title), 'https://x.test/' || doc_id) AS rank FROM x)
    SELECT list, doc_id, '| ' || rank || ' | ' || fit || ' | ' || said || ' | ' || coalesce(source, '') || ' | [' || title || '](https://x.test/' || doc_id || ') |  |  | [open](https://x.test/' || doc_id || ') |' AS markdown_row FROM n WHERE rank <= 140""")
def a15_exclusion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was excluded by seniority and by language, best fit first."""
    r = _refined(spark, sf_dir)
    lists = [reports.excluded_rows(r, why, ranking.CUTS["markdown"][i]).select(F.lit(why).alias("list"), "doc_id", "markdown_row") for i, why in ((1, "seniority"), (2, "language"))]
    return lists[0].unionByName(lists[1])


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def d7_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.source_counts(_refined(spark, sf_dir))


@query("""
    SELECT c_custkey, '## ' || c_name || chr(10) || '- Source: board' || chr(10) || '- Source ID: ' || c_custkey || chr(10) || '- Company: ' || c_mktsegment || chr(10) || '- Location: ' || chr(10) || '- Salary: Not specified' || chr(10) ||
        '- Vacancy URL: [u' || c_custkey || '](u' || c_custkey || ')' || chr(10) || chr(10) || '### Extracted Vacancy Data' || chr(10) || '- Requirements / skills:' || chr(10) || CASE WHEN c_custkey % 2 = 0 THEN '  - a b' || chr(10) || '  - c' ELSE '  - Not extracted' END || chr(10) ||
        '- Responsibilities / description:' || chr(10) || '  - Not extracted' || chr(10) || '- Raw text excerpt:' || chr(10) || '  ' || CASE WHEN c_custkey % 3 = 0 THEN 'Not extracted' WHEN c_custkey % 3 = 1 THEN c_name ELSE repeat('word ', 279) || 'word...' END || chr(10) || chr(10) ||
        '### Preliminary Software Analysis' || chr(10) || 'Use this only as a weak hint. Re-score independently from the vacancy data above.' || chr(10) || '- Analysis method: rule_based' || chr(10) || '- Score: ' || (c_custkey % 101) || chr(10) ||
        '- Fit label: Low' || chr(10) || '- Explanation: because' || chr(10) || '- Matched points: x, y' || chr(10) || '- Missing points: None' || chr(10) || '- Application status: ' || CASE WHEN c_custkey % 2 = 0 THEN 'Saved' ELSE 'Not tracked' END || chr(10) AS section FROM customer""")
def a13_vacancy_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = _spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").select(
        "c_custkey", F.col("c_name").alias("title"), F.lit("board").alias("source_name"), _s("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("company"), F.lit("").alias("location"), F.lit("").alias("salary_text"), F.concat(F.lit("u"), _s("c_custkey")).alias("source_url"),
        F.when(_key() % 2 == 0, F.array(F.lit("a \n b"), F.lit("c"))).otherwise(none).alias("requirements"), none.alias("responsibilities"), _pick(_key(), "<script>no</script>", F.concat(F.lit("<p>"), "c_name", F.lit("</p>")), "word " * 500).alias("raw_text"),
        F.lit("rule_based").alias("analysis_method"), (_key() % 101).alias("score"), F.lit("Low").alias("fit_label"), F.lit("because").alias("explanation"), F.array(F.lit("x"), F.lit("y")).alias("matched_points"), none.alias("missing_points"), F.when(_key() % 2 == 0, "Saved").alias("application_status"),
    )
    return reports.vacancy_sections(rows).select("c_custkey", "section")


@query("""
    SELECT c_custkey, '## ' || c_name || chr(10) || '- Source: board' || chr(10) || '- Source ID: ' || c_custkey || chr(10) || '- Company: ' || c_mktsegment || chr(10) || '- Location: Not specified' || chr(10) || '- Application status: Applied' || chr(10) ||
        '- Notes: None' || chr(10) || '- Latest score: ' || CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 101)::VARCHAR ELSE 'Not available' END || chr(10) || '- Latest fit label: Not available' || chr(10) || '- Vacancy URL: [u](u)' || chr(10) AS section FROM customer""")
def a14_tracked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_name").alias("title"), F.lit("board").alias("source_name"), _s("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("company"), F.lit("").alias("location"), F.lit("Applied").alias("status"), F.lit("").alias("notes"),
        F.when(_key() % 2 == 0, _key() % 101).alias("score"), F.lit(None).cast("string").alias("fit_label"), F.lit("u").alias("vacancy_source_url"),
    )
    return reports.tracked_sections(rows).select("c_custkey", "section")
