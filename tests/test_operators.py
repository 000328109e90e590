import random

from pyspark.sql import functions as F

from jobmarket.operators import extract, inbox, lifecycle, ranking, reports, score, tracking
from jobmarket.sources import boards

PAGE = """<html><head><title>t</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "LD title", "hiringOrganization": {"name": "Automation Studio"},
 "jobLocation": [{"address": {"addressLocality": "Remote", "addressCountry": "Europe"}}], "baseSalary": {"currency": "EUR", "value": {"minValue": 3000, "maxValue": 5000, "unitText": "MONTH"}}}]}</script></head>
<body><h1>AI <b>engineer</b></h1><span class="skill">n8n</span><span class="tag">Python</span><span class="tag">n8n</span><main>Work from home &amp; build</main></body></html>"""
JOBAD = """<div data-x><h1 id="jobad_heading1">IT inžinierius (-ė)</h1><h2 id="jobad_company_title">Venipak</h2><div id="jobad_location">Kaunas - Other</div>
<h2>Reikalavimai</h2> <div class="jobad_txt"><ul><li>Python</li><li> SQL </li></ul></div><h2>Darbo pobūdis</h2><div class="jobad_txt">Kurti</div><div class="salary"> 2600-3400 EUR </div></div>"""


def test_page_fields_and_gate(spark):
    board = boards.Board("b", ("b.test",), remote_only=True, exclude_locations=True)
    rows = [("https://b.test/job/7?x=1", PAGE), ("https://b.test/e", "<h1>Office</h1>"), ("https://b.test/m", '<h1>remote</h1><i class="location">Москва</i>'), ("https://b.test/n", "<p>remote</p>"), ("https://b.test/s", "<h1>x</h1>Just a moment"), (None, None)]
    out = {r["url"]: r for r in extract.vacancies(spark.createDataFrame(rows, "url string, html string"), board).collect()}
    r = out["https://b.test/job/7?x=1"]
    assert (r["title"], r["company"], r["location"], r["salary_text"], r["requirements"], r["responsibilities"]) == ("AI engineer", "Automation Studio", "Remote, Europe", "3000-5000 EUR MONTH", ["n8n", "Python"], ["Work from home & build"])
    assert (r["source_id"], r["source_url"], r["reject_reason"]) == ("job/7", "https://b.test/job/7", None)
    assert [out[u]["reject_reason"] for u in ("https://b.test/e", "https://b.test/m", "https://b.test/n", "https://b.test/s")] == ["not_remote", "excluded_location", "no_title", "blocked"]


def test_jobad_layout(spark):
    df = spark.createDataFrame([("https://x.test/darbas/1-13867124", JOBAD)], "url string, html string")
    r = df.select(*[c.alias(k) for k, c in extract.jobad_fields(F.col("html"), F.col("url"), ["Reikalavimai"], ["Darbo pobūdis"]).items()]).first()
    assert tuple(r) == ("1-13867124", "IT inžinierius (-ė)", "Venipak", "Kaunas", "2600-3400 EUR", ["Python", "SQL"], ["Kurti"])


def test_frontier_and_links(spark):
    two = [boards.Board("a", ("a.test",), listing="https://a.test/jobs", filters=(("remote", "1"),)), boards.Board("p", ("p.test",), listing="https://p.test/", paged_listing="https://p.test/page/{page}/", parameters=(("s", "{keyword}"),))]
    words = spark.createDataFrame([("a", "no code", 0), ("p", "x", 0)], "board string, keyword string, position int")
    got = sorted(r["url"] for r in boards.listing_urls(spark, two, words, 2).collect())
    assert got == ["https://a.test/jobs?q=no+code&page=2&remote=1", "https://a.test/jobs?q=no+code&remote=1", "https://p.test/?s=x", "https://p.test/page/2/?s=x"]
    pages = spark.createDataFrame([("https://a.test/l", '<a class="x list_a" href="/1-5?a=1&amp;b=2#f">x</a><a class="list_a" href="https://a.test/1-5?a=1&b=2">y</a><a href="/1-9">z</a>')], "url string, html string")
    assert [r["link"] for r in boards.harvest_links(pages, boards.LIST_LINK, boards.LINK, r"/1-\d+").collect()] == ["https://a.test/1-5?a=1&b=2"]
    routed = boards.route(spark.createDataFrame([("https://www.a.test/x",), ("https://nota.test/x",), (None,)], "url string"), boards.board_rows(spark, two)).collect()
    assert {r["url"]: r["board"] for r in routed} == {"https://www.a.test/x": "a", "https://nota.test/x": None, None: None}


def profile(spark, **values):
    row = dict.fromkeys([f.name for f in score.PROFILE.fields])
    return spark.createDataFrame([{**row, "profile_id": "p", **values}], score.PROFILE)


def test_rule_score_and_sentences(spark):
    v = spark.createDataFrame([("u", "Python Backend Developer", "python backend developer baltic systems vilnius sql git rest api 3 years english c1 hybrid")], "source_url string, title string, searchable string")
    p = profile(spark, target_roles=["Python Backend Developer"], skills=["Python", "SQL", "sql", "Rust"], must_have_skills=["Git", "Go"], nice_to_have_skills=["REST"], preferred_locations=["Vilnius"], additional_keywords=["api"], excluded_keywords=["cobol"], years_of_experience=3.0, max_english_level="B2", work_modes=[("hybrid", "Lithuania")])
    r = score.score(v, p).first()
    assert r["score"] == max(0, min(100, int(3 / 4 * 25) + int(1 / 2 * 30) + 3 + 20 + 10 + 2 + 10 - 40 + 10)) and r["fit_label"] == "Medium"
    assert r["matched_points"][0] == "Matched skills: Python, SQL, sql" and "Experience level matches the vacancy expectation (3+ years)." in r["matched_points"]
    assert r["matched_points"][-1] == "Hybrid role in Lithuania matches your work-mode preference." and "English requirement (C1) is above your B2 ceiling." in r["missing_points"]
    b = score.boosted(score.score(v, p)).first()
    assert b["score"] == r["score"] + 10
    responses = spark.createDataFrame([("u", "p", (90, "High", "fine", ["m"], [], ""))], "source_url string, profile_id string, analysis struct<score:int,fit_label:string,explanation:string,matched_points:array<string>,missing_points:array<string>,notes:string>")
    o = score.overlay(score.score(v, p), responses, ["source_url", "profile_id"]).first()
    assert (o["score"], o["analysis_method"]) == (90, "ai_assisted")


def test_role_overlap_keeps_last_note(spark):
    v = spark.createDataFrame([("u", "senior data clerk", "senior data clerk sales")], "source_url string, title string, searchable string")
    r = score.score(v, profile(spark, target_roles=["sales", "data-clerk lead"])).first()
    assert r["score"] == 15 and r["matched_points"] == ["The vacancy title partially aligns with the target role: data-clerk lead."]


def test_ranking_windows(spark):
    cases = [
        ("Clerk", "we are a company with 10 years on the market", "OK"), ("Clerk", "requirements: 6 years of experience", "Requires 6+ years"), ("Clerk", "you have 3-4 years experience", "Experience requirement may be 4+ years"),
        ("Team Lead", "x", "Senior-like title: lead, team lead"), ("Junior lead", "9 years experience", "OK"), ("Clerk", "история", "OK"), ("Clerk", "опыт от 5 лет", "Requires 5+ years"),
    ]
    df = spark.createDataFrame([(t, b) for t, b, _ in cases], "t string, b string")
    named = df.withColumn("name", ranking.title_and_url(F.col("t"), F.lit("https://x.test"))).withColumn("years", ranking.year_requirements(F.lower("b")))
    got = named.select(ranking.seniority(F.col("name"), F.col("years"))["risk"].alias("r")).collect()
    assert [r["r"] for r in got] == [c[2] for c in cases]


def test_identity_merge(spark):
    rows = [("https://x.test/a?utm_source=n", "Variant", "2024-01-01 00:00:05", 1, "2024-01-01 00:00:10", 1), ("https://x.test/a", "Canonical Title", "2024-01-01 00:00:20", 2, "2024-01-01 00:00:30", None)]
    df = spark.createDataFrame(rows, "source_url string, title string, f string, first_seen_run_id long, l string, last_seen_run_id long").withColumns({"first_seen_at": F.to_timestamp("f"), "last_seen_at": F.to_timestamp("l")})
    r = lifecycle.merged_vacancies(df).first()
    assert (r["title"], str(r["first_seen_at"]), str(r["last_seen_at"]), r["first_seen_run_id"], r["last_seen_run_id"]) == ("Canonical Title", "2024-01-01 00:00:05", "2024-01-01 00:00:30", 1, 1)
    apps = spark.createDataFrame([("https://x.test/a?utm_source=n", "Interview", "call", 4), ("https://x.test/a", "Saved", "first", 9)], "vacancy_source_url string, status string, notes string, analysis_id long")
    a = lifecycle.merged_applications(apps).first()
    assert (a["status"], a["analysis_id"], a["notes"]) == ("Interview", 9, "[https://x.test/a] first\n[https://x.test/a?utm_source=n] call")
    assert lifecycle.aliases(df).count() == 2
    obs = spark.createDataFrame([(1, "https://x.test/a", "00:00:10", "s1", "o1"), (1, "https://x.test/a?utm_source=n", "00:00:30", "s2", "o2")], "run_id long, vacancy_source_url string, t string, source_name string, original_source_url string").withColumn("observed_at", F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")))
    o = lifecycle.merged_observations(obs).first()
    assert (o["source_name"], o["original_source_url"]) == ("s2", "o1\no2")


def test_upsert_keeps_first_and_moves_last(spark):
    cols = "source_url string, title string, original_source_url string, first_seen_at string, first_seen_run_id long, last_seen_at string, last_seen_run_id long"
    old = spark.createDataFrame([("u", "old", "o", "t1", 1, "t1", 1), ("w", "w", None, "t1", 1, "t1", 1)], cols)
    new = spark.createDataFrame([("u", "new", "x", "t2", 2, "t2", None), ("v", "v", "y", "t2", 2, "t2", 2)], cols)
    got = {r["source_url"]: tuple(r)[1:] for r in lifecycle.upsert_vacancies(old, new).collect()}
    assert got["u"] == ("new", "o", "t1", 1, "t2", None) and got["v"][0] == "v" and got["w"][0] == "w"
    seen = spark.createDataFrame([("w", "t3", None)], "source_url string, observed_at string, run_id long")
    w = {r["source_url"]: r for r in lifecycle.observe_known(old, seen).collect()}["w"]
    assert (w["last_seen_at"], w["last_seen_run_id"]) == ("t3", 1)
    known, fresh = lifecycle.known_and_new(new, old)
    assert [r["source_url"] for r in known.collect()] == ["u"] and [r["source_url"] for r in fresh.collect()] == ["v"]


def test_prune_and_auto_save(spark):
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "source_url string")
    an = spark.createDataFrame([(1, "a", 90), (2, "a", 12), (3, "b", 15), (4, "c", 80)], "id long, vacancy_source_url string, score int")
    apps = spark.createDataFrame([("b", None, "Saved", "")], "vacancy_source_url string, analysis_id long, status string, notes string")
    assert [r["source_url"] for r in lifecycle.prune_candidates(v, an, apps, 40).collect()] == ["a"]
    out, events = lifecycle.auto_save(apps, an.where("id > 1").withColumn("note", F.lit("n")), 40)
    assert {r["vacancy_source_url"]: (r["analysis_id"], r["notes"]) for r in out.collect()} == {"b": (3, "n"), "c": (4, "n")} and [r[0] for r in events.collect()] == ["c"]


def test_status_fold_equals_plain_machine(spark):
    rng = random.Random(3)
    names = [*tracking.TRANSITIONS, "Bogus"]
    commands = [(i, f"u{rng.randrange(6)}", rng.choice(names), rng.choice(["normal", "normal", "corrective"]), rng.choice(["", "", "why"])) for i in range(300)]
    apps = spark.createDataFrame([(f"u{i}", "Saved") for i in range(5)], "vacancy_source_url string, status string")
    df = spark.createDataFrame(commands, "id long, vacancy_source_url string, new_status string, kind string, reason string")
    got = {r["id"]: (r["previous_status"], r["verdict"]) for r in tracking.apply_commands(apps, df).collect()}
    now, want = {f"u{i}": "Saved" for i in range(5)}, {}
    for i, u, new, kind, reason in commands:
        s, c = now.get(u), kind == "corrective"
        v = "no_application" if s is None else "unknown_status" if new == "Bogus" else "reason_required" if c and not reason else "reason_refused" if reason and not c else "unchanged" if s == new else "accepted" if c or new in tracking.TRANSITIONS[s] else "not_allowed"
        want[i] = (s, v)
        if v == "accepted":
            now[u] = new
    assert got == want
    folded = tracking.apply_commands(apps, df)
    assert {r[0]: r["status"] for r in tracking.final_status(apps, folded).collect()} == now
    assert tracking.broken_history(tracking.accepted_events(folded)).count() == 0


def test_actions_and_reminders(spark):
    rows = [(1, "x", "u", "create", " call ", "2026-08-08 07:00", "2026-08-01 00:00"), (2, "y", "u", "create", "later", "2026-08-08 20:00", "2026-08-01 00:00"), (3, "z", "u", "create", " ", None, "2026-08-01 00:00"), (4, "w", "none", "create", "t", None, "2026-08-01 00:00"),
            (5, "q", "u", "create", "done", "2026-08-08 08:00", "2026-08-01 00:00"), (6, "q", "u", "complete", None, None, "2026-08-02 00:00"), (7, "q", "u", "complete", None, None, "2026-08-03 00:00")]
    df = spark.createDataFrame(rows, "id long, action_id string, vacancy_source_url string, op string, title string, d string, a string").withColumns({"due_at": F.to_timestamp("d"), "at": F.to_timestamp("a")})
    items = tracking.apply_actions(spark.createDataFrame([("u",)], "source_url string"), df)
    got = {r["action_id"]: r for r in items.collect()}
    assert set(got) == {"x", "y", "q"} and got["x"]["title"] == "call" and str(got["q"]["completed_at"]) == "2026-08-02 00:00:00"
    due = tracking.reminders(items, F.to_timestamp(F.lit("2026-08-08 12:00"))).collect()
    assert {r["action_id"]: r["reminder_state"] for r in due} == {"x": "overdue", "y": "due_soon"}


def test_inbox_filters(spark):
    v = spark.createDataFrame([("a", "Backend Engineer", "c", "s1", 1, 2), ("b", "Analyst", "C", "s2", 2, 2), ("o", "old", "", "s1", 1, 1)], "source_url string, title string, company string, source_name string, first_seen_run_id long, last_seen_run_id long").withColumn("last_seen_at", F.current_timestamp())
    an = spark.createDataFrame([(1, "a", 90, "High"), (2, "b", 30, "Low")], "id long, vacancy_source_url string, score int, fit_label string")
    apps = spark.createDataFrame([("a", "Applied")], "vacancy_source_url string, status string")
    runs = spark.createDataFrame([(1, "completed", 1), (2, "partial", 2), (3, "failed", 3)], "id long, status string, finished_at int")
    titles = lambda **q: [r["title"] for r in inbox.inbox(v, an, apps, runs, inbox.InboxQuery(**q)).collect()]
    assert titles(min_score=50, hide_below=True, sort="title") == ["Backend Engineer"] and titles(sort="title") == ["Analyst", "Backend Engineer"]
    assert titles(status="Applied") == ["Backend Engineer"] and titles(label="Low") == ["Analyst"] and titles(new_only=True) == ["Analyst"] and len(titles(current_run=False)) == 3
    assert inbox.inbox(v, an, apps, runs.limit(0)).count() == 0


def test_reports(spark):
    blocks = "\n\n".join("x" * 80 + "\n" + "y" * 9 for _ in range(20))
    parts = [r["chunk"] for r in reports.chunk_messages(spark.createDataFrame([(1, blocks), (2, "short"), (3, "z" * 700)], "i int, text string"), 300).orderBy("i", "part").collect()]
    assert all(len(p) <= 300 for p in parts) and "".join(parts[:-4]).replace("\n", "") == blocks.replace("\n", "") and parts[-4:] == ["short", "z" * 300, "z" * 300, "z" * 100]
    row = spark.createDataFrame([("T", "s", "1", "", "", "", "https://u.test", ["a"], [], "<p>raw</p>", "rule_based", 9, "Low", "e", ["m"], [], None)], "title string, source_name string, source_id string, company string, location string, salary_text string, source_url string, requirements array<string>, responsibilities array<string>, raw_text string, analysis_method string, score int, fit_label string, explanation string, matched_points array<string>, missing_points array<string>, application_status string")
    section = reports.vacancy_sections(row).first()["section"]
    assert section.startswith("## T\n- Source: s\n") and "- Salary: Not specified" in section and "  - a\n- Responsibilities / description:\n  - Not extracted" in section and "- Application status: Not tracked\n" in section


def plain_enrichment(text):
    chunks = []

    def add(c):
        c = " ".join(c.split())
        if c and c not in chunks:
            chunks.append(c)

    add(text[:12_000])
    for word in extract.ENRICH_WORDS:
        at = 0
        for _ in range(2):
            i = text.lower().find(word, at)
            if i < 0:
                break
            add(text[max(0, i - 800):i + 2800])
            at = i + len(word)
    add(text[-4000:])
    return "\n\n".join(chunks)[:22_000]


def test_enrichment_text_equals_plain_model(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "Requirements", "you will", "gamma", "atlyginimas"]
    texts = [" ".join(rng.choice(words[:2] * 40 + words) for _ in range(n)) for n in (0, 5, 900, 3000, 6000)]
    df = spark.createDataFrame([(f"<p>{t}</p><script>requirements</script>",) for t in texts], "html string")
    got = [r[0] for r in df.select(extract.enrichment_text(F.col("html"))).collect()]
    assert [g or "" for g in got] == [plain_enrichment(t) for t in texts]


def test_extraction_fills_only_gaps(spark):
    cols = "source_url string, company string, location string, salary_text string, requirements array<string>, responsibilities array<string>"
    parsed = spark.createDataFrame([("u", "own", "", None, [], ["r"]), ("w", "", "", "", [], [])], cols)
    model = spark.createDataFrame([("u", "other", " place ", "5", ["q"], ["x"])], cols)
    got = {r["source_url"]: tuple(r)[1:] for r in extract.fill_missing(parsed, model).collect()}
    assert got == {"u": ("own", "place", "5", ["q"], ["r"]), "w": ("", "", "", [], [])}
    assert [r[0] for r in parsed.select(extract.needs_enrichment(parsed)).collect()][1] is True
