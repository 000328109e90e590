"""Work that is heavy for each row is spread over tasks, and its parts are made once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from jobmarket.functions import text
from jobmarket.operators import extract, reports
from jobmarket.sources import boards

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["b23_enrichment_window", "b5_company_location_salary", "b11_skills_and_description", "b12_job_posting", "b20_reject_reasons", "b6_jobad_layout", "a13_vacancy_sections"])
def test_rows_of_a_small_file_are_spread(spark, name):
    assert e.queries()[name](spark, SMALL).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_words_of_an_enrichment_text_are_found_with_repeats(spark):
    x = "a " * 7000 + "YOUR JOB" + " b" * 3000 + " your job " + "c " * 4000 + "    Requirements\n"
    got = spark.createDataFrame([(x,)], "x string").select(extract.enrichment_text(F.col("x"))).first()[0]
    t = " ".join(x.split())
    at = [t.lower().index("your job"), t.lower().rindex("your job"), t.index("Requirements")]
    cut = lambda i: t[max(0, i - 800): i + 2800].strip()
    want = [t[:12000].strip(), cut(at[2]), cut(at[0]), cut(at[1]), t[-4000:].strip()]
    assert got == "\n\n".join(want)[:22000]


def test_collapse_of_every_kind_of_run(spark):
    samples = ["a b", "a  b", " a", "a ", "a\tb", "a \tb", "a\t b", "\x1c a  　b\n", "", " ", "a \x85 b", None]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "x string").select(text.collapse(F.col("x"))).collect()]
    assert got == [None if s is None else " ".join(s.split()) for s in samples]


def test_unclosed_references_stay_where_only_closed_ones_are_read(spark, tmp_path):
    page = "<html><head><title>R&amp;D &amp</title></head><body><article>a &quot;&copy &amp;lt; &eacute;&eacute &#233;</article></body></html>"
    spark.createDataFrame([(1, "https://x.test/a", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert e.queries()["b1_visible_text"](spark, str(tmp_path)).first()["visible"] == "R&D &amp a \"&copy &lt; é&eacute é"
    assert e.queries()["b4_page_fields"](spark, str(tmp_path)).first()["title"] == "R&D &amp"
    assert [spark.createDataFrame([("&amp &eacute",)], "x string").select(text.unescape(F.col("x"), unclosed=u)).first()[0] for u in (True, False)] == ["& é", "&amp &eacute"]


@pytest.mark.parametrize("name", ["b5_company_location_salary", "b11_skills_and_description", "b12_job_posting", "b6_jobad_layout"])
def test_a_page_is_decoded_and_parsed_once(spark, name):
    plan = e.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    udfs = {x.split("(")[0] + x.split("#")[-1] for x in plan.replace("_unescape", "\n_unescape").split("\n") if x.startswith("_unescape")}
    assert 1 <= len(udfs) <= 2 and plan.count("parse_json") <= 3


def test_vacancy_fields_with_rare_references_and_marks(spark):
    html = '<h1>A&eacute; \x01 &amp;lt;</h1><p class="company">&scaron; &amp; c</p><em class="tag">R&amp;D</em><em class="tag"> </em><em class="tag">&eacute;</em><main>x &lt;b&gt; y</main>'
    ld = '<script type="application/ld+json">{"@type": "JobPosting", "title": "T &eacute;", "baseSalary": {"currency": "EUR", "value": {"maxValue": 5, "unitText": "HOUR"}}}</script>'
    rows = spark.createDataFrame([(1, "https://x.test/a/", html), (2, "https://x.test/b", ld), (3, None, None)], "id long, url string, html string")
    got = {r["id"]: r for r in extract.vacancies(rows, boards.Board("x", ("x.test",))).collect()}
    assert (got[1]["title"], got[1]["company"], got[1]["requirements"], got[1]["responsibilities"]) == ("Aé \x01 &lt;", "š & c", ["R&D", "é"], ["x y"])
    assert (got[2]["title"], got[2]["salary_text"], got[2]["reject_reason"]) == ("T é", "up to 5 EUR HOUR", None)
    assert (got[3]["title"], got[3]["requirements"], got[3]["reject_reason"]) == ("", [], "no_title")


def test_chunks_are_cut_in_slices_of_a_batch(spark):
    texts = ["a" * 9, "", None, "x" * 3801, "ab\n" * 3000 + "   tail", ("p" * 3000 + "\n\n") * 3, " " * 4000 + "y", "é\n\n" + "z" * 8000] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    out = reports.chunk_messages(df)
    assert "mapinpandas" not in out._jdf.queryExecution().executedPlan().toString().lower()  # held whole batches of texts, copies and chunks
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["id"], r["part"])):
        assert r["part"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["chunk"])
    want = [["a" * 9], None, None, ["x" * 3800, "x"], None, ["p" * 3000, "p" * 3000, "p" * 3000 + "\n\n"], ["", "y"], ["é", "z" * 3800, "z" * 3800, "z" * 400]]
    for i in range(len(texts)):
        if i % 8 != 4:
            assert got.get(i) == want[i % 8], i % 8
    assert all(len(x) <= 3800 for x in got[4]) and "\n".join(got[4]).replace(" ", "") == texts[4].replace(" ", "")
