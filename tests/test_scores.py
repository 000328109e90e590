import random

from pyspark.sql import functions as F

from jobmarket.operators import score


def profile(profile_id, **values):
    return {**dict.fromkeys([f.name for f in score.PROFILE.fields]), "profile_id": profile_id, **values}


def corpus(n=40):
    rng = random.Random(4)
    parts = ["ab", "cé", "ing", "data", " ", "x", "lead", "日本", "𝒳y", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(60)) for _ in range(n)] + ["", "ab", "a"]
    terms = {t[i:i + k] for t in texts[:n] for i, k in ((rng.randrange(100), rng.randrange(1, 9)) for _ in range(20))} | {"nowhere", "zz", "dataing", "ab ab"}
    return texts, sorted(t for t in terms if t)


def test_trigram_pass_finds_what_contains_finds(spark):
    texts, terms = corpus()
    assert len(terms) > score.FEW_TERMS
    df = spark.createDataFrame([(t,) for t in texts], "hay string")
    hay = F.col("hay")
    for subset in (terms, terms[:50], []):
        for r in df.select("hay", F.array_sort(score.found_terms(hay, subset)).alias("found")).collect():
            assert r["found"] == sorted(t for t in subset if t in r["hay"])
    tested = df.where("length(hay) > 50").select(F.size(score.term_candidates(hay, terms)).alias("n")).agg(F.avg("n")).first()[0]
    assert tested < len(terms) / 2
    plan = df.select(score.found_terms(hay, terms).alias("found"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == plan.count("split(array_join(")  # the dictionary is a constant; only what a text reached is split


def test_terms_that_profiles_share_are_tested_once(spark):
    """5,000 profiles over 300 terms: a text's term tests are those of the 300 terms, and each profile's score is the one it has alone."""
    rng = random.Random(5)
    texts, terms = corpus()
    terms = [t.strip() for t in terms if len(t.strip()) > 2][:300]
    rows = [profile(f"p{i}", skills=[t.upper() + " " for t in rng.sample(terms, 4)], must_have_skills=rng.sample(terms, 2), additional_keywords=[terms[i % len(terms)]], preferred_locations=[rng.choice(terms)], target_roles=[rng.choice(terms)]) for i in range(5000)]
    many = spark.createDataFrame(rows, score.PROFILE)
    few = spark.createDataFrame(rows[:100], score.PROFILE)
    assert set(score.dictionary(many)) <= {t.lower() for t in terms} and len(score.dictionary(many)) <= 300
    v = spark.createDataFrame([(i, t[:20], t) for i, t in enumerate(texts[:3])], "v long, title string, searchable string")
    keep = ("v", "profile_id", "score", "matched_points", "missing_points")
    alone = {tuple(r)[:2]: tuple(r)[2:] for r in score.score(v, few).select(*keep).collect()}
    together = {tuple(r)[:2]: tuple(r)[2:] for r in score.score(v, many).select(*keep).collect()}
    assert len(together) == 15_000 and all(together[k] == alone[k] for k in alone)
    tests = lambda p: v.select(F.size(score.term_candidates(F.col("searchable"), score.dictionary(p))).alias("n")).agg(F.sum("n")).first()[0]
    assert tests(many) <= 3 * len(terms)
    hits = {(r["v"], r["profile_id"], r["list"], r["term"]) for r in score.term_hits(v, few).collect()}
    want = {(i, p["profile_id"], k, t.strip().lower()) for i, x in enumerate(texts[:3]) for p in rows[:100] for k in ("skills", "must_have_skills", "additional_keywords", "preferred_locations", "target_roles") for t in p[k] if t.strip().lower() in x}
    assert hits == want


def test_empty_location_is_everywhere_and_null_terms_are_none(spark):
    v = spark.createDataFrame([("t", "text")], "title string, searchable string")
    p = spark.createDataFrame([profile("p", preferred_locations=[""], skills=[None, " ", "ex"])], score.PROFILE)
    r = score.score(v, p).first()
    assert r["matched_points"] == ["Matched skills: ex", "The vacancy location matches the preferred location."]
