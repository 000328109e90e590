import html
import random
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pytest
from pyspark.sql import functions as F

from jobmarket.functions import model_output, text, times, urls
from jobmarket.operators import score


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def plain_canonical(url):
    p = urlsplit(url.strip())
    scheme, name = (p.scheme or "https").lower(), (p.hostname or "").lower()
    if not name:
        return url.strip()
    port = f":{p.port}" if p.port and (scheme, p.port) not in (("https", 443), ("http", 80)) else ""
    path = p.path or "/"
    path = path if path == "/" else path.rstrip("/")
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in urls.TRACKING_NAMES]
    return urlunsplit((scheme, name + port, path, urlencode(sorted(kept)), ""))


def test_canonical_url_equals_plain_model(spark):
    cases = [
        "HTTPS://Example.test:443/jobs/python/?utm_source=newsletter&b=2&a=1#frag", "http://u:p@Host.test:80/a//", "http://h.test:8080/?x=&y", "https://h.test///", "h.test/path", "//h.test/p?q=1", " https://h.test ",
        "https://h.test/?a=%C3%A9&a=b+c&z=*~", "https://h.test?fbclid=1&GCLID=2&k=v", "https://h.test/p;x?a=1;b=2", "https://h.test:0/x", "",
    ]
    rng = random.Random(4)
    for _ in range(150):
        q = "&".join(rng.choice(["a=1", "b=", "c", "utm_x=3", "é=ü", "d=%20e", "mc_cid=9", "a=0"]) for _ in range(rng.randrange(4)))
        cases.append(rng.choice(["http", "HTTPS"]) + "://" + rng.choice(["A.test", "b.c.test:443", "d.test:80"]) + rng.choice(["", "/", "/x/", "/x/y//"]) + ("?" + q if q else "") + rng.choice(["", "#f"]))
    out = spark.createDataFrame([(c,) for c in cases], "x string").select("x", urls.canonical_url(F.col("x")).alias("y")).collect()
    assert [(r["x"], r["y"]) for r in out] == [(c, plain_canonical(c)) for c in cases]


def test_visible_text_decodes_first(spark):
    samples = ["<p>a &amp;amp; b&lt;i&gt;c</p><script>x</script>", "&eacute;&#233;&copy;", "<style>p{}</style> t u ", "&amp;lt;", ""]
    rows = spark.createDataFrame([(s,) for s in samples], "x string").select(text.visible_text(F.col("x")).alias("v"), text.unescape(F.col("x")).alias("u")).collect()
    assert [r["v"] for r in rows] == ["a & b c".replace("& b c", "&amp; b c"), "éé©", "t u", "<".replace("<", "&lt;"), ""]
    assert [r["u"] for r in rows] == [html.unescape(s) for s in samples]


def test_lists_and_levels(spark):
    assert one(spark, "AI automation, low-code; no-code\nRPA, rpa ", text.keyword_list) == ["AI automation", "low-code", "no-code", "RPA"]
    assert one(spark, "see https://a.test/x, <https://b.test/y>; https://a.test/x (https://c.test/z).", urls.url_list) == ["https://a.test/x", "https://b.test/y", "https://c.test/z"]
    assert [one(spark, x, text.cefr) for x in (" b2 ", "c1", "fluent", None)] == ["B2", "C1", None, None]
    assert [one(spark, x, text.years) for x in ("6", "0.84", "-3", "lots", None)] == [6.0, 0.8, 0.0, None, None]
    assert [one(spark, x, text.status) for x in ("applied", " OFFER", "gone")] == ["Applied", "Offer", None]
    assert [one(spark, x, lambda c: text.threshold(c, 40)) for x in ("55", "500", "x", None)] == [55, 100, 40, 40]
    assert one(spark, "javascript:alert(1)", urls.safe_link) == "#" and one(spark, " HTTPS://a.test ", urls.safe_link) == "HTTPS://a.test"
    modes = one(spark, '[{"mode":"Remote","country":"Lithuania"},{"mode":"hybrid","country":" Lithuania "},"office",{"mode":"hybrid","country":"Poland"},{"mode":"bogus"}]', text.work_modes_from_json)
    assert [(m["mode"], m["country"]) for m in modes] == [("remote", ""), ("hybrid", "Lithuania"), ("office", "")]
    assert one(spark, '"no list"', text.work_modes_from_json) == []
    assert one(spark, "<a href='x'>&", text.escape_html) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"


@pytest.mark.parametrize("raw,want", [("150", 100), ("-20", 0), ('"85"', 85), ('"85%"', 85), ('"high"', 0), ("null", 0), ("[]", 0), ("true", 0), ("72.9", 72), ('"-5 of 9"', 0)])
def test_scores_from_models(spark, raw, want):
    assert one(spark, raw, lambda c: model_output.score(F.try_parse_json(c))) == want


@pytest.mark.parametrize("raw,want", [('"only one"', ["only one"]), ("null", []), ("42", []), ('["a",2,"",null,{},["x"],"  b ",true]', ["a", "2", "b", "True"])])
def test_lists_from_models(spark, raw, want):
    assert one(spark, raw, lambda c: model_output.string_list(F.try_parse_json(c))) == want


def test_analysis_from_prose(spark):
    raw = 'Here you are:\n```json\n{"score": "81", "fit_label": "HIGH", "explanation": " ok ", "matched_points": "one", "missing_points": [1], "notes": null}\n```'
    for r in (raw, raw[raw.index("```"):], raw + " bye"):
        a = one(spark, r, model_output.analysis)
        assert (a["score"], a["fit_label"], a["explanation"], a["matched_points"], a["missing_points"], a["notes"]) == (81, "High", "ok", ["one"], ["1"], "")
    a = one(spark, "[1, 2]", model_output.analysis)
    assert (a["score"], a["fit_label"], a["matched_points"]) == (0, "Low", [])


@pytest.mark.parametrize("hay,want", [
    ("english: c1 required", 5), ("c1 english is a must", 5), ("anglų k. b2", 4), ("english b1 or higher, fluent english preferred", 5), ("english needed; german a2", None), ("no mention", None),
    ("german c1, english b2", 4), ("english b2, german c2", 4), ("native english", 6),
])
def test_english_level(spark, hay, want):
    assert one(spark, hay, score.english_rank) == want


def test_experience(spark):
    points = lambda need, have: one(spark, f"at least {need} years", lambda c: score.experience_match(F.lit(have), c)["points"])
    assert points(1, 1.0) == 10 and points(1, 0.8) == 6 and points(1, 0.8) > points(1, 0.6) > points(1, 0.4) and points(5, 0.8) < 0
    assert one(spark, "a senior role", lambda c: score.experience_match(F.lit(1.0), c)["points"]) == -8
    assert one(spark, "a senior role", lambda c: score.experience_match(F.lit(None).cast("double"), c)["points"]) == 0


@pytest.mark.parametrize("hay,want", [("fully remote python role", "remote"), ("nuotolinis darbas", "remote"), ("2 days remote, hybrid model", "hybrid"), ("a role", "office")])
def test_work_mode(spark, hay, want):
    assert one(spark, hay, score.work_mode) == want


def test_wall_times(spark):
    rows = [("2026-03-29T03:30", None), ("2026-10-25T03:30", None), ("2026-10-25T03:30", 0), ("2026-10-25T03:30", 1), ("2026-07-01T12:00", None)]
    df = spark.createDataFrame(rows, "w string, fold int").select(times.local_to_utc(F.col("w").cast("timestamp_ntz"), F.lit("Europe/Vilnius"), F.col("fold")).alias("r"))
    got = [(r["problem"], r["at"]) for r in df.select("r.problem", F.date_format("r.at", "yyyy-MM-dd HH:mm").alias("at")).collect()]
    assert got == [("nonexistent", None), ("ambiguous", None), (None, "2026-10-25 00:30"), (None, "2026-10-25 01:30"), (None, "2026-07-01 09:00")]
    assert one(spark, "2026-01-02T03:04:05.9+02:00", lambda c: times.utc_instant(c).cast("string")) == "2026-01-02 01:04:05"
    assert one(spark, "2026-01-02T03:04:05", times.utc_instant) is None
    assert one(spark, "2026-07-01T09:00:00Z", lambda c: times.local_text(times.utc_instant(c), F.lit("Europe/Vilnius"))) == "2026-07-01T12:00:00+03:00"
