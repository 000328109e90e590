import json

from pyspark.sql import functions as F

from jobmarket.operators import extract, lifecycle
from jobmarket.sources import boards
from jobmarket.streaming import observations


def test_sure_misses_stay_out_of_the_exchange(spark):
    stored = spark.range(3000).selectExpr("concat('https://s.test/', id * 3) AS source_url")
    batch = spark.range(6000).selectExpr("id", "if(id = 5999, null, concat('https://s.test/', id)) AS source_url", "repeat('html ', 50) AS html")
    for limit in (lifecycle.SKETCH_URLS, 10):
        lifecycle.SKETCH_URLS, old = limit, lifecycle.SKETCH_URLS
        known, new = lifecycle.known_and_new(batch, stored)
        lifecycle.SKETCH_URLS = old
        assert {r["id"] for r in known.select("id").collect()} == set(range(0, 5999, 3)) and new.count() == 4000 and known.columns == batch.columns
    words = 1 << max(6, (3000 // 4).bit_length())
    word, bits = lifecycle._bits(F.col("source_url"), words)
    hits = batch.withColumns({"_word": word, "_mine": bits}).join(lifecycle.url_sketch(stored, words), "_word").where("(_bits & _mine) = _mine")
    assert 2000 <= hits.count() < 2500  # the exact join, and its exchange, see few of the 4,000 misses
    known, _ = lifecycle.known_and_new(batch, stored)
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert "_bits" in plan and plan.index("LeftSemi") < plan.index("_bits")  # filtered below the join


def test_state_of_many_batches_stays_bounded(spark, tmp_path, monkeypatch):
    path, calls = str(tmp_path / "state"), []
    real = observations.listed
    monkeypatch.setattr(observations, "listed", lambda *a: calls.append(1) or real(*a))
    merge = observations.merge_batches(path, bucket_rows=20)
    want, per_batch = {}, []
    for batch in range(12):
        rows = [(f"https://x.test/{(batch * 37 + i * i) % 400}", f"2024-01-{1 + (batch * 7) % 28:02d}") for i in range(60)]
        for url, day in rows:
            first, last, n = want.get(url, (day, day, 0))
            want[url] = (min(first, day), max(last, day), n + 1)
        df = spark.createDataFrame(rows, "url string, d string").select("url", F.to_timestamp("d").alias("observed_at")).coalesce(1)
        calls.clear()
        merge(df, batch)
        if batch in (0, 7):
            merge(df, batch)  # a retry changes nothing
        per_batch.append(len(calls))
    got = {r["source_url"]: (str(r["first_seen_at"])[:10], str(r["last_seen_at"])[:10], r["n"]) for r in observations.read_sightings(spark, path).collect()}
    assert got == want
    manifests = sorted((tmp_path / "state" / "manifest").glob("[0-9]*"))
    buckets = json.loads(manifests[-1].read_text())
    assert len(manifests) == observations.KEEP and max(per_batch) <= 2  # one listing for a batch (a retried one lists twice)
    assert len(buckets) > 8 and max(b["rows"] for b in buckets) <= 40  # grown buckets were split
    folders = list((tmp_path / "state" / "data").glob("batch=*/bucket=*"))
    assert len(folders) <= (observations.KEEP + 1) * len(buckets)
    assert len({(b["depth"], b["bits"]) for b in buckets}) == len(buckets) and sum(2.0 ** -b["depth"] for b in buckets) == 1.0


def test_posting_at_any_depth(spark):
    post = {"@type": "JobPosting", "title": "Deep"}
    other = {"@type": "JobPosting", "title": "Shallow"}
    nest = lambda x, n: x if n == 0 else {"@graph": [{"@type": "Thing"}, [nest(x, n - 1)]]}
    ld = lambda *xs: "".join(f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>' for x in xs)
    pages = [
        (1, ld(nest(post, 4)), "Deep"), (2, ld({"@graph": [{"@graph": [{"@graph": [{"@graph": [post]}]}]}]}), "Deep"), (3, ld([[[[post]]]]), "Deep"), (4, ld("{broken", nest(post, 6), other), "Deep"),
        (5, ld(other, nest(post, 3)), "Shallow"), (6, ld({"@graph": [{"geo": [[1, 2]]}]}), None), (7, ld("[" * 5000 + "]" * 5000, post), "Deep"), (8, ld(post), "Deep"), (9, "", None),
    ]
    df = spark.createDataFrame([p[:2] for p in pages], "id long, html string")
    got = {r["id"]: r["t"] for r in df.select("id", F.try_variant_get(extract.job_posting(F.col("html")), "$.title", "string").alias("t")).collect()}
    assert got == {p[0]: p[2] for p in pages}


def test_one_board_with_most_links(spark):
    n = 20_000
    links = spark.range(n).selectExpr("if(id % 10 = 0, 'small', 'big') AS board", "0 AS position", "id div 100 AS page", "cast(id % 100 as int) AS at", "concat('l', id % 15000) AS link")
    got = {(r["board"], r["link"]): r["place"] for r in boards.frontier(links, 3000).collect()}
    first = {}
    for i in range(n):
        key = ("small" if i % 10 == 0 else "big", f"l{i % 15000}")
        first.setdefault(key, i)
    for board in ("small", "big"):
        order = sorted((i, link) for (b, link), i in first.items() if b == board)[:3000]
        assert [got[board, link] for _, link in order] == list(range(1, len(order) + 1))
    salts = links.where("board = 'big'").select(F.pmod(F.xxhash64("link"), F.lit(boards.FRONTIER_PARTS)).alias("s")).groupBy("s").count()
    assert salts.count() == boards.FRONTIER_PARTS and salts.agg(F.max("count")).first()[0] < 600  # no window sees the board whole
