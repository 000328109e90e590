import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmarket.llm import hamming, html_text, quality, shingle_join
from jobmarket.llm.common import crc_mod

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- op4 ---------------------------------------------------------------------------------------------

@pytest.mark.parametrize("segments", [3, 5, 8])
def test_top_k_is_exact(spark, segments, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 150)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(400)]
    rows += [(i + 400, rows[i % 7][1]) for i in range(60)] + [(900, None), (901, []), (None, rows[0][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").select("id", hamming.sign_code().alias("code"))
    got = defaultdict(list)
    for r in hamming.top_k(df, df.where("id % 10 = 0"), 7, segments).orderBy("place").collect():
        got[r["query_id"]].append((r["distance"], r["neighbour_id"]))
    codes = {i: [x > 0 for x in v] for i, v in rows if v and i is not None}
    for q in [i for i in codes if i % 10 == 0]:
        want = sorted((sum(a != b for a, b in zip(codes[q], codes[i])), i) for i in codes)[:7]
        assert got[q] == want
    assert len(got) == len([i for i in codes if i % 10 == 0])
    empty = df.limit(0)
    assert hamming.top_k(empty, empty).count() == 0 and hamming.top_k(df, empty).count() == 0


@pytest.mark.parametrize("block", [65_536, 30])
def test_repeated_ids_take_one_place(spark, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    rng = random.Random(8)
    rows = [(i, rng.getrandbits(62)) for i in range(60)]
    rows += [rows[20]] * 30 + [(20, rows[20][1] ^ (1 << b)) for b in range(12)] + [(30, rows[20][1] ^ (3 << b)) for b in range(12)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = [(r["distance"], r["neighbour_id"]) for r in hamming.top_k(df, df.where("id = 20"), 5).orderBy("place").collect()]
    asked = [c for i, c in rows if i == 20]
    assert got == sorted((min((c ^ q).bit_count() for j, c in rows if j == i for q in asked), i) for i in range(60))[:5]


def test_common_codes_keep_the_smallest_ids(spark, monkeypatch):
    """A code of very many ids: ties go to the smallest, also for ids that have a second code."""
    monkeypatch.setattr(hamming, "BLOCK", 40)
    rows = [(i, 7) for i in range(500)] + [(i, 6) for i in range(100, 103)] + [(1000 + i, 7 ^ (1 << i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, code long")
    for code in (7, 6, 5):
        got = [(r["distance"], r["neighbour_id"]) for r in hamming.top_k(df, spark.createDataFrame([(1, code)], "id long, code long"), 10).orderBy("place").collect()]
        best = {}
        for i, c in rows:
            best[i] = min(best.get(i, 99), (c ^ code).bit_count())
        assert got == sorted((d, i) for i, d in best.items())[:10]


@pytest.mark.parametrize("width", [63, 65])
def test_vectors_of_another_width_are_refused(spark, width):
    df = spark.createDataFrame([(1, [1.0] * width)], "id long, embedding array<float>")
    with pytest.raises(Exception, match="64 components"):
        df.select(hamming.sign_code().alias("code")).collect()


# --- op5 ---------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x:1}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Site</header><!-- <p>no</p> --><div class="ad">Buy</div>
<article><h1>Title&nbsp;&lt;b&gt;</h1><p><b>One<br><p>Two
 three &copy; <em>f</em>our</p><ul><li>i1<li>i2</ul><aside>side</aside><div class="share-box">Share</div><form><p>mail</p></form>
<section id="comments"><p>reader says</p></section><table><tr><td>c1<td>c2</table></article><footer>&copy; foot</footer></body></html>"""


def test_article_text():
    assert html_text.Page(PAGE).text(frozenset()) == "Title <b>\nOne\nTwo three © four\ni1\ni2\nc1\nc2"


@pytest.mark.parametrize("source", ["", "   ", "plain &amp; text", "<p>a<p", "<!-- open", "<article>", "</p></div>x", "<script>never ends", "<p " + "a='" * 200, "<div>" * 3000 + "deep"])
def test_broken_html(source):
    text = html_text.Page(source).text(frozenset())
    assert "<div>" not in text
    assert html_text.Page(source).hashes()


def test_templates_are_removed_per_host(spark):
    def page(i, site, body):
        return (i, f"http://{site}/p{i}?q", f"<html><body><div><p>Welcome to {site}</p><p>Call us</p></div><div><p>{body}</p></div></body></html>")

    rows = [page(i, "a.test", f"text number {i}") for i in range(12)] + [page(100, "b.test", "alone")] + [(200, None, None), (201, "bad", "")]
    rows += [page(i + 300, "c.test", "the same copied text") for i in range(9)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == ("text number 3", 13) and got[200] == ("", 0) and got[201] == ("", 0)
    assert got[100][0] == "Welcome to b.test\nCall us\nalone"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copied_article_is_no_template(spark):
    rows = [(i, "http://x.test/", f"<body><nav>m</nav><article><p>copied text</p><div><p>Share this page</p></div></article><p>n{i}</p></body>") for i in range(8)]
    rows += [(i, "http://x.test/", f"<body><nav>m</nav><article><p>own text {i}</p><div><p>Share this page</p></div></article></body>") for i in range(8, 16)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "copied text" and got[12] == "own text 12"


@pytest.mark.parametrize("page", [
    "<body><nav>m</nav><article><h1>title {i}</h1><div><p>same body</p></div></article></body>",
    "<body><article><h1>title {i}</h1><section><p>one</p></section><ul><li>two</ul><table><tr><td>three</table></article></body>",
    "<body><h1>title {i}</h1><p>2024-01-{i}</p><p>same body</p><div><p>second part</p></div></body>",
])
def test_articles_copied_under_other_titles_stay(spark, page):
    rows = [(i, "http://y.test/", page.format(i=i)) for i in range(10, 16)]
    rows += [(i, "http://y.test/", f"<body><article><h1>t</h1><p>own text {i}</p></article></body>") for i in range(16, 30)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == html_text.Page(page.format(i=i)).text(frozenset()) for i in range(10, 16))


def bare(i, site):
    """A layout without any tag, role or class that tells furniture from content."""
    return (i, f"http://{site}/p{i}", f"<html><body><div><div>Home of {site}</div><div>All jobs</div></div><div><div>Title {i}</div><div>Body number {i} of the site</div></div><div>Imprint of {site}<div>Phone</div></div></body></html>")


def test_recurrence_alone_cleans_bare_pages(spark):
    rows = [bare(i, "d.test") for i in range(30)] + [bare(i, "few.test") for i in range(100, 103)]
    got = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i]["text"] == f"Title {i}\nBody number {i} of the site" and got[i]["n_templates"] == 2 for i in range(30))
    assert all(got[i]["text"].startswith("Home of few.test\n") and got[i]["n_templates"] == 0 for i in range(100, 103))


def brute_texts(rows, min_pages=5, min_share=0.2):
    """Templates by counting in plain Python: for each host and subtree the different rests of its pages."""
    rests, pages = defaultdict(set), defaultdict(set)
    parsed = []
    for page_id, url, source in rows:
        site, page = (url or "").partition("//")[2].split("/")[0].lower(), html_text.Page(source or "")
        dead, main = page.layout()
        hashes, marks = page.hashes(), page.outside(dead, main)
        for n in page.candidates(dead, main):
            rests[site, hashes[n]].add(marks[n])
        pages[site].add(marks[0])
        parsed.append((page_id, site, page))
    out = []
    for page_id, site, page in parsed:
        known = {h for (s, h), m in rests.items() if s == site and len(m) >= min_pages and len(pages[site]) >= min_pages and len(m) >= min_share * len(pages[site])}
        out.append((page_id, page.text(known)))
    return sorted(out)


def test_query_equals_brute_force(spark, tmp_path):
    from jobmarket.llm.registry import op5_template_removal

    rng = random.Random(5)
    rows = [bare(i, "d.test") for i in range(12)]
    for i in range(12, 90):
        site = rng.choice(["x.test", "y.test", "z.test"])
        parts = [f"<nav><a>m</a> {site}</nav>", "<div class='ad'>buy</div>", f"<div><p>Share {site}</p></div>", f"<aside>near {rng.randrange(3)}</aside>", f"<article><h1>t{i}</h1><p>text {rng.randrange(40)}</p><div>more on {site}</div></article>", "<footer>f</footer>"]
        rows.append((i, f"http://{site}/{i}", "<body>" + "".join(p for p in parts if rng.random() < 0.8) + "</body>"))
    rows += [(200, None, None), (201, "http://x.test/", ""), (202, "http://x.test/", rows[20][2]), (203, "http://x.test/", rows[20][2])]
    spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, n_templates int").write.parquet(f"{tmp_path}/pages.parquet")
    got = op5_template_removal(spark, str(tmp_path)).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == brute_texts(rows)
    assert sum(r["n_templates"] > 0 for r in got) > 60 and all(r["n_chars"] == len(r["text"]) for r in got)


# --- op7 ---------------------------------------------------------------------------------------------

def test_quality_learns_and_covers_edges(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = " ".join(rng.choice(words) for _ in range(60))
        good = i % 4 != 0
        rows.append((i, text if good else rng.choice([text.upper() + "!!", text.replace(" ", "### "), " ".join([words[i % 400]] * 60)]), "en", "s", 1))
        labels.append((i, int(good), 0))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "w" * 100_000, None, None, None), (3, "again", None, None, None)]
    labels += [(None, 1, 0), (7777, 0, 0), (5, None, 0)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.scores(docs, lab.where(crc_mod(F.col("doc_id"), 5) != 0)).withColumn("held", crc_mod(F.col("doc_id"), 5) == 0).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held"] and r["doc_id"] < 500 and r["text"] != "again"]
    assert sum((r["score"] >= quality.ACCEPT) == (r["doc_id"] % 4 != 0) for r in held) >= 0.9 * len(held)
    assert quality.scores(docs.limit(0), lab).count() == 0
    assert {r["score"] for r in quality.scores(docs, lab.limit(0)).collect()} == {0.5}


def test_long_runs_are_read_to_their_end(spark, monkeypatch):
    monkeypatch.setattr(quality, "RUN_BLOCK", 50)
    for word in ("ab" * 200, "漢字かな" * 60, "aé漢😀" * 30, "\ud800x" * 70):
        assert sorted(np.concatenate(list(quality.run_features(word))).tolist()) == sorted(quality.word_features(word))
    good, bad = ("x" * 40 + c * 200 for c in ("good", "evil"))
    a, b = (set(quality.document_features(t)[0].tolist()) for t in (good, bad))
    assert len(a ^ b) > 8
    rows = [(i, "x" * 40 + str(i) + (good, bad)[i % 2][40:], "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, labels).collect()}
    assert min(got[i] for i in range(30, 40, 2)) > max(got[i] for i in range(31, 40, 2)) + 0.1


# --- op10 --------------------------------------------------------------------------------------------

def brute(rows, threshold=0.8):
    def sh(t):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [sh(r[1]) for r in rows]
    links = {i: [j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))}
    comp, out = {}, []
    for i in range(len(rows)):
        if i not in comp:
            stack, members = [i], {i}
            while stack:
                for j in links[stack.pop()]:
                    if j not in members:
                        members.add(j)
                        stack.append(j)
            for j in members:
                comp[j] = min((rows[m][0] for m in members if rows[m][0] is not None), default=None), len(members)
        out.append((rows[i][0], *comp[i], len(links[i])))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1000, 7])
def test_join_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_DOCS", block)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 3, 30 if base == 4 else 4])):
            edit = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                edit[rng.randrange(len(edit))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "  ", "\n"]).join(edit), None, None, None))
    rows += [(None, rows[0][1], None, None, None), (7, rows[7][1], None, None, None), (900, None, None, None, None), (901, " \n", None, None, None), (902, "x" * 200_000, None, None, None), (903, "a " + "x" * 200_000, None, None, None)]
    got = shingle_join.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["class_size"], r["n_links"]) for r in got), key=str) == brute(rows)
    kept = [r["class_id"] for r in got if r["kept"]]
    assert len(kept) == len({r["class_id"] for r in got})


def test_join_of_nothing(spark):
    assert shingle_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_bound_is_the_posterior():
    least = shingle_join.least_matches(0.8, 1e-7)
    assert len(least) == 8 and all(a <= b for a, b in zip(least, least[1:])) and least[-1] > 128 * 0.5
    grid = np.linspace(0, 1, 200_001)
    n, m = 128, least[-1] - 1
    density = grid**m * (1 - grid) ** (n - m)
    assert density[grid >= 0.8].sum() / density.sum() < 1e-7


def test_hashes_do_not_depend_on_place():
    word = "längeres-Wort"
    alone = shingle_join.word_hashes(word)[0]
    assert all(h == alone for h in shingle_join.word_hashes(" ".join([word] * 9000)))


def test_features_travel_whole():
    for text in ("", "a b c", "word " * 40 + "other", "漢字" * 500):
        for got, want in zip(quality._unpacked(quality._packed(*quality.document_features(text))), quality.document_features(text)):
            assert (got == want).all() and len(got) == len(want)


def test_quality_query_equals_plain_scoring(spark, tmp_path):
    """The query's scores are those of a model trained here on the same sample in the same order, text by text."""
    from jobmarket.llm.registry import op7_subword_quality

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, text if i % 3 else text.upper() + "!!", "en", f"s{i % 2}", 1, 5.0, 7))
    rows += [(200, None, None, None, None, None, None), (201, "", None, None, 0, 1.0, 1), (202, "x" * 70_000, None, None, 1, 1.0, 1), (5, "a second row of one id", None, None, 1, 1.0, 1), (5, "a second row of one id", None, None, 1, 1.0, 1)]
    spark.createDataFrame(rows, DOCS + ", score double, _label int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 != 0), 0) for i in range(110)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op7_subword_quality(spark, str(tmp_path)).collect()
    held = lambda i: __import__("zlib").crc32(str(i).encode() if i is not None else b"") % 5 == 0
    known = {i: q for i, q, _ in labels if i is not None and q is not None and not held(i)}
    sample = spark.createDataFrame([(r[0], r[1]) for r in rows if r[0] in known], "doc_id long, text string")
    sample = [(r["text"], known[r["doc_id"]]) for r in sample.orderBy(F.xxhash64("doc_id", F.lit(4)), F.xxhash64("text")).collect()]
    weight, bias = quality.train([quality.document_features(t) for t, _ in sample], [q for _, q in sample])
    ones, n = sum(q for _, q in sample), len(sample)
    bias += np.log((sum(known.values()) + 1) / (len(known) - sum(known.values()) + 1)) - np.log((ones + 1) / (n - ones + 1))

    def plain(text):
        buckets, share = quality.document_features(text)
        return 1 / (1 + np.exp(-(float((share.astype(float) * weight[buckets]).sum()) + bias)))

    assert sorted((r["doc_id"], r["held_out"], round(r["score"], 4)) for r in got) == sorted((r[0], held(r[0]), round(plain(r[1]), 4)) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_join_leaves_other_columns_out(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20)), "x", 9, "y") for i in range(3)]
    out = shingle_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, class_id string, row int, bands string")).collect()
    assert [(r["class_id"], r["class_size"], r["n_links"]) for r in out] == [(0, 3, 2)] * 3
