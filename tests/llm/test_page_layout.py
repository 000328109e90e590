import random
import time
from html import escape
from html.parser import HTMLParser

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobmarket.llm import hamming, html_text, packing
from jobmarket.llm.registry import op5_template_removal, op6_extendible_hash_dedup, op10_bayes_shingle_join

NONE = frozenset()
STORY = "<h1>Title</h1><p>One long enough body of the story.</p><p>Two</p>"
WANT = "Title\nOne long enough body of the story.\nTwo"


@pytest.mark.parametrize("page", [
    f'<div class="layout with-sidebar"><article>{STORY}</article><div class="sidebar">x</div></div>',
    f'<form id="aspnetForm"><div><article>{STORY}</article></div><input></form>',
    f'<body class="has-header nav-open"><div id="header-wrapper">menu</div><article>{STORY}</article></body>',
    '<article><header><h1>Title</h1></header><p>One long enough body of the story.</p><p>Two</p><div class="share">Share</div></article>',
    '<article><div class="entry-header"><h1>Title</h1></div><section id="related-work"><p>One long enough body of the story.</p></section><p>Two</p></article>',
    f'<div class="modal-root"><main>{STORY}</main></div><footer>f</footer>',
    f'<div class="page-header-fixed"><div class="widget-area">w</div><div class="content">{STORY}</div></div>',
    f'<article>{STORY}</article><div class="related"><article><p>teaser</p></article></div><section class="comments"><article class="comment">no</article></section>',
    f'<article>{STORY}<div class="comments"><p>{"a reader said " * 40}</p></div></article><aside><article>{"side " * 90}</article></aside>',
])
def test_wrappers_do_not_take_the_article_along(page):
    assert html_text.Page(f"<html>{page}</html>").text(NONE) == WANT


@pytest.mark.parametrize("piece", ["<p>it's <b title=don't>x</b>", '<b title="open>x', "<p title='a>b", "<a href=", "</x>", "<!-", "<p>a</q><div>"])
def test_long_pages_take_linear_time(piece):
    source = piece * (1_000_000 // len(piece))
    began = time.process_time()
    page = html_text.Page(source)
    page.text(NONE)
    page.hashes()
    assert time.process_time() - began < 25  # 1 MB; the quadratic scan took 28 s for 190 KB


def test_odd_quotes():
    page = html_text.Page("<p title=don't>it's</p><p data-x=\"a>b\" y='>'>two</p><p z=\"never ends>three</p>")
    assert page.text(NONE) == "it's\ntwo\nthree" and page.attributes[1] == {"title": "don't"}


class Plain(HTMLParser):
    """An independent reading of well-formed pages: blocks of the article, scripts and adverts aside."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.run, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "a"):
            self.flush()
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("b", "a"):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        if "article" in [t for t, _ in self.open] and not any(t in ("script", "aside", "nav") or c == "ad" for t, c in self.open):
            self.run.append(data)

    def flush(self):
        text = " ".join("".join(self.run).split())
        self.blocks += [text] if text else []
        self.run = []


def test_text_equals_an_independent_parser():
    rng = random.Random(12)
    for _ in range(200):
        def inline(depth=0):
            text = escape(" ".join(rng.choice(["word", "a<b", "R&D", "it's", 'say "x"', "ü\n", "\t"]) for _ in range(rng.randrange(5))))
            return text if depth > 2 else text + rng.choice(["", f"<b>{inline(depth + 1)}</b>", f"<a href='/x?a=1&amp;b=2'>{inline(depth + 1)}</a> "])

        blocks = "".join(rng.choice([f"<p>{inline()}</p>", f"<div>{inline()}<p>{inline()}</p></div>", f"<ul><li>{inline()}</li><li>{inline()}</li></ul>", f'<div class="ad">{inline()}</div>', "<script>var a='<p>';</script>", f"<aside>{inline()}</aside>"]) for _ in range(8))
        page = f"<html><body><nav>menu</nav><div class='wrap sidebar-left'><article><h1>{inline()}</h1>{'<p>' + 'body ' * 200 + '</p>'}{blocks}</article></div><footer>f</footer></body></html>"
        plain = Plain()
        plain.feed(page)
        plain.flush()
        assert html_text.Page(page).text(NONE) == "\n".join(plain.blocks)


def test_clashing_columns(spark, tmp_path):
    names = ["_site", "_host", "_template", "_salt", "_part", "_out", "text", "host"]
    rows = [(i, "http://a.test/x", f"<article><p>text {i}</p></article>", *["x"] * len(names)) for i in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r["text"] for r in op5_template_removal(spark, str(tmp_path)).collect()) == [f"text {i}" for i in range(6)]
    names = ["_row", "_file", "_place", "row", "key", "bucket"]
    rows = [(i, "same text of some words here", *["x"] * len(names)) for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["group_size"] for r in op6_extendible_hash_dedup(spark, str(tmp_path)).collect()] == [4] * 4
    assert [r["class_size"] for r in op10_bayes_shingle_join(spark, str(tmp_path)).collect()] == [4] * 4


def test_many_end_marks(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["<|endoftext|>" * 5000, "a <|endoftext|> b" * 2000, "<|endoftext|>", "x<|endoftext|>"]
    tokenizer = Tokenizer.from_file(path)
    encoder = packing.UnitEncoder(path)
    for t in texts:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert [int.from_bytes(encoder.encode(t)[i:i + 4], "little") for i in range(0, 4 * len(want), 4)] == want
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["n"] for r in packing.pieces(docs, path).groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}[0] == 5001


def test_a_blocks_queries_are_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "QUERIES", 20)
    rng = random.Random(2)
    rows = [(i, rng.getrandbits(63)) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, code long")
    out = hamming.top_k(df, df.where("id % 10 = 0"), 5)
    got = {}
    for r in out.orderBy("place").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbour_id"]))
    want = {q: sorted(((code ^ c).bit_count(), i) for i, c in rows)[:5] for q, code in rows[::10]}
    assert got == want
    assert "exchange" in out._jdf.queryExecution().executedPlan().toString().lower() and "tile" in out._jdf.queryExecution().optimizedPlan().toString()
