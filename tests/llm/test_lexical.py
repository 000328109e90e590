import math
import random
import re
from collections import Counter

import numpy as np

from jobmarket.llm import lexical
from jobmarket.llm.registry import op13_block_max_maxscore

DOCS, ITEMS = "doc_id long, text string, score long, item long", "item_id long, text string, rank int"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def plain_terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    """Every document scored for every item."""
    docs = [(d, Counter(plain_terms(t)), len(plain_terms(t))) for d, t in docs]
    docs = [d for d in docs if d[2]]
    n_docs, n_terms = len(docs), sum(d[2] for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for doc, tf, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, r in Counter(plain_terms(text)).items() if t in tf)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, place + 1, s[3], -s[0]) for place, s in enumerate(sorted(scored)[:k])]
    return out


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    words = [f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(4000)] + ["Éa", "x_y", "a-b", "日本", "\x7f", "A1"]
    docs = [(d, " ".join(rng.choice(words) for _ in range(rng.choice([1, 20, 60, 300])))) for d in range(700)]
    docs += [(701, None), (702, ""), (703, "... !"), (None, docs[3][1]), (3, docs[3][1]), (3, docs[3][1]), (2**60 + 1, docs[3][1]), (704, "w1 " * 400_000)] + [(800 + i, docs[5][1]) for i in range(60)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(12)] + [(50, docs[5][1]), (51, docs[3][1]), (51, docs[3][1]), (52, None), (53, "?"), (54, "unknownterm"), (None, "w1 W1 w2")]
    spark.createDataFrame([(*d, 1, 1) for d in docs], DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*i, 1) for i in items], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(lexical, "ITEM_BYTES", 700)  # several blocks of items
    got = [tuple(r) for r in op13_block_max_maxscore(spark, str(tmp_path)).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items), key=str)
    empty = spark.createDataFrame([], DOCS)
    assert lexical.search(empty, spark.createDataFrame([(*i, 1) for i in items], ITEMS)).collect() == []
    assert lexical.search(spark.createDataFrame([(*d, 1, 1) for d in docs[:5]], DOCS), spark.createDataFrame([], ITEMS)).collect() == []


class _Row:
    def __init__(self, **values):
        self.__dict__.update(values)


def _lists(texts, n_docs, n_terms):
    """Postings of one shard."""
    m = np.array([75 + 25 * len(t) * n_docs // n_terms for t in texts], np.int64)
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    keys = np.array([number[w] * len(texts) + d for d, t in enumerate(texts) for w in t], np.int64)
    columns = dict(zip(("df", "best", "firsts", "lasts", "maxima", "places", "packed"), (c.to_pylist() for c in lexical.postings(keys, len(texts), m))))
    return {w: lexical.Postings(_Row(**{c: v[i] for c, v in columns.items()})) for w, i in number.items()}, m


def test_packed_values_come_back():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 1 << int(b), 50) for b in rng.integers(1, 60, 40)] + [np.array([0, 127, 128, 16383, 16384, 2**61])])
    data, ends = lexical._packed(values)
    assert (lexical._unpacked(data) == values).all() and ends[-1] == len(data)
    assert (lexical._unpacked(data[ends[10]:ends[20]]) == values[10:20]).all()


def test_block_maxima_reject_candidates_before_unpacking():
    rng = random.Random(10)
    texts = [["common"] * rng.choice([1, 1, 1, 2]) + [f"x{rng.randrange(50)}" for _ in range(20)] + (["rare"] * 3 if d < 25 else []) for d in range(20_000)]
    lists, norms = _lists(texts, len(texts), sum(map(len, texts)))
    stats = {}
    weights = {t: lexical.weight(len(texts), p.df) for t, p in lists.items()}
    asked = [(0, {"common": 1, "rare": 2, "x1": 1})]
    got = lexical.search_shard(lists, list(range(len(texts))), norms, asked, weights, 20, stats)
    assert {d for _, d, _ in got} <= set(range(25)) and len(got) == 20
    needed = sum(len(lists[t].lasts) for t in asked[0][1])
    assert sum(len(lists[t].open) for t in asked[0][1]) < needed / 5 and stats["unpacked"] < stats["blocks"]
