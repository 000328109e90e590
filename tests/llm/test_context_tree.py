import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobmarket.llm import context_tree as ct

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def log_kt(a, b):
    out = 0.0
    for i in range(a):
        out += math.log((i + 0.5) / (i + 1))
    for i in range(b):
        out += math.log((i + 0.5) / (a + i + 1))
    return out


class Tree:
    """Plain recursive context-tree weighting over (context, byte) counts."""

    def __init__(self, counts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.known = {}
        for (context, byte), n in counts.items():
            for j in range(8):
                tree, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
                for d in range(ct.DEPTH + 1):
                    self.n[tree, context[:d]][bit] += n
                    if d:
                        self.children[tree, context[:d - 1]].add(context[:d])

    def weighted(self, tree, c):
        if (tree, c) not in self.known:
            self.known[tree, c] = self._weighted(tree, c)
        return self.known[tree, c]

    def _weighted(self, tree, c):
        own = log_kt(*self.n[tree, c])
        if len(c) == ct.DEPTH:
            return own, 1.0
        below = sum(self.weighted(tree, x)[0] for x in self.children[tree, c])
        total = math.log(0.5) + np.logaddexp(own, below)
        return total, math.exp(math.log(0.5) + own - total)

    def logp(self, context, byte):
        out = 0.0
        for j in range(8):
            tree, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
            p = None
            for d in range(ct.DEPTH, -1, -1):
                z = self.n[tree, context[:d]]
                kt = (z[bit] + 0.5) / (sum(z) + 1)
                if sum(z) or d == 0:
                    w = self.weighted(tree, context[:d])[1]
                    p = kt if p is None else w * kt + (1 - w) * p
            out += math.log10(p)
        return out


def stream(text):
    data = b"".join(w + b" " for w in ct._words(text)) + ct.END
    return [(tuple([*reversed(data[:i]), *[0] * ct.DEPTH][: ct.DEPTH]), data[i]) for i in range(len(data))]


def key(context, byte):
    """The nearest byte of context highest, the byte lowest."""
    return sum(c << (8 * (ct.DEPTH - i)) for i, c in enumerate(context)) | byte


ODD = ["", None, "A b", "é\tÉ  x", "\0\0a \0", "漢字 z" * 30, "w " * 50, "x" * 3000, "\n\n", "a\x1cb\x0bc"]


def test_blocks_give_every_key_and_word():
    texts = [t.encode() if t is not None else None for t in ODD]
    block = ct.Block(texts)
    assert block.keys().tolist() == [key(*s) for t in ODD for s in stream(t)]
    assert np.diff(block.starts).tolist() == [len(stream(t)) for t in ODD]
    h, other, starts, stops, at = block.words()
    words = [w for t in ODD for w in ct._words(t)]
    assert [block.data[s:e] for s, e in zip(starts, stops)] == words
    assert np.diff(at).tolist() == [len(ct._words(t)) for t in ODD]
    assert len(set(zip(h, other, words))) == len(set(h)) == len(set(words))
    parts = [b for _, b in ct._blocks(texts)]
    hashes, names, plain, found = ct._word_numbers(parts)
    assert sorted(found) == sorted(set(words)) and (np.diff(names) > 0).all() and (plain == names).all()


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    """With a first seed that puts words of one length together, the next seed is taken."""
    real = ct.Block.words

    def weak(self, seed=0):
        h, other, starts, stops, texts = real(self, seed)
        return (stops - starts if seed == 0 else h), other, starts, stops, texts

    monkeypatch.setattr(ct.Block, "words", weak)
    block = ct.Block([b"ab cd e fgh ab"])
    _, names, plain, words = ct._word_numbers([block])
    assert sorted(words) == [b"ab", b"cd", b"e", b"fgh"] and len(set(names)) == 4


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        x = np.unique(rng.integers(-2**62, 2**62, n))
        assert (ct._unpack(ct._pack(x, True), True) == x).all() and (ct._unpack(ct._pack(x)) == x).all()


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    seen = Counter()
    for _ in range(300):
        for s in stream(" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(3))):
            seen[key(*s)] += 1
    for context in list(seen)[:5]:
        rows = sorted((dict.fromkeys([context >> 8 << 8 | b for b in range(256)], 0) | seen).items())
        keys, n = (np.array(c, np.int64) for c in zip(*rows))
        out = ct.log10_probabilities(keys, n)
        assert (10 ** out[keys >> 8 == context >> 8]).sum() == pytest.approx(1.0, abs=1e-9)


@pytest.mark.parametrize("chunk_bytes", [60, 1 << 24])
def test_stream_scores_equal_plain_context_trees_across_words(spark, chunk_bytes):
    rng = random.Random(6)
    bits = ["Th", "en", "ab", "é", "ing", "X"]
    rows = [(i, rng.choice([" ", "\n", " \t"]).join("".join(rng.choice(bits) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(12))), None, None, None) for i in range(40)]
    rows += [(100, None, None, None, None), (101, "", None, None, None), (102, "z" * 3000, None, None, None), (3, "ab ab", None, None, None), (None, "ab", None, None, None)]
    got = ct.stream_scores(spark.createDataFrame(rows, DOCS), F.col("doc_id") % 5 != 1, chunk_bytes=chunk_bytes).collect()
    assert len(got) == len(rows)

    counts, pairs = Counter(), Counter()
    for doc_id, text, *_ in rows:
        if doc_id is not None and doc_id % 5 != 1:
            counts.update(ct._words(text) + [ct.END])
            pairs.update(stream(text))
    tree = Tree(pairs)
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for doc_id, text, *_ in rows:
        tokens = ct._words(text) + [ct.END]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens)
        want.append((str(doc_id), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6), round(sum(tree.logp(*s) for s in stream(text)), 6)))
    mine = [(str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    for a, b in zip(sorted(mine), sorted(want)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], abs=5e-5)


def test_query_tells_word_orders_apart(spark, tmp_path):
    from jobmarket.llm.registry import op8_context_tree_score

    text = "the old man sat on the mat and saw the sea"
    rows = [(i, text, None, None, None) for i in range(20)] + [(20, " ".join(sorted(text.split())), None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in op8_context_tree_score(spark, str(tmp_path)).collect()}
    assert got[0]["base_score"] == pytest.approx(got[20]["base_score"]) and got[0]["score"] > got[20]["score"] + 1


def test_stream_of_nothing(spark):
    df = spark.createDataFrame([(1, "ab", None, None, None)], DOCS)
    r = ct.stream_scores(df, F.lit(False)).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 0, 0) and r["score"] == pytest.approx(-4 * 8 * math.log10(2))
    assert ct.stream_scores(df.limit(0), F.lit(True)).count() == 0


def test_other_columns_are_left_out(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2, True), (2, "a b", "y", 3, False)], "doc_id long, text string, chunk string, bucket int, train boolean")
    out = ct.stream_scores(df, F.col("train")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["train"], r["n_tokens"], r["n_known"]) for r in out] == [(1, True, 3, 3), (2, False, 3, 3)] and out[0]["score"] == out[1]["score"]


@pytest.mark.parametrize("most", [4, 8])
def test_runs_merged_level_by_level_give_the_same_scores(spark, monkeypatch, most):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(30))), None, None, None) for i in range(120)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    keep = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    plain = {r[0]: tuple(r)[1:] for r in ct.stream_scores(df, F.col("doc_id") % 5 != 1).select(*keep).collect()}
    monkeypatch.setattr(ct, "MOST_BUCKETS", most)
    assert ct._levels(40)[1] > 1
    got = {r[0]: tuple(r)[1:] for r in ct.stream_scores(df, F.col("doc_id") % 5 != 1, chunk_bytes=200).select(*keep).collect()}
    assert got.keys() == plain.keys() and all(got[k][:3] == plain[k][:3] and got[k][3:] == pytest.approx(plain[k][3:], abs=5e-5) for k in got)


def test_runs_grow_with_the_chunks():
    for chunks in (1, 50, 2_000, 7_000_000):
        fan, levels = ct._levels(chunks)
        assert fan <= ct.MOST_BUCKETS and fan**levels >= 2 * chunks + 1 and levels <= 3
    assert ct._levels(50) == (101, 1)
