"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its features: every word, its character
n-grams (with word bounds), and a mark for each word that repeats the one before it (the word bigram of a
word with itself), all hashed into one table. A softmax layer gives the label. Vectors and output layer are
trained by stochastic gradient descent in numpy on a bounded sample of labelled rows; scoring reads every
whole text. The average is linear, so a feature enters the score by its vector's product with the difference of
the two output vectors: tasks get one table of those products, of fixed size. One task trains on the features of the sample, at most BUCKETS
pairs of numbers for a text however long; the driver gets the table.

Null and empty texts have no features and score the training prior. Repeated rows score alike; a label row
without a document is unused; an empty table gives no rows. `scores` replaces a column called score; `fit` adds no column.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
DIMENSIONS = 12
NGRAMS = (3, 4)
SAMPLE = 3000  # labelled rows of each label that training reads at most
EPOCHS, RATE = 8, 0.4
ACCEPT = 0.3  # score from which a document is taken
REPEAT = 0  # bucket of the mark for a repeated word
CACHE_LIMIT = 250_000  # words of a task's cache; it is emptied when full
LONG = 64  # characters of the longest word that is cached and read n-gram by n-gram
RUN_BLOCK = 1 << 16  # n-grams of a longer run that are hashed together


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


CRC = _crc_table()


def word_features(word: str) -> list[int]:
    """Buckets of a word and its character n-grams."""
    bounded = f"<{word}>"
    out = [zlib.crc32(bounded.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) + 1]
    data = bounded.encode("utf-8", "surrogatepass") if bounded.isascii() else None
    for n in NGRAMS:
        for i in range(len(bounded) - n + 1):
            gram = data[i:i + n] if data else bounded[i:i + n].encode("utf-8", "surrogatepass")
            out.append(zlib.crc32(gram, 7) % (BUCKETS - 1) + 1)
    return out


def run_features(word: str) -> Iterator[np.ndarray]:
    """The same buckets as word_features, in blocks: for runs without white space of any length."""
    whole = f"<{word}>".encode("utf-8", "surrogatepass")
    yield np.array([zlib.crc32(whole) % (BUCKETS - 1) + 1], np.int64)
    data = np.frombuffer(whole, np.uint8)
    edges = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters start
    for n in NGRAMS:
        for at in range(0, len(edges) - n, RUN_BLOCK):
            stop = edges[at + n:at + n + RUN_BLOCK]
            start = edges[at:at + len(stop)]
            crc = np.full(len(start), 7 ^ 0xFFFFFFFF, np.uint32)
            for j in range(int((stop - start).max())):
                more = start + j < stop
                byte = data[np.where(more, start + j, 0)]
                crc = np.where(more, CRC[(crc ^ byte) & 255] ^ (crc >> 8), crc)
            yield (crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64) % (BUCKETS - 1) + 1


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their share of all its features."""
    words = (text or "").split()
    ids = [f for w in words if len(w) <= LONG for f in word_features(w)]
    ids += [REPEAT] * sum(map(eq, words, words[1:]))
    buckets, n = np.unique(np.array(ids, dtype=np.int64), return_counts=True)
    runs = [w for w in words if len(w) > LONG]
    if runs:
        total = np.zeros(BUCKETS, np.int64)
        total[buckets] = n
        for w in runs:
            for f in run_features(w):
                total += np.bincount(f, minlength=BUCKETS)
        buckets = np.flatnonzero(total)
        n = total[buckets]
    return buckets, (n / max(1, n.sum())).astype(np.float32)


def _packed(buckets: np.ndarray, share: np.ndarray) -> bytes:
    """Buckets as steps and shares, compressed: about a third of their size on the way to the driver."""
    return zlib.compress(np.diff(buckets, prepend=0).astype("<i4").tobytes() + share.astype("<f4").tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    half = len(raw) // 2
    return np.cumsum(np.frombuffer(raw[:half], "<i4"), dtype=np.int32), np.frombuffer(raw[half:], "<f4")


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 5) -> tuple[np.ndarray, float]:
    """examples: document_features of each. Product of each bucket's vector with the output difference, and the bias."""
    rng = np.random.default_rng(seed)
    table = ((rng.random((BUCKETS, DIMENSIONS), dtype=np.float32) - 0.5) / DIMENSIONS).astype(np.float32)
    output = np.zeros((2, DIMENSIONS), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    steps, at = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            buckets, share = examples[k]
            rate = RATE * (1 - at / steps)
            at += 1
            hidden = share @ table[buckets] if len(buckets) else np.zeros(DIMENSIONS, np.float32)
            z = output @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = output.T @ p
            output -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            if len(buckets):
                # shares are small: the rate of a bucket grows with how much of the text it is
                table[buckets] -= (rate * np.minimum(1.0, share * len(buckets) / 4)[:, None]) * back
    return table @ (output[1] - output[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Callable[[str], Column]:
    """A trained classifier: a function from a text column to the score (0 to 1, higher: label 1 likelier).

    labels may hold any part of the ids. The sample is `sample` labels of each value at most, chosen by a hash of the id, and all
    documents that bear those ids up to 4 * sample (rows that repeat an id could be any number); the two label counts
    are taken over all labelled rows and set the prior.
    """
    marked = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("_label"))
    picked = None
    for value in (0, 1):
        part = marked.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(features=[_packed(*document_features(t)) for t in pdf["text"]]).drop(columns="text")

    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # 2 * sample labels at most
    chosen = chosen.select(F.xxhash64("doc_id", F.lit(4)).alias("place"), F.xxhash64("text").alias("hash"), "_label", "text")
    chosen = chosen.mapInPandas(features, "place long, hash long, _label int, features binary").orderBy("place", "hash", "_label").limit(4 * sample)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, share, sizes, marks = bytearray(), bytearray(), [], []  # two long runs of numbers, not many short ones
        for pdf in batches:
            for packed in pdf["features"]:
                one, two = _unpacked(packed)
                buckets += one.tobytes()
                share += two.tobytes()
                sizes.append(len(one))
            marks += pdf["_label"].tolist()
        if marks:
            ends = np.cumsum(sizes)[:-1]
            weight, bias = train(list(zip(np.split(np.frombuffer(buckets, np.int32), ends), np.split(np.frombuffer(share, np.float32), ends))), marks)
            yield pd.DataFrame({"weight": [weight.astype("<f4").tobytes()], "bias": [bias], "ones": [sum(marks)], "n": [len(marks)]})

    found = chosen.select("features", "_label").mapInPandas(learn, "weight binary, bias double, ones long, n long").collect()
    counts = {r["_label"]: r["count"] for r in marked.groupBy("_label").count().collect()}
    prior = np.log((counts.get(1, 0) + 1.0) / (counts.get(0, 0) + 1.0))
    if found:
        r = found[0]
        weight, bias = np.frombuffer(r["weight"], "<f4"), r["bias"] + prior - np.log((r["ones"] + 1.0) / (r["n"] - r["ones"] + 1.0))
    else:
        weight, bias = np.zeros(BUCKETS, np.float32), prior
    shared = docs.sparkSession.sparkContext.broadcast(weight)  # BUCKETS numbers, however large the corpus

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        known: dict[str, complex] = {}  # of a word: the sum of its products, and how many features it has
        mark = complex(w[REPEAT], 1)

        def add(word: str) -> complex:
            if len(word) > LONG:  # met once, as a rule
                return sum((complex(float(w[f].sum(dtype=np.float64)), len(f)) for f in run_features(word)), 0j)
            f = word_features(word)
            known[word] = c = complex(float(w[f].sum()), len(f))
            return c

        for texts in batches:
            out = []
            for text in texts:
                words = (text or "").split()
                found = list(map(known.get, words))
                if None in found:
                    if len(known) > CACHE_LIMIT:
                        known.clear()
                    found = [f if f is not None else known.get(x) or add(x) for f, x in zip(found, words)]
                total = sum(found, mark * sum(map(eq, words, words[1:])))
                out.append(1 / (1 + np.exp(-(total.real / max(1.0, total.imag) + bias))))
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(score, "double")


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """docs with the score of each text."""
    return docs.withColumn("score", fit(docs, labels, label, sample)("text"))
