"""N-gram Jaccard self-join with Bayesian candidate pruning.

Texts are sets of five-word shingles (fewer words: one shingle of them all). Documents with equal sets are
collapsed first. MinHash bands propose candidates; for each candidate pair the MinHash values are
compared some at a time, and the pair is dropped as soon as the posterior probability that its Jaccard
similarity reaches the threshold (uniform prior, binomial matches) falls below `tolerance`. The rest
are verified exactly on the shingle sets.

Candidate pairs are never emitted as rows. Documents that share a band bucket are linked to the
bucket's first member only; the connected components of those links hold every candidate pair, and
one task compares a component, or one pair of blocks of a large component, and returns a row for
each document: its number of links and the first document it is connected to. Copies count as links
without being compared.

With 32 bands of 4 values a pair at the threshold 0.8 is missed with probability 5e-8, and pruning at
1e-7 adds about as much.

Null and empty texts have no shingles: they link to nothing. A class is named by its smallest doc_id
(null if all its ids are null). Repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import components, sized, written

N_WORDS, N_HASHES, BAND = 5, 128, 4
STEP = 16  # MinHash values compared at a time
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_R = 0x9E3779B97F4A7C15 | 1
_STRIDE = 1 << 16
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, for one stride of bytes."""
    up, down = np.empty(_STRIDE + 1, np.uint64), np.empty(_STRIDE + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:], down[1:] = np.uint64(_R), np.uint64(pow(_R, -1, 2**64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each white-space-separated word."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_SPACE[b].astype(np.int8), prepend=1, append=1))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers()
    sums = np.zeros(len(b) + 1, np.uint64)
    at = np.arange(len(b)) % _STRIDE
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[at], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts % _STRIDE]
    for w in np.flatnonzero(starts // _STRIDE != (ends - 1) // _STRIDE):  # a word across two strides
        part = b[starts[w]:ends[w]].astype(np.uint64) + np.uint64(1)
        h[w] = (part * up[np.arange(len(part)) % _STRIDE]).sum(dtype=np.uint64)
    return _mix(h ^ (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n = min(N_WORDS, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = out * np.uint64(_R) + h[i:len(h) - n + 1 + i]
    return np.unique(_mix(out))


def minhash(sh: np.ndarray) -> np.ndarray:
    a, c = _seeds()
    low = np.full(N_HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(sh), 512):
        np.minimum(low, (sh[at:at + 512, None] * a + c).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band of MinHash values, and of its number; the last axis of sig holds the values."""
    part = sig.reshape(*sig.shape[:-1], -1, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(part.shape[-2], dtype=np.uint64), part.shape[:-1])
    for k in range(BAND):
        h = _mix(h * np.uint64(_R) + part[..., k])
    return h.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each count of compared values, the fewest matches that keep a pair.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m+1, n-m+1), and
    P(similarity >= t) is the probability of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def surviving_pairs(left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of signature rows that share a band and outlive every pruning step (right None: pairs within left)."""
    other = left if right is None else right
    lb, ob = band_keys(left), band_keys(other)
    ii, jj = [], []
    for i in range(len(left)):
        first = i + 1 if right is None else 0
        hit = np.flatnonzero((ob[first:] == lb[i]).any(axis=1)) + first
        ii.append(np.full(len(hit), i))
        jj.append(hit)
    i, j = np.concatenate(ii or [np.empty(0, int)]), np.concatenate(jj or [np.empty(0, int)])
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        for at in range(0, len(i), 200_000):
            s = slice(at, at + 200_000)
            matches[s] += (left[i[s], part] == other[j[s], part]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def verify(a: list[np.ndarray], b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (a[i], b[j]) reach the threshold, exactly."""
    if not len(i):
        return np.empty(0, bool)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    same = a is b
    values, where, df = np.unique(np.concatenate(a if same else a + b), return_inverse=True, return_counts=True)
    shared = df > 1  # a shingle of one document is in no intersection
    columns = int(shared.sum())
    number = np.cumsum(shared) - 1
    docs = np.repeat(np.arange(len(na)) if same else np.arange(len(na) + len(nb)), na if same else np.concatenate([na, nb]))
    keep = shared[where]
    docs, cols = docs[keep], number[where][keep]
    if len(i) * float(na.mean() + nb.mean()) * 4 < len(na) * len(nb) * columns / 40:
        both = np.array([len(np.intersect1d(a[x], b[y], assume_unique=True)) for x, y in zip(i, j)])
    else:
        total = np.zeros((len(na), len(nb)), np.float32)
        for at in range(0, columns, 8192):
            block = (cols >= at) & (cols < at + 8192)
            m = np.zeros((len(na) if same else len(na) + len(nb), min(8192, columns - at)), np.float32)
            m[docs[block], cols[block] - at] = 1
            total += m @ m.T if same else m[: len(na)] @ m[len(na):].T
        both = total[i, j]
    return both >= threshold * (na[i] + nb[j] - both) - 1e-9


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest connected index of each of n nodes."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-7, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, class_id, class_size, n_links, kept (one document of each class).

    row: a column that names each row of docs, the same on every read; without it docs are numbered and written.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text at a time becomes a Python string: long texts of a batch are not held twice."""
        for batch in batches:
            keys, n, bands = [], [], []
            for text in batch.column("text"):
                sh = shingles(text.as_py())
                n.append(len(sh))
                keys.append(hashlib.blake2b(sh.tobytes(), digest_size=16).digest() if len(sh) else None)
                bands.append(band_keys(minhash(sh)) if len(sh) else [])
            own = {c: batch.column(c) for c in ("doc_id", "row")}
            yield pa.RecordBatch.from_pydict({**own, "set_key": pa.array(keys, pa.binary()), "n": pa.array(n, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(row) if row else F.monotonically_increasing_id()).alias("row"))
    numbered = numbered if row else written(numbered, "numbered")
    signed = numbered.mapInArrow(sign, "doc_id long, row long, set_key binary, n long, bands array<long>")
    signed = written(signed, "shingles")
    sets = written(signed.where("set_key is not null").groupBy("set_key").agg(F.min("row").alias("rep"), F.count("*").alias("copies")), "sets")
    reps = signed.join(sets.select(F.col("rep").alias("row"), "copies"), "row")
    banded = written(reps.select("row", F.explode("bands").alias("key")), "bands")
    shared = written(banded.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "buckets")
    near = written(components(banded.join(sized(shared), "key").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))), "candidates")
    links, edges = _compare(numbered, reps, near, threshold, tolerance)
    classes = components(edges).select(F.col("node").alias("rep"), F.col("component").alias("root"))
    members = signed.select("doc_id", "row", "set_key").join(sets, "set_key", "left").withColumn("rep", F.coalesce("rep", "row"))
    full = members.join(links, "rep", "left").join(classes, "rep", "left").select(
        "doc_id", "row", F.coalesce("root", "rep").alias("root"), (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links")
    )
    full = written(full, "classes")
    names = full.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    first = full.join(names, "root").where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("keep_row"))
    out = full.join(written(names.join(first, "root"), "names"), "root")
    return out.select("doc_id", "row", "class_id", "class_size", "n_links", (F.col("row") == F.col("keep_row")).alias("kept"))


def _compare(numbered: DataFrame, reps: DataFrame, near: DataFrame, threshold: float, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """Per representative its linked documents; and edges that span the classes."""
    members = written(near.select(F.col("node").alias("row"), "component").join(reps.select("row", "n", "copies"), "row"), "members")
    texts = written(numbered.select("row", "text").join(sized(members), "row"), "compare")  # one text of each set that has a candidate
    size = texts.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = texts.join(size, "component").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row").reset_index(drop=True)
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        sets_ = [shingles(t) for t in pdf["text"]]
        sigs = np.stack([minhash(s) for s in sets_])
        copies, rows = pdf["copies"].to_numpy(), pdf["row"].to_numpy()
        if lo == hi:
            i, j = surviving_pairs(sigs, None, threshold, tolerance)
            good = verify(sets_, sets_, i, j, threshold)
            i, j = i[good], j[good]
        else:
            a, b = np.flatnonzero(pdf["block"] == lo), np.flatnonzero(pdf["block"] == hi)
            if not len(a) or not len(b):
                return pd.DataFrame({"rep": [], "linked": [], "root": []})
            i, j = surviving_pairs(sigs[a], sigs[b], threshold, tolerance)
            good = verify([sets_[x] for x in a], [sets_[x] for x in b], i, j, threshold)
            i, j = a[i[good]], b[j[good]]
        linked = np.bincount(i, weights=copies[j], minlength=len(pdf)) + np.bincount(j, weights=copies[i], minlength=len(pdf))
        out = pd.DataFrame({"rep": rows, "linked": linked.astype("int64"), "root": rows[_roots(len(pdf), i, j)]})
        return out[out["linked"] > 0]

    # Comparing costs far more than moving: no few tasks get many small groups.
    dealt = dealt.repartition(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "lo", "hi")
    found = written(dealt.groupBy("component", "lo", "hi").applyInPandas(compare, "rep long, linked long, root long"), "links")
    return found.groupBy("rep").agg(F.sum("linked").alias("linked")), found.select(F.col("rep").alias("a"), F.col("root").alias("b"))
