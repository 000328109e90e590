"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments, each with its own bucket table. A query grows the search radius of one
segment after the other: with radius r in the first j of m segments and r - 1 in the rest, every code within
distance m r + j - 1 of the query has been met. The search stops when the k-th verified distance is
covered by that bound, so the answer is exact, ties included (the smaller id wins).

Distinct codes are dealt into blocks by a hash. A code keeps its k smallest ids: no other id of it can be among any k
nearest, since those k are as near and come first. So a code that a third of all rows bear is one row of k ids. A block's codes come
first in its sorted run, then queries one after the other: every query
searches each block once, a batch of queries in memory at a time. While there are fewer blocks than tasks, each block is copied for several parts of the queries. A block returns k ids for each query at most, and the best k are kept.

Rows with a null or empty vector or a null id have no code: they are neither found nor searched for. Rows
that repeat an id are found once, at the smallest distance, and take one of the k places: a search counts distinct ids. Fewer than k
rows give fewer neighbours; empty tables none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from jobmarket.llm.common import written

BITS = 64
BLOCK = 65_536  # (code, id) rows of an index
QUERIES = 256  # of a task at least, where a block's queries are spread
SALT = 64  # parts of a code's ids before its k smallest are taken


def sign_code(vector: str = "embedding") -> Column:
    """Bit i of the code is set where component i is positive. A vector that has not BITS components fails the job."""
    bits = F.transform(F.col(vector), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    wrong = F.raise_error(F.concat(F.lit(f"a vector must have {BITS} components, not "), F.size(vector).cast("string"))).cast("long")
    return F.when(F.size(vector) == BITS, code).when(F.size(vector) > 0, wrong)


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)


class Index:
    """Bucket tables of each segment: rows sorted by segment value, and where each value starts."""

    def __init__(self, codes: np.ndarray, segments: int, ids: np.ndarray | None = None):
        edges = np.linspace(0, BITS, segments + 1).astype(int)
        self.codes, self.width = codes, np.diff(edges)
        #: number of each row's id, where some id has several rows
        self.owner = None
        self.ids = len(codes)
        if ids is not None:
            uniq, owner = np.unique(ids, return_inverse=True)
            if len(uniq) < len(ids):
                self.owner, self.ids = owner, len(uniq)
        self.shift = edges[:-1]
        self.rows, self.starts = [], []
        for s, w in zip(self.shift, self.width):
            part = self.part(codes, s, w)
            self.rows.append(np.argsort(part, kind="stable"))
            self.starts.append(np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << w))]))

    @staticmethod
    def part(codes: np.ndarray, shift: int, width: int) -> np.ndarray:
        return ((codes >> np.uint64(shift)) & np.uint64((1 << int(width)) - 1)).astype(np.int64)

    def search(self, query: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of every code as near as that of the k-th nearest id."""
        n, m, k = len(self.codes), len(self.width), min(k, self.ids)
        seen = np.zeros(n, dtype=bool)
        rows, dist = np.empty(0, np.int64), np.empty(0, np.int64)
        for radius in range(int(self.width.max()) + 1):
            for j in range(m):
                if radius <= self.width[j]:
                    probes = self.part(np.array([query]), self.shift[j], self.width[j])[0] ^ _masks(int(self.width[j]), radius)
                    start, stop = self.starts[j][probes], self.starts[j][probes + 1]
                    size = stop - start
                    at = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                    found = self.rows[j][at]
                    found = found[~seen[found]]
                    seen[found] = True
                    rows = np.concatenate([rows, found])
                    dist = np.concatenate([dist, np.bitwise_count(self.codes[found] ^ query).astype(np.int64)])
                best = dist if self.owner is None else self._by_id(rows, dist)
                if len(best) >= k:
                    kth = np.partition(best, k - 1)[k - 1]
                    if kth <= m * radius + j:
                        near = dist <= kth
                        return rows[near], dist[near]
        return rows, dist

    def _by_id(self, rows: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """The least distance of each id among rows."""
        order = np.argsort(dist, kind="stable")
        return dist[order][np.unique(self.owner[rows[order]], return_index=True)[1]]


def _smallest_ids(rows: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of each code, in two steps, so no task sorts all ids of a common code."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)))
    for keys in (["code", "salt"], ["code"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).where(F.col("n") <= k)
    return rows.select("id", "code")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segments: int = 5) -> DataFrame:
    """rows and queries: id, code. Returns query_id, neighbour_id, distance, place (1 to k)."""
    rows = written(_smallest_ids(rows.where("id is not null and code is not null").select("id", "code").dropDuplicates(), k), "codes")
    queries = queries.where("id is not null and code is not null").select("id", "code").dropDuplicates()
    blocks = max(1, -(-rows.count() // BLOCK))
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(-(-queries.count() // QUERIES), -(-wide // blocks)))  # few blocks are copied, so that their queries are spread
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda block, part: (block * parts + part).cast("int").alias("tile")
    dealt = rows.select("id", "code", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"), each(parts).alias("part")).select("id", "code", tile(F.col("block"), F.col("part")), F.lit(0).alias("asks"))
    asked = queries.select("id", "code", each(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).select("id", "code", tile(F.col("block"), F.col("part")), F.lit(1).alias("asks"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, ids, index = None, [], np.empty(0, np.int64), None
        for pdf in batches:
            out = [pd.DataFrame({"query_id": pd.Series(dtype="int64"), "neighbour_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="int64")})]
            for b, part in pdf.groupby("tile", sort=True):
                if b != block:
                    block, held, index = b, [], None
                held.append(part[part["asks"] == 0])
                wanted = part[part["asks"] == 1]
                if len(wanted) and index is None:  # the block's codes have all come
                    codes = pd.concat(held).sort_values("id")
                    held, ids = [], codes["id"].to_numpy()
                    index = Index(codes["code"].to_numpy(np.int64).view(np.uint64), segments, ids)
                if len(ids):
                    for q, code in zip(wanted["id"], wanted["code"].to_numpy(np.int64).view(np.uint64)):
                        found, dist = index.search(code, k)
                        order = np.lexsort((ids[found], dist))
                        out.append(pd.DataFrame({"query_id": q, "neighbour_id": ids[found][order], "distance": dist[order]}).drop_duplicates("neighbour_id").head(k))
            yield pd.concat(out, ignore_index=True)

    run = dealt.unionByName(asked).repartitionById(blocks * parts, F.col("tile")).sortWithinPartitions("tile", "asks", "id")
    found = run.mapInPandas(search, "query_id long, neighbour_id long, distance long")
    found = found.groupBy("query_id", "neighbour_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
