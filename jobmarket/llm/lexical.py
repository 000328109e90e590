"""Ranked lexical search by Block-Max MaxScore over shards.

Terms are runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased. Each document's score for an item is a sum over the item's terms, in whole numbers, so every order of adding gives the same.

Index: documents are cut into shards of a bounded size; each task builds its shards' posting lists of all terms, in blocks of 128 documents: gaps and counts in
groups of seven bits, as few as they need, and beside them each block's last document and its greatest possible share of a score. A list has its greatest share as
well. The index is written once to the shared folder, holds every term, and serves any number of items.

Search: items go in blocks of bounded size, shards one by one. In a shard an item's lists are ordered by their bounds; the lists whose bounds together cannot reach
the twentieth score so far are non-essential. Candidates come from the essential lists only, a window of documents at a time. For each candidate the
non-essential lists are tried from the strongest on: first the sum of the bounds left rejects it, then the maximum of the one block where it could stand, and only
blocks with a candidate left are unpacked. Each shard returns its heap of twenty rows an item; the heaps are merged by item.

Null texts have no term. Repeated rows of documents are documents of their own; equal scores by ascending doc_id, nulls last. Items that repeat id and text count once; a repeated id with another text is an
item of its own. Items without a term, and tables without documents, give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobmarket.llm.common import prefix_sums, sized, written

SCALE, K1, B = 1_000_000_000, 1000, 12  # of the share of a term
SHARD_BYTES = 32_000_000  # of terms, one document more at most
PART = 1 << 20  # bytes of a text that are split at a time
BLOCK, WINDOW = 128, 1024  # documents of a posting block; of a search window
ITEM_BYTES = 2_000_000  # of an item block's texts, one item more at most
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, a part at a time; a UTF-8 byte beyond 127 is always part of one."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + PART)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds for each unit of its weight."""
    return SCALE * tf // (K1 * tf + B * m)


def _packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values in groups of seven bits, the last byte of each below 128; and where each begins, with the end of all."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(ends[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > k)
        out[ends[on] + k] = (values[on] >> (7 * k) & 127) | np.where(size[on] > k + 1, 128, 0)
    return out, ends


def _unpacked(data: np.ndarray) -> np.ndarray:
    """The values of _packed."""
    stop = data < 128
    number = np.cumsum(stop) - stop
    first = np.flatnonzero(np.concatenate([[True], stop[:-1]]))
    place = np.arange(len(data)) - first[number]
    out = np.zeros(len(first), np.int64)
    for k in range(int(place.max(initial=-1)) + 1):
        on = place == k
        out[number[on]] |= (data[on].astype(np.int64) & 127) << (7 * k)
    return out


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of one buffer as an array of byte strings."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


INDEX = "shard long, term binary, df long, best long, firsts binary, lasts binary, maxima binary, places binary, packed binary, ids binary, no_id binary, norms binary"


def postings(keys: np.ndarray, n_ids: int, m: np.ndarray) -> list[pa.Array]:
    """The columns df, best, firsts, lasts, maxima, places and packed of every term; keys: term * n_ids + document of each occurrence, m: the documents' norms."""
    pairs, tf = np.unique(keys, return_counts=True)
    term, doc = pairs // n_ids, pairs % n_ids
    gain = share(tf, m[doc])
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(starts, len(term)))
    place = np.arange(len(term)) - np.repeat(starts, df)
    block = np.flatnonzero(place % BLOCK == 0)  # where blocks begin
    gaps = np.diff(doc, prepend=0)
    gaps[block] = 0
    data, ends = _packed(np.stack([gaps, tf], axis=1).ravel())
    n_blocks = -(-df // BLOCK)
    block_ends = np.concatenate([[0], np.cumsum(n_blocks)])
    byte = ends[2 * np.append(starts, len(term))]
    last = np.append(block[1:], len(term)) - 1
    four = lambda x: _strings(x.astype("<u4").view(np.uint8), 4 * block_ends)
    return [
        pa.array(df), pa.array(np.maximum.reduceat(gain, starts)), four(doc[block]), four(doc[last]), four(np.maximum.reduceat(gain, block)),
        four(ends[2 * block] - np.repeat(byte[:-1], n_blocks)), _strings(data, byte),
    ]


def build_index(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Posting lists by shard; a shard's row with a null term holds its documents' ids and norms."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def shard_rows(shard: int, ids: list, lengths: list, runs: list, vocabulary: dict) -> Iterator[pa.RecordBatch]:
        n = np.array(lengths, np.int64)
        m = 75 + (25 * n * n_docs) // n_terms
        keys = np.concatenate(runs) * len(n) + np.repeat(np.arange(len(n)), n)
        lists = postings(keys, len(n), m)
        size, none = len(vocabulary), pa.nulls(len(vocabulary), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, shard)), pa.array(list(vocabulary), pa.binary()), *lists, none, none, none], names=names)
        own = (np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], bool), m.astype("<i8"))
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([len(n)]), pa.array([0]), *[pa.nulls(1, pa.binary())] * 5, *[pa.array([x.tobytes()], pa.binary()) for x in own]], names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = TaskContext.get().partitionId() << 32, 0
        ids, lengths, runs, size, vocabulary = [], [], [], 0, defaultdict(count().__next__)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                length = 0
                for found in terms(text.as_py()):
                    runs.append(np.fromiter(map(vocabulary.__getitem__, found), np.int64, len(found)))
                    length += len(found)
                    size += 7 * len(found)
                if not length:
                    continue
                ids.append(doc_id.as_py())
                lengths.append(length)
                if size >= SHARD_BYTES:
                    yield from shard_rows(first + number, ids, lengths, runs, vocabulary)
                    number += 1
                    ids, lengths, runs, size, vocabulary = [], [], [], 0, defaultdict(count().__next__)
        if ids:
            yield from shard_rows(first + number, ids, lengths, runs, vocabulary)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(texts.mapInArrow(build, INDEX), "lexical-index")


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and the terms of all."""
    separates = np.frombuffer(_TABLE, np.uint8) == 32

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for text in batch.column("text"):
                data = np.frombuffer((text.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)
                gap = np.concatenate([[True], separates[data]]) if len(data) else np.ones(1, bool)
                n.append(int(np.count_nonzero(gap[:-1] & ~gap[1:])))
            yield pa.RecordBatch.from_pydict({"docs": pa.array([sum(x > 0 for x in n)], pa.int64()), "terms": pa.array([sum(n)], pa.int64())})

    r = docs.select("text").mapInArrow(tally, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return r[0] or 0, r[1] or 0


class Postings:
    """One list of one shard; blocks are unpacked when a candidate needs them."""

    def __init__(self, row) -> None:
        self.df, self.best = int(row.df), int(row.best)
        self.firsts, self.lasts, self.maxima, self.places = (np.frombuffer(x, "<u4").astype(np.int64) for x in (row.firsts, row.lasts, row.maxima, row.places))
        self.packed = np.frombuffer(row.packed, np.uint8)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of block b."""
        if b not in self.open:
            values = _unpacked(self.packed[self.places[b]:self.places[b + 1] if b + 1 < len(self.places) else None])
            self.open[b] = (self.firsts[b] + np.cumsum(values[0::2]), values[1::2])
        return self.open[b]

    def blocks(self, numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(b) for b in numbers]
        return np.concatenate([d for d, _ in found]), np.concatenate([t for _, t in found])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Postings of documents from low to high."""
        a, b = np.searchsorted(self.lasts, low), np.searchsorted(self.firsts, high, "right")
        if a >= b:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        doc, tf = self.blocks(range(a, b))
        inside = (doc >= low) & (doc <= high)
        return doc[inside], tf[inside]


def search_shard(lists: dict, ids: list, norms: np.ndarray, items: list, weights: dict, k: int, stats: dict | None = None) -> list[tuple]:
    """(item, doc_id, score) of the k best documents of a shard for each item (number, {term: repeats}). stats counts what is unpacked."""
    names = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
    null = np.array([i is None for i in ids], bool)
    gains: dict[tuple, np.ndarray] = {}
    out = []
    for item, wanted in items:
        own = sorted(((weights[t] * n * lists[t].best, weights[t] * n, t) for t, n in wanted.items() if t in lists and weights[t] > 0), key=lambda x: (x[0], x[2]))
        if not own:
            continue
        bounds = np.cumsum([x[0] for x in own])  # of the weakest lists together
        docs, scores, limit = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for low in range(0, len(ids), WINDOW):
            high = min(low + WINDOW, len(ids)) - 1
            first = int(np.searchsorted(bounds, limit, "left"))  # lists before it cannot reach the limit by themselves
            if first == len(own):
                break
            sums, seen = np.zeros(high - low + 1, np.int64), np.zeros(high - low + 1, bool)
            for _, w, t in own[first:]:
                doc, tf = lists[t].between(low, high)
                sums[doc - low] += w * share(tf, norms[doc])
                seen[doc - low] = True
            found = np.flatnonzero(seen) + low
            score = sums[found - low]
            for n in range(first - 1, -1, -1):
                enough = score + bounds[n] >= limit
                found, score = found[enough], score[enough]
                if not len(found):
                    break
                _, w, t = own[n]
                rest = bounds[n - 1] if n else 0
                at = np.searchsorted(lists[t].lasts, found)
                may = at < len(lists[t].lasts)
                may[may] = lists[t].firsts[at[may]] <= found[may]
                most = np.where(may, w * lists[t].maxima[np.minimum(at, len(lists[t].lasts) - 1)], 0)
                enough = score + most + rest >= limit  # by the block's maximum, before it is unpacked
                found, score, at, may = found[enough], score[enough], at[enough], may[enough]
                if may.any():
                    doc, tf = lists[t].blocks(np.unique(at[may]).tolist())
                    place = np.searchsorted(doc, found)
                    hit = place < len(doc)
                    hit[hit] = doc[place[hit]] == found[hit]
                    score = score.copy()
                    score[hit] += w * share(tf[place[hit]], norms[found[hit]])
            good = score > 0
            docs, scores = np.concatenate([docs, found[good]]), np.concatenate([scores, score[good]])
            if len(docs) > k:
                top = np.lexsort((docs, names[docs], null[docs], -scores))[:k]
                docs, scores = docs[top], scores[top]
            if len(docs) == k:
                limit = int(scores.min())
        out.extend((item, ids[d], int(s)) for d, s in zip(docs.tolist(), scores.tolist()))
    if stats is not None:
        stats["blocks"] = sum(len(p.lasts) for p in lists.values())
        stats["unpacked"] = sum(len(p.open) for p in lists.values())
    return out


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    n_docs, n_terms = totals(docs)
    index = build_index(docs, n_docs, n_terms) if n_docs else None
    distinct = items.select(F.col("item_id").cast("long").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    numbered = prefix_sums(distinct.withColumn("bytes", F.octet_length("text").cast("long")), ["item_id", "text"], "bytes", rank="item", before="before")
    numbered = numbered.withColumn("part", F.floor(F.col("before") / ITEM_BYTES).cast("long"))
    parts = numbered.agg(F.max("part")).first()[0]
    heaps = spark.createDataFrame([], "item long, doc_id long, score long")
    for part in range(0 if parts is None or index is None else parts + 1):
        heaps = heaps.unionByName(_search_part(index, numbered.where(F.col("part") == part), n_docs, k))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    top = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = numbered.select("item", F.col("item_id").cast("long").alias("item_id"))
    return top.join(sized(names), "item").select("item_id", "rank", "doc_id", "score")


def _search_part(index: DataFrame, items: DataFrame, n_docs: int, k: int) -> DataFrame:
    """Heaps of all shards for one block of items, which is bounded and travels with the tasks."""
    asked = []
    for r in items.select("item", "text").collect():
        counts: dict[bytes, int] = defaultdict(int)
        for part in terms(r["text"]):
            for t in part:
                counts[t] += 1
        asked.append((r["item"], dict(counts)))
    known = sorted({t for _, c in asked for t in c})
    spark = index.sparkSession
    mine = spark.createDataFrame([(bytearray(t),) for t in known], "term binary")
    lists = index.join(F.broadcast(mine), "term", "left_semi")  # as many as the item block's terms
    df = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weights = {t: weight(n_docs, n) for t, n in df.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own, ids, norms = {}, [], np.empty(0, np.int64)
        for row in pdf.itertuples(index=False):
            if row.term is None:
                ids = [None if no else i for i, no in zip(np.frombuffer(row.ids, "<i8").tolist(), np.frombuffer(row.no_id, bool).tolist())]
                norms = np.frombuffer(row.norms, "<i8")
            else:
                own[bytes(row.term)] = Postings(row)
        found = search_shard(own, ids, norms, asked, weights, k)
        return pd.DataFrame({"item": [f[0] for f in found], "doc_id": pd.array([f[1] for f in found], dtype="Int64"), "score": [f[2] for f in found]})

    needed = lists.unionByName(index.where("term is null")).select(*[c.split()[0] for c in INDEX.split(", ")])
    return needed.groupBy("shard").applyInPandas(run, "item long, doc_id long, score long")
