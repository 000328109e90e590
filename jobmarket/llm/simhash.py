"""SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its three-word shingles' hashes have it (repeats count). Two fingerprints are linked if
they differ in at most two bits. Every bit position has a vector of three bits; each of the seven non-zero vectors v gives a mask of the
positions whose product with v is odd. Two differing positions span at most two dimensions, so some v is orthogonal to both: its mask holds neither, and
the pair shares a bucket in that table. Each mask holds 36 or 37 of the 64 bits; no pair within the radius is missed.

Only distinct fingerprints are dealt into tables, once each. A bucket of more than `limit` fingerprints is not compared: its members
agree on the mask's bits, so the positions left open are covered again by seven masks, which contain the first one, and so on. Each round leaves about three
sevenths of the open positions open, until a bucket is small or at most eight are (256 fingerprints at most); rows grow by seven a round, for members of large buckets alone, and no link is lost.
A bucket's links leave its task as a spanning forest, never as all pairs.

Null and empty texts have fingerprint zero and are linked like any other. Fewer than three words are one shingle. A component is named by its smallest doc_id, nulls
aside (null if all are null). Repeated rows are rows of their own. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import components, sized, written

BITS, N_WORDS, SEED, RADIUS = 64, 3, 42, 2
BLOCK = 1 << 20  # bytes of a text whose words are held at a time
LIMIT = 2_000  # fingerprints of a bucket that are compared with one another
FEW_OPEN = 8  # open positions with which a bucket is compared whatever its size
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, block by block."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end].split()  # bytes split at the six white spaces
        at = end


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text."""
    counts, n, held = np.zeros(BITS, np.int64), 0, []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):  # bytes: A-Z alone change
        held += words
        if len(held) >= N_WORDS:
            hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(held[k:] for k in range(N_WORDS)))]
            counts, n, held = counts + _bit_counts(hashes), n + len(hashes), held[1 - N_WORDS:]
    if not n and held:
        counts, n = _bit_counts([xxhash.xxh64_intdigest(b" ".join(held), SEED)]), 1
    return int((2 * counts > n) @ (1 << np.arange(BITS, dtype=np.uint64))) if n else 0


def _bit_counts(hashes: list[int]) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    values = np.array(hashes, dtype="<u8")
    for at in range(0, len(values), 1 << 14):
        bits = np.unpackbits(values[at:at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


def cover(positions: list[int]) -> list[int]:
    """Seven masks over some of the 64 positions: any two positions are absent from one of them at least.

    Position number i has the vector 1 + i % 7; mask v holds the positions whose vector has an odd product with v.
    """
    masks = []
    for v in range(1, 8):
        masks.append(sum(1 << p for i, p in enumerate(positions) if (v & (1 + i % 7)).bit_count() % 2))
    return masks


def tables(mask: int) -> list[int]:
    """Masks that cover the positions that `mask` leaves open, each with mask itself."""
    return [mask | m for m in cover([p for p in range(BITS) if not mask >> p & 1])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(values: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints."""
    left = np.ones(len(values), bool)
    out: list[tuple[int, int]] = []
    for start in range(len(values)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            at = queue.pop()
            open_ = np.flatnonzero(left)
            near = open_[np.bitwise_count(values[open_] ^ values[at]) <= RADIUS]
            left[near] = False
            queue.extend(near.tolist())
            out.extend((int(values[at]), int(values[k])) for k in near)
    return out


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) within the radius."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; no bucket holds more than `limit` rows."""
        held, values = None, []

        def edges() -> pd.DataFrame:
            found = [e for v in values if len(v) > 1 for e in _forest(np.array(v, np.int64).view(np.uint64))]
            return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

        for pdf in batches:
            for t, key, fp in zip(pdf["mask"].tolist(), pdf["key"].tolist(), pdf["fp"].tolist()):
                if (t, key) != held:
                    held = (t, key)
                    values.append([])
                values[-1].append(fp)
            last = values.pop() if values else []
            yield edges()
            values = [last]
        yield edges()

    def dealt(rows: DataFrame) -> DataFrame:
        """rows (mask, fp) into the tables that follow each mask."""
        masks = [r["mask"] for r in rows.select("mask").distinct().collect()]  # 7 to the power of the round at most
        follow = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(t)) for t in tables(m % (1 << BITS))]))]) if masks else F.lit(None)
        return rows.select("fp", F.explode(follow[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "key", "fp")

    rows, found = prints.select(F.lit(0).cast("long").alias("mask"), "fp"), []
    while not rows.isEmpty():
        keyed = dealt(rows)
        size = written(keyed.groupBy("mask", "key").count().where("count > 1"), "buckets")
        small = (F.col("count") <= limit) | (F.bit_count(F.col("mask")) >= BITS - FEW_OPEN)
        few = keyed.join(sized(size.where(small).drop("count")), ["mask", "key"], "left_semi")
        found.append(written(few.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInPandas(compare, "a long, b long"), "links"))
        large = size.where(~small).drop("count")
        if large.isEmpty():
            break
        rows = written(keyed.join(sized(large), ["mask", "key"], "left_semi").select("mask", "fp"), "open")
    edges = prints.sparkSession.createDataFrame([], "a long, b long")
    for f in found:
        edges = edges.unionByName(f)
    return edges


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One text at a time becomes a Python string."""
        for batch in batches:
            prints = [_signed(fingerprint(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(prints, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    signed = written(fingerprints(docs), "fingerprints")
    prints = written(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")  # a third of all rows in one print is one row after each task's own sum
    linked = written(components(links(prints.select("fp"), limit)), "components")
    placed = prints.join(sized(linked), F.col("fp") == F.col("node")).select("fp", "first", "component")
    names = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    moved = written(placed.join(sized(names), "component").select("fp", "component_id"), "names")
    named = written(prints.join(sized(moved), "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "named")
    return signed.join(sized(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
