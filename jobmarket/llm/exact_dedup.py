"""Exact dedup by an extendible-hash index on shared files.

Texts are equal when they are identical after deleting ASCII white space. Each text gets a 64-bit hash; the leading bits choose a
directory slot, the slot a bucket. The directory starts with one bucket and doubles until no bucket holds more distinct hashes than
`capacity` (or the depth limit is reached, where a bucket simply stays longer); only overfull buckets are split. A bucket is a range of
keys and a folder of the index, which is Parquet in the shared folder. Owner tasks take whole buckets: they read a bucket's rows sorted by
hash, chain texts whose hashes collide, and compare their bytes, so a collision never merges two texts. Rows of one text are first
reduced inside each Arrow batch, so a text that makes up a third of all rows reaches its owner as one row per batch.

A row finds its group through the directory: slot, bucket, key. Where a key's chain holds one text, all rows of that key have been compared
with it and are its group; rows of a key with a longer chain are compared with the chain's texts, byte by byte, in a join.

Nulls count as the empty text; empty texts are equal to each other. Null ids lose ties against
real ids. An empty table gives an empty result. Rows that repeat an id are separate rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmarket.llm.common import sized, written

SPACES = b" \t\n\x0b\x0c\r"
MAX_ID = 2**63 - 1
DIRECTORY_LIMIT = 16  # bits; the directory has 65,536 slots at most


def _hash64(text: bytes, bits: int) -> int:
    value = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big")
    return (value >> (64 - bits) << (64 - bits)) - 2**63


def _normal(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass").translate(None, SPACES) for t in texts]


def signed_rows(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, row (its number), chars of the original, hash and sha256 of each row's normalised text."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = _normal(pdf["text"])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "chars": [len(t or "") for t in pdf["text"]],
                "key": [_hash64(t, bits) for t in texts], "sha": [hashlib.sha256(t).digest() for t in texts],
            })

    return docs.select("doc_id", "text", "row").mapInPandas(sign, "doc_id long, row long, chars long, key long, sha binary")


def _slot() -> Column:
    """The leading bits of the key, counted from the smallest key."""
    return F.shiftrightunsigned("key", 64 - DIRECTORY_LIMIT).cast("int").bitwiseXOR(F.lit(1 << (DIRECTORY_LIMIT - 1)))


def directory(keys: DataFrame, capacity: int) -> tuple[np.ndarray, int]:
    """Double the directory until every bucket holds at most `capacity` distinct hashes.

    Returns the bucket of each slot (by the DIRECTORY_LIMIT leading bits) and the bucket count.
    Only one counter per slot reaches the driver: 65,536 at most.
    """
    rows = keys.select("key").distinct().groupBy(_slot().alias("slot")).count().collect()
    fill = np.zeros(2**DIRECTORY_LIMIT, dtype=np.int64)
    for r in rows:
        fill[r["slot"]] = r["count"]
    depth, pages = 0, [(0, 0)]  # (local depth, leading bits)
    while True:
        split = [p for p in pages if p[0] == depth and depth < DIRECTORY_LIMIT and fill[p[1] << (DIRECTORY_LIMIT - depth):(p[1] + 1) << (DIRECTORY_LIMIT - depth)].sum() > capacity]
        if not split:
            break
        pages = [p for p in pages if p not in set(split)] + [(depth + 1, 2 * p[1] + b) for p in split for b in (0, 1)]
        depth += 1
    slots = np.zeros(2**DIRECTORY_LIMIT, dtype=np.int32)
    for bucket, (d, bits) in enumerate(sorted(pages, key=lambda p: p[1] << (DIRECTORY_LIMIT - p[0]))):
        slots[bits << (DIRECTORY_LIMIT - d):(bits + 1) << (DIRECTORY_LIMIT - d)] = bucket
    return slots, len(pages)


ENTRY = "bucket int, key long, chain int, chains int, text binary, keep_id long, keep_row long, group_size long"


def build_index(numbered: DataFrame, slots: np.ndarray, bits: int = 64) -> DataFrame:
    """One entry per distinct text, in the folder of its bucket: key, chain (place among the texts of one key), chains (how many there
    are), text (normalised; only where a chain holds several), keep_id, keep_row, group_size.
    """

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["chars", "doc_id", "row"], ascending=[False, True, True], kind="stable").drop_duplicates("norm")
        return best.assign(n=best["norm"].map(pdf.groupby("norm")["n"].sum()))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            norm = _normal(pdf["text"])
            key = np.array([_hash64(t, bits) for t in norm], dtype=np.int64)
            ids = pdf["doc_id"].astype("Int64").fillna(MAX_ID).astype("int64")
            rows = pd.DataFrame({"norm": norm, "key": key, "chars": [len(t or "") for t in pdf["text"]], "doc_id": ids, "row": pdf["row"], "n": 1})
            rows["bucket"] = slots[(key.view(np.uint64) + np.uint64(2**63)) >> np.uint64(64 - DIRECTORY_LIMIT)]
            yield reduce(rows)[["bucket", "key", "norm", "chars", "doc_id", "row", "n"]]

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket and key; a chain holds the texts of one key only."""
        chain: dict[bytes, list] = {}
        bucket = key = None

        def done() -> list[tuple]:
            texts = sorted(chain.items())
            return [(bucket, key, at, len(texts), t if len(texts) > 1 else None, None if c[1] == MAX_ID else c[1], c[2], c[3]) for at, (t, c) in enumerate(texts)]

        columns = [c.split()[0] for c in ENTRY.split(", ")]
        for pdf in batches:
            out: list[tuple] = []
            for b, k, norm, chars, doc_id, row, n in zip(pdf["bucket"], pdf["key"], pdf["norm"], pdf["chars"], pdf["doc_id"], pdf["row"], pdf["n"]):
                if k != key:
                    out += done()
                    chain, bucket, key = {}, b, k
                entry = chain.setdefault(norm, [-1, MAX_ID, MAX_ID, 0])  # bytes are compared here
                entry[3] += n
                if (-chars, doc_id, row) < (-entry[0], entry[1], entry[2]):
                    entry[:3] = [chars, doc_id, row]
            yield pd.DataFrame(out, columns=columns).astype({"keep_id": "Int64"})
        yield pd.DataFrame(done(), columns=columns).astype({"keep_id": "Int64"})

    mine = numbered.mapInPandas(local, "bucket int, key long, norm binary, chars long, doc_id long, row long, n long")
    n = int(slots.max()) + 1
    owners = min(n, int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # each owns a run of buckets, a range of keys
    owned = mine.repartitionById(owners, F.floor(F.col("bucket") * owners / n).cast("int")).sortWithinPartitions("bucket", "key")
    return written(owned.mapInPandas(own, ENTRY), "exact-index", by="bucket")


def exact_dedup(docs: DataFrame, capacity: int = 4_000, bits: int = 64, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, row, keep_id, group_size, kept, text_sha256.

    `kept` marks one row of each group: the row with most code points, then the smallest doc_id.
    row: a column that names each row of docs, the same on every read; without it docs are numbered and written.
    """
    numbered = docs.select("doc_id", "text", F.col(row).alias("row")) if row else written(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "numbered")
    signed = written(signed_rows(numbered, bits), "signed")
    slots, _ = directory(signed, capacity)
    index = build_index(numbered, slots, bits)
    look_up = docs.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(len(slots)), "bucket": slots}), "slot int, bucket int")  # the directory: a row for each slot
    found = signed.withColumn("slot", _slot()).join(F.broadcast(look_up), "slot").drop("slot", "chars")
    out = ["doc_id", "row", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    single = found.join(index.where("chains = 1").drop("text"), ["bucket", "key"]).select(*out)
    several = index.where("chains > 1")
    if several.isEmpty():
        return single
    theirs = found.join(sized(several.select("bucket", "key").distinct()), ["bucket", "key"], "left_semi")
    normal = F.translate(F.coalesce("text", F.lit("")), SPACES.decode(), "").cast("binary")
    texts = numbered.select("row", normal.alias("text")).join(theirs, "row")
    return single.unionByName(texts.join(several, ["bucket", "key", "text"]).select(*out))
