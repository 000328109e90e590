import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from jobmarket.llm import simhash
from jobmarket.llm.registry import op12_covering_simhash

DOCS = "doc_id long, text string, fp string, component_id long"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def reach(prints):
    """Component of each fingerprint by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(prints), 2):
        if (a ^ b).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def test_masks_cover_every_pair_of_positions():
    level = [0]
    for _ in range(3):
        for m in level:
            masks = simhash.tables(m)
            free = [p for p in range(64) if not m >> p & 1]
            for pair in combinations(free, 2):
                assert any(not t >> pair[0] & 1 and not t >> pair[1] & 1 for t in masks)
        level = [t for m in level[:20] for t in simhash.tables(m)]
    assert {bin(t).count("1") for t in simhash.tables(0)} <= {36, 37, 38}


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    words = [f"W{i}é" for i in range(40)]
    rows = []
    for d in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 200]))]
        for c in range(rng.randrange(1, 5)):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((1000 - len(rows), rng.choice([" ", "\n\t "]).join(copy)))
    rows += [(5, None), (4, ""), (3, " \n"), (None, "a b"), (2, "a b"), (2, "a b"), (None, "lonely words only here"), (7, "\x1f  x y"), (8, "big text " * 300_000)]
    spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_covering_simhash(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1, r["fingerprint"]) for r in got) == sorted((d or -1, f"{plain(t):016x}") for d, t in rows)
    component = reach({plain(t) for _, t in rows})
    smallest = {}
    for d, t in rows:
        c = component[plain(t)]
        smallest[c] = min((x for x in (d, smallest.get(c)) if x is not None), default=None)
    for r in got:
        assert r["component_id"] == smallest[component[int(r["fingerprint"], 16)]]
    assert op12_covering_simhash_empty(spark) == []


def op12_covering_simhash_empty(spark):
    return simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect()


def test_shingle_hash_is_sparks(spark):
    text = "Ünder the BRIDGE"
    assert simhash.fingerprint(text) == spark.range(1).select(F.xxhash64(F.lit("Ünder the bridge"))).first()[0] % 2**64


def test_large_buckets_are_split_without_a_lost_link(spark):
    rng = np.random.default_rng(4)
    base = int(rng.integers(1, 2**63))
    near = {base ^ (1 << a) ^ (1 << b) for a, b in combinations(range(40), 2)} | {base ^ (1 << 50) ^ (1 << i) ^ (1 << 3) for i in range(30)}
    far = {int(x) for x in rng.integers(0, 2**63, 300)} | {x ^ 6 for x in [int(x) for x in rng.integers(0, 2**63, 50)]}
    prints = near | far | {x ^ 1 for x in list(far)[:40]}
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    want = reach(prints)
    for limit in (3, 40, 5000):
        from jobmarket.llm.common import components

        got = {r["node"] % 2**64: r["component"] for r in components(simhash.links(frame, limit)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
        mine = {}
        for p in prints:
            mine.setdefault(got.get(p, p), set()).add(p)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))
