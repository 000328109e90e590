import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from jobmarket.llm import exact_dedup, mixing, packing, sharding
from jobmarket.llm.common import components, file_rows, prefix_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, DOCS + extra)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (20, 20)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in (1, 2, 3, 4)) and got[10] == got[11] == got[12] == 10
    assert all(got[i] == 100 for i in range(100, 140)) and all(got[i] == 200 for i in range(200, 231)) and 20 not in got


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(9)) for i in range(500)]
    out = prefix_sums(spark.createDataFrame(rows, "k long, g string, v long"), ["k"], "v", "g").collect()
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    want = {k: (n, sum(x[2] for x in rs[:n])) for rs in by.values() for n, (k, _, _) in enumerate(sorted(rs))}
    assert {r["k"]: (r["rank"], r["before"]) for r in out} == want


@pytest.mark.parametrize("bits", [3, 64])
def test_exact_dedup_equals_brute_force(spark, bits):
    texts = ["a b", "ab", " a\nb\t", "", None, "abc", "ab c", "x" * 50_000, "x" * 49_999 + " x", "a b"]
    rows = [(i, t, None, None, None, "clash") for i, t in enumerate(texts)] + [(None, "abc", None, None, None, "clash"), (2, " a\nb\t", None, None, None, "clash")]
    got = exact_dedup.exact_dedup(docs(spark, rows, ", keep_id string"), capacity=1, bits=bits).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    for members in groups.values():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        mine = [g for g in got if g["doc_id"] in [m[0] for m in members] and g["keep_id"] == best[0]]
        assert len(mine) == len(members) and all(g["group_size"] == len(members) for g in mine)
        assert sum(g["kept"] for g in mine) == 1
    assert exact_dedup.exact_dedup(docs(spark, [])).collect() == []


def test_directory_doubles(spark):
    keys = spark.range(4000).select((__import__("pyspark").sql.functions.xxhash64("id")).alias("key"))
    slots, n = exact_dedup.directory(keys, 100)
    assert 40 <= n <= 128 and slots.max() == n - 1 and (np.diff(slots) >= 0).all()


def test_hilbert_is_a_bijection_of_neighbours():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    d = sharding.hilbert_distance(cells, 3)
    assert sorted(d) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(d)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_gapless_runs(spark):
    rows = [(i, "t" * (i % 7), ["en", "de", None][i % 3], None if i % 5 == 0 else f"src{i % 4}", i % 7) for i in range(101)] + [(5, "dup", "en", "src1", 3)] * 2
    out = sharding.hilbert_shards(docs(spark, rows, ", x int" if False else ""), ["source", "lang", "n_chars"], ["doc_id"], 8).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append((r["slot"], r["hilbert"]))
    assert len(out) == 103 and set(by) == set(range(8))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    flat = []
    for s in range(8):
        assert sorted(x for x, _ in by[s]) == list(range(len(by[s])))
        flat += [h for _, h in sorted(by[s])]
    assert flat == sorted(flat)
    assert sharding.hilbert_shards(docs(spark, []), ["source", "n_chars"], ["doc_id"], 4).count() == 0


def test_mixture_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(30))) or None, None, rng.choice(["a", "a", "a", "b", "c", None]), None) for i in range(900)]
    sized = docs(spark, rows).select("doc_id", "source", mixing.word_count().alias("size"))
    plan = mixing.curriculum(sized).collect()
    total = sum(r["size"] for r in plan)
    goal = {r["source"]: r["target"] for r in plan}
    assert len(plan) == 900 and abs(sum(goal.values()) - 1.5 * total) < 1e-6 * total
    for s, t in goal.items():
        mine = [r for r in plan if r["source"] == s]
        assert abs(sum(r["size"] * len(r["positions"]) for r in mine) - t) <= 15 and t <= 2 * mine[0]["source_size"] + 1e-9
    assert all(0 <= p <= 1 for r in plan for p in r["positions"]) and max(len(r["positions"]) for r in plan) <= 2
    stream = [r["position"] for r in mixing.ordered_mixture(mixing.curriculum(sized)).collect()]
    assert stream == sorted(stream) and len(stream) == sum(len(r["positions"]) for r in plan)
    assert mixing.curriculum(sized.limit(0)).count() == 0


def plain_targets(sizes, weights, share, cap):
    """The targets by the rule as it is stated, one source after the other."""
    order = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    capped, budget = {}, share * sum(n for _, n in order)
    while True:
        free = [s for s, _ in order if s not in capped]
        rest = budget - sum(capped.values())
        out = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: cap * n for s, n in order if s in out and out[s] > cap * n}
        if not over:
            return capped | out
        capped |= over


def test_targets_reshare(spark):
    rng = random.Random(4)
    for rows in ([("a", 10), ("b", 1000), ("c", 100)], [(f"s{i:04d}", rng.randrange(1, 10 ** rng.randrange(1, 6))) for i in range(700)] + [(None, 50)]):
        table = spark.createDataFrame(rows, "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(table, (5, 2, 1), share=1.5, cap=2.0).collect()}
        assert got == pytest.approx(plain_targets(rows, (5, 2, 1), 1.5, 2.0)) and sum(got.values()) == pytest.approx(1.5 * sum(n for _, n in rows))
    assert mixing.targets(table.limit(0)).count() == 0


def test_mixture_of_odd_rows(spark, tmp_path):
    """Clashing columns come back as they were; no words at all, repeated rows and nulls are defined."""
    names = "rank int, before string, position int, positions int, target string, source_size int, `order` int, `last` int, doc string, row int"
    rows = [(i, "w " * 9, None, "s", 9, 1, "x", 77, 2, "t", 3, 4, 5, "d", i) for i in (1, 1, None)] + [(4, None, None, None, None, 1, "x", 77, 2, "t", 3, 4, 5, "d", 4)]
    table = docs(spark, rows, f", {names}")
    table.write.parquet(f"{tmp_path}/docs")
    numbered = file_rows(spark.read.parquet(f"{tmp_path}/docs"), "_row")
    plan = mixing.curriculum(numbered.select(numbered["_row"].alias("row"), "doc_id", "source", mixing.word_count().alias("size")))
    out = mixing.mixed_documents(numbered, "_row", plan)
    assert out.columns == table.columns
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= set(rows) and 4 <= len(got) <= 6 and all(r[0] != 4 for r in got)
    empty = docs(spark, [(1, "", None, "s", 0), (2, None, None, None, None)])
    assert mixing.curriculum(empty.select("doc_id", "source", mixing.word_count().alias("size"))).where("size(positions) > 0").count() == 0


def test_prefix_sums_keep_clashing_columns(spark):
    rows = [(i, i % 3, 9, 8, 7, 6) for i in range(30)]
    out = prefix_sums(spark.createDataFrame(rows, "k long, g long, _pid int, _rank int, _sum int, _n0 int"), ["k"], "g", "g", rank="r", before="b").collect()
    assert sorted(tuple(r)[:6] for r in out) == sorted(rows) and sorted(r["r"] for r in out) == sorted(list(range(10)) * 3)


def test_strings_are_cut_by_their_whole_value(spark):
    names = ["common_a", "common_b", "common_prefix_that_is_long_c", "common_prefix_that_is_long_d", "zeta", None]
    rows = [(i, "t", "en", names[i % 6], i) for i in range(120)]
    out = sharding.hilbert_shards(docs(spark, rows, ""), ["source"], ["doc_id"], 6).collect()
    cells = defaultdict(set)
    for r in out:
        cells[r["source"]].add(r["hilbert"])
    assert len({min(c) for c in cells.values()}) >= 5 and all(len(c) == 1 for c in cells.values())
    assert [n for n, _ in sorted(cells.items(), key=lambda x: (min(x[1]), x[0] or ""))] == [None, *names[:5]]


def test_shard_query_equals_brute_force(spark, tmp_path):
    from jobmarket.llm.registry import op2_hilbert_shards

    rng = random.Random(3)
    rows = [(i if i % 9 else 5, rng.choice(["é" * 40, "a b", "", None, "x" * rng.randrange(3000)]), rng.choice(["en", "de", None]), f"src{rng.randrange(7)}", 1, 3, "clash", 8) for i in range(400)]
    docs(spark, rows, ", shard int, hilbert string, rank int").write.parquet(f"{tmp_path}/documents.parquet")
    out = op2_hilbert_shards(spark, str(tmp_path)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == want
    by = defaultdict(list)
    for r in out:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and {len(v) for v in by.values()} <= {16, 17} and all(sorted(v) == list(range(len(v))) for v in by.values())
    # quantise, walk the curve, cut runs: in plain Python
    docs_ = [(r[3], r[2], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()), r[0]) for r in rows]
    cells = []
    for d in range(3):
        values = sorted(v[d] for v in docs_ if v[d] is not None)
        if d < 2:
            cuts = sorted({max(values[i] for i in range(len(values)) if int((_last(values, values[i])) * 32 / len(docs_)) == c) for c in {int(_last(values, v) * 32 / len(docs_)) for v in values}})[:-1]
        else:
            cuts = sorted({values[max(0, -(-i * len(values) // 32) - 1)] for i in range(1, 32)})
        cells.append([sum(v[d] > c for c in cuts) * (32 // (len(cuts) + 1)) if v[d] is not None else 0 for v in docs_])
    order = sorted(zip(sharding.hilbert_distance(np.array(cells).T, 5).tolist(), [(v[3], v[4]) for v in docs_]))
    mine = [(r["hilbert"], (r["text_crc32"], r["doc_id"])) for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    assert mine == order


def _last(values, v):
    """Place of the last of the equal values."""
    import bisect

    return bisect.bisect_right(values, v) - 1


def test_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)  # unchanged: an end mark that a text spells out is one token
    rng = random.Random(5)
    bits = ["a", "The", "don't", "x1", " ", "  ", "\n", "\n\n", "\t", " ", "　", "é", "###", "12", "<|endoftext|>", "\x1c", " ", "'s", "ñandú", " \n", "\r\n", ".", "…", "».", 'ab."', "漢字", "ª", "²", "'", "a'", ").", "x)'s", "%%%", "_a_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["", " ", "a", " a", "a ", "it's a\nb c"]
    encoder = packing.UnitEncoder(path)
    for t in texts:
        assert encoder.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(t)


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 3, 50, 300, 1400, 2600]))), None, None, None) for i in range(150)]
    rows += [(None, None, None, None, None), (3, "again", None, None, None), (3, "again", None, None, None)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.pack(packing.pieces(docs(spark, rows), path), block_items=60).collect()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = defaultdict(int)
    for doc_id, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], dtype="<u4")
        first, start = len(ids) % 1024 or 1024, 0
        for piece, stop in enumerate(range(first, len(ids) + 1, 1024)):
            want[doc_id, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())] += 1
            start = stop
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in out:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.06 * -(-sum(r["length"] for r in out) // 1024) + 1
    assert packing.pack(packing.pieces(docs(spark, []), path)).count() == 0


def test_crossover_keeps_every_piece_once():
    rng = random.Random(2)
    size = [rng.randrange(1, 1024) for _ in range(200)]
    a, b = packing._first(size, 1024, rng, 0.0), packing._first(size, 1024, rng, 0.5)
    child = packing.crossover(a, b, size, 1024, rng)
    assert sorted(i for g in child for i in g) == list(range(200)) and all(sum(size[i] for i in g) <= 1024 for g in child)
    best = packing.evolve([a, b], size, 1024, 8, rng)[0]
    assert len(best) <= min(len(a), len(b)) and sorted(i for g in best for i in g) == list(range(200))


def test_evolution_beats_its_best_fit_start():
    """Pieces near a third and near a half of a sequence: best fit leaves bins that the search fills."""
    for seed in range(3):
        rng = random.Random(seed)
        size = [rng.randrange(205, 512) for _ in range(300)]
        start = packing._starts(size, 1024, 0, 3, random.Random(seed))
        best = packing.evolve(start, size, 1024, 12, random.Random(seed))[0]
        assert len(best) < min(map(len, start)) and len(best) >= -(-sum(size) // 1024)
        assert sorted(i for g in best for i in g) == list(range(300)) and all(sum(size[i] for i in g) <= 1024 for g in best)


def test_packing_query_goes_through_the_search(spark):
    """With the same blocks and starts, no generations give more sequences than some."""
    rng = random.Random(1)
    rows = [(i, 0, 0, rng.randrange(205, 512), 0) for i in range(1200)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    count = lambda g: packing.pack(cut, block_items=300, generations=g).select("sequence_id").distinct().count()
    assert count(12) < count(0)


def test_packing_keeps_clashing_columns(spark):
    rows = [(i, 0, 0, 500 + i, 0, "u", 3, 4) for i in range(20)]
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, uid string, block int, bin int")
    out = packing.pack(cut).collect()
    assert len(out) == 20 and all((r["uid"], r["block"], r["bin"]) == ("u", 3, 4) for r in out)


def test_the_index_decides_the_groups(spark, tmp_path):
    """Buckets are folders; a smaller capacity splits them; texts of one key are told apart by their bytes."""
    rows = [(i, f"text {i // 2}", None, None, None) for i in range(400)]
    docs(spark, rows).write.parquet(f"{tmp_path}/docs")
    numbered = file_rows(spark.read.parquet(f"{tmp_path}/docs"), "row").select("doc_id", "text", "row")
    signed = exact_dedup.signed_rows(numbered)
    folders = {}
    for capacity in (1000, 20):
        slots, n = exact_dedup.directory(signed, capacity)
        index = exact_dedup.build_index(numbered, slots)
        folders[capacity] = {f.split("bucket=")[1].split("/")[0] for f in index.inputFiles()}
        assert len(folders[capacity]) == n and index.count() == 200 and index.agg({"group_size": "sum"}).first()[0] == 400
        sizes = [r["count"] for r in index.groupBy("bucket").count().collect()]
        assert max(sizes) <= capacity
    assert len(folders[1000]) == 1 and len(folders[20]) >= 10
    slots, _ = exact_dedup.directory(exact_dedup.signed_rows(numbered, 2), 20)
    index = exact_dedup.build_index(numbered, slots, 2)
    assert index.where("chains > 1").count() > 150 and index.select("bucket", "key", "chain").distinct().count() == 200
